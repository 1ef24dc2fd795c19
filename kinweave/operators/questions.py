"""Question generation: every candidate is made, then each stratum keeps its first by a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinship_terms as K
from ..functions.text import plural, predicate_words
from ..sources.shared import written
from . import paths


def _name(c: Column) -> Column:
    return F.concat(F.lit("P"), c.cast("string"))


#: Template wording of fact and count questions.
FACTS = (("hasFather", "Who is {name}'s father?", "person"), ("hasMother", "Who is {name}'s mother?", "person"), ("hasSpouse", "Who is {name}'s spouse?", "person"), ("hasSibling", "Who are {name}'s siblings?", "list"), ("hasChild", "Who are {name}'s children?", "list"))
COUNTS = (("hasChild", "How many children does {name} have?"), ("hasSibling", "How many siblings does {name} have?"))
FILTERS = (("hasBrother", "Who are {name}'s brothers?"), ("hasSister", "Who are {name}'s sisters?"), ("hasSon", "Who are {name}'s sons?"), ("hasDaughter", "Who are {name}'s daughters?"))


def _asked(pattern: Column, who: Column) -> Column:
    return F.replace(pattern, F.lit("{name}"), who)


def fact_questions(edges: DataFrame) -> DataFrame:
    """Category 1: anchor, template, question_text, names, context."""
    t = edges.sparkSession.createDataFrame(FACTS, "pred string, q string, kind string")
    g = edges.select("src", "pred", "dst").distinct().join(F.broadcast(t), "pred").groupBy(F.col("src").alias("anchor"), F.col("pred").alias("template"), "q", "kind").agg(F.array_sort(F.collect_list(_name(F.col("dst")))).alias("names"))
    me = _name(F.col("anchor"))
    one = F.concat(me, F.lit("'s "), predicate_words(F.col("template")), F.lit(" is "), F.col("names")[0], F.lit("."))
    many = F.concat(me, F.lit(" has the following "), predicate_words(F.col("template")), F.lit("s: "), F.array_join("names", ", "), F.lit("."))
    return g.select("anchor", "template", _asked(F.col("q"), me).alias("question_text"), F.when(F.col("kind") == "person", F.slice("names", 1, 1)).otherwise(F.col("names")).alias("names"), F.when(F.col("kind") == "person", one).otherwise(many).alias("context"))


def count_questions(edges: DataFrame) -> DataFrame:
    """Category 3 counts: anchor, template, question_text, n; grandchildren are counted by way, not by person."""
    t = edges.sparkSession.createDataFrame(COUNTS, "pred string, q string")
    direct = edges.join(F.broadcast(t), "pred").groupBy(F.col("src").alias("anchor"), F.col("pred").alias("template"), "q").agg(F.count("*").alias("n"))
    child = edges.filter("pred = 'hasChild'")
    grand = child.select(F.col("src").alias("anchor"), F.col("dst").alias("mid")).join(child.select(F.col("src").alias("mid"), "dst"), "mid").groupBy("anchor").agg(F.count("*").alias("n"))
    grand = grand.select("anchor", F.lit("hasGrandchild").alias("template"), F.lit("How many grandchildren does {name} have?").alias("q"), "n")
    return direct.unionByName(grand).select("anchor", "template", _asked(F.col("q"), _name(F.col("anchor"))).alias("question_text"), "n")


def filter_questions(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Category 3 filters: anchor, template, question_text, names. strict gives brothers as the answer about sisters too, as some published answer keys do."""
    t = edges.sparkSession.createDataFrame([(("hasBrother" if strict and p == "hasSister" else p), p, q) for p, q in FILTERS], "pred string, template string, q string")
    g = edges.join(F.broadcast(t), "pred").groupBy(F.col("src").alias("anchor"), "template", "q").agg(F.array_sort(F.collect_list(_name(F.col("dst")))).alias("names"))
    return g.select("anchor", "template", _asked(F.col("q"), _name(F.col("anchor"))).alias("question_text"), "names")


def _reached(edges: DataFrame, anchors: DataFrame, wanted: list[str]) -> DataFrame:
    """anchor, path, names; an anchor's rows stay in one task from here on."""
    found = paths.traverse_coded(edges, anchors, wanted).filter("anchor <> node").repartition("anchor")
    return paths.named(found.groupBy("anchor", "code").agg(F.array_sort(F.collect_list(_name(F.col("node")))).alias("names")), wanted)


def path_questions(edges: DataFrame, anchors: DataFrame, wanted: list[str]) -> DataFrame:
    """Category 2: anchor, path, hops, question_text, names, bio_term; one row for each wording and number of hops (the first path)."""
    terms = K.bio_path(edges.sparkSession, extended=True)
    df = _reached(edges, anchors, wanted).join(F.broadcast(terms), "path")
    me, term = _name(F.col("anchor")), F.col("bio_term")
    text = F.when(F.size("names") == 1, F.concat(F.lit("Who is "), me, F.lit("'s "), term, F.lit("?"))).otherwise(F.concat(F.lit("Who are "), me, F.lit("'s "), plural(term), F.lit("?")))
    df = df.withColumn("question_text", text)
    # A text names its anchor, so equal texts have one anchor.
    first = F.row_number().over(Window.partitionBy("anchor", "question_text", "hops").orderBy("path"))
    return df.withColumn("k", first).filter("k = 1").select("anchor", "path", "hops", "question_text", "names", "bio_term")


def override_questions(edges: DataFrame, anchors: DataFrame, system: str, extended: bool = False, strict: bool = False) -> DataFrame:
    """Category 4: anchor, path, kind, question_text, gold (array) for every override of a system, one row a wording: the shortest, then first path, and the golds of all paths that share it; systems without overrides ask descriptively."""
    spark = edges.sparkSession
    rules = K.kin_override(spark, extended).filter(F.col("system") == system)
    known = K.paths(extended=True, strict=strict)
    mine = sorted({p for s, p, *_ in K.overrides(extended) if s == system and p in known})
    me, label = _name(F.col("anchor")), F.lit(system.capitalize())
    one = F.size("names") == 1
    if not mine:
        df = _reached(edges, anchors, [p for p in K.paths(extended) if p.count(".")]).join(F.broadcast(K.bio_path(spark, extended)), "path")
        text = F.concat(F.lit("In the "), label, F.lit(" (descriptive) system, "), F.when(one, F.concat(F.lit("who is specifically "), me, F.lit("'s "), F.col("bio_term"))).otherwise(F.concat(F.lit("who are specifically "), me, F.lit("'s "), plural(F.col("bio_term")))), F.lit("?"))
        return df.select("anchor", "path", F.lit("descriptive").alias("kind"), text.alias("question_text"), F.col("names").alias("gold"))
    df = _reached(edges, anchors, mine).join(F.broadcast(rules), "path").join(F.broadcast(K.bio_path(spark, True, strict)), "path")
    term, who = F.col("kin_term"), F.array_join("names", ", ")
    s = F.when(one, "").otherwise("s")
    cultural = F.concat(F.lit("In the "), label, F.lit(" kinship system, "), F.when(one, "who is ").otherwise("who are "), me, F.lit("'s "), term, s, F.lit("?"))
    disambiguation = F.concat(F.lit("In the "), label, F.lit(" system, "), who, F.when(one, " is called ").otherwise(" are called "), me, F.lit("'s '"), term, s, F.lit("'. What is their actual biological relationship?"))
    comparison = F.concat(F.lit("List all of "), me, F.lit("'s "), term, F.lit("s according to the "), label, F.lit(" system."))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("question_text"), g.alias("gold")) for k, t, g in (("cultural_term", cultural, F.col("names")), ("disambiguation", disambiguation, F.array("bio_term")), ("comparison", comparison, F.col("names")))])
    asked = df.select("anchor", "path", F.explode(kinds).alias("x")).select("anchor", "path", "x.*")
    asked = asked.groupBy("question_text").agg(F.min(F.struct(F.length("path"), "path", "kind", "anchor")).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("gold")))).alias("gold"))
    return asked.select("first.anchor", "first.path", "first.kind", "question_text", "gold")


def sampled(questions: DataFrame, stratum: str, count: int, order: list[Column], system: str, first: int = 1) -> DataFrame:
    """The first count rows of each stratum in the given total order, with ids <system>_0001 and on: a stratum's offset plus the rank in it, so no window spans all rows."""
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    kept = written(questions.withColumn("rank", k).filter(F.col("rank") <= count))
    sizes = kept.groupBy(stratum).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a stratum
    kept = kept.join(sizes.select(stratum, before.alias("__before")), stratum)
    return kept.withColumn("question_id", F.format_string(f"{system}_%04d", F.col("__before") + F.col("rank") + (first - 1))).drop("__before")
