"""Whole question sets: candidates of all four categories, quotas, ids, and augmentation.

Every candidate is made, in joins over all anchors and paths at once; quotas then take the first of
each stratum in a seeded hash order, so a set is the same wherever it is made. edges has src, pred,
dst; people has id and name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinship_terms as K
from ..functions.text import plural, predicate_words
from ..sources.datasets import truth
from ..sources.shared import written
from . import paths as P
from . import questions as Q

#: Fixed values: (category, hops or None for any, how many).
QUOTAS = ((1, None, 50), (2, 2, 50), (2, 3, 50), (2, 4, 50), (3, None, 100), (4, 2, 70), (4, 3, 70), (4, 4, 60))
EXTENDED_QUOTAS = ((1, None, 50), (2, 2, 40), (2, 3, 40), (2, 4, 40), (2, 5, 40), (2, 6, 40), (3, None, 100), (4, 2, 60), (4, 3, 60), (4, 4, 50), (4, 5, 40), (4, 6, 40))
#: The ids that further questions start from.
FOUR_HOP_IDS, LONG_HOP_IDS = 501, 801
FOUR_HOP_COUNT, LONG_HOP_COUNT = 50, 25

#: The time span of the graph that a system's longer questions need, as its skewed terms need more generations.
LONG_HOP_GRAPH = {"hawaiian": "200yr", "crow": "200yr", "omaha": "200yr", "iroquois": "extended", "dravidian": "extended"}

_ROW = ("category", "n_hops", "anchor", "anchor_name", "question_text", "ids", "names", "single", "number", "context", "path", "bio_term", "kin_term", "has_override", "size", "kind")


def _rows(df: DataFrame, category: int, **values: Column) -> DataFrame:
    """df (anchor, anchor_name and whatever values use) with the columns of a candidate."""
    null = {"number": "long", "path": "string", "bio_term": "string", "kin_term": "string", "kind": "string"}
    base = {n: F.lit(None).cast(t) for n, t in null.items()} | {"category": F.lit(category), "has_override": F.lit(False), "anchor": F.col("anchor"), "anchor_name": F.col("anchor_name")}
    return df.select(*[(base | values)[n].alias(n) for n in _ROW])


def _anchored(df: DataFrame, people: DataFrame) -> DataFrame:
    return df.join(people.select(F.col("id").alias("anchor"), F.col("name").alias("anchor_name")), "anchor")


def _relatives(edges: DataFrame, people: DataFrame, preds: list[str]) -> DataFrame:
    """anchor, anchor_name, pred, names and ids (by name) of each person's relatives."""
    df = edges.filter(F.col("pred").isin(*preds)).select("src", "pred", "dst").distinct().join(people.select(F.col("id").alias("dst"), "name"), "dst")
    df = df.groupBy(F.col("src").alias("anchor"), "pred").agg(F.sort_array(F.collect_list(F.struct("name", "dst"))).alias("t"))
    return _anchored(df.select("anchor", "pred", F.col("t.name").alias("names"), F.col("t.dst").alias("ids")), people)


def _asked(pattern: Column) -> Column:
    return F.replace(pattern, F.lit("{name}"), F.col("anchor_name"))


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def fact_rows(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Category 1: direct facts."""
    t = edges.sparkSession.createDataFrame(Q.FACTS, "pred string, q string, kind string")
    df = _relatives(edges, people, [p for p, *_ in Q.FACTS]).join(F.broadcast(t), "pred")
    one, word, all_ = F.col("kind") == "person", predicate_words(F.col("pred")), F.array_join("names", ", ")
    context = F.when(one, _said(F.col("anchor_name"), "'s ", word, " is ", F.col("names")[0], ".")).otherwise(_said(F.col("anchor_name"), " has the following ", word, "s: ", all_, "."))
    return _rows(df, 1, n_hops=F.lit(1), question_text=_asked(F.col("q")), ids=F.col("ids"), names=F.col("names"), single=one, context=context, path=F.col("pred"), bio_term=word, size=F.lit(2).cast("long"), kind=F.lit("fact"))


def constraint_rows(edges: DataFrame, people: DataFrame, strict: bool = False) -> DataFrame:
    """Category 3: counts and filters; grandchildren are counted by way. strict gives brothers as the answer about sisters too."""
    spark, none = edges.sparkSession, F.array().cast("array<int>")
    all_ = F.array_join("names", ", ")
    size = (F.size("names") + 2).cast("long")
    counts = spark.createDataFrame([(p, q, f" has {w}: ") for (p, q), w in zip(Q.COUNTS, ("children", "siblings"))], "pred string, q string, has string")
    df = _relatives(edges, people, [p for p, _ in Q.COUNTS]).join(F.broadcast(counts), "pred")
    out = [_rows(df, 3, n_hops=F.lit(1), question_text=_asked(F.col("q")), ids=none, names=F.col("names"), single=F.lit(False), number=F.size("names").cast("long"), context=_said(F.col("anchor_name"), F.col("has"), all_, "."), size=size, kind=F.lit("count"))]
    child = edges.filter("pred = 'hasChild'").select("src", "dst").distinct()
    grand = child.select(F.col("src").alias("anchor"), F.col("dst").alias("mid")).join(child.select(F.col("src").alias("mid"), "dst"), "mid").join(people.select(F.col("id").alias("dst"), "name"), "dst").groupBy("anchor").agg(F.sort_array(F.collect_list("name")).alias("grand"))
    df = _relatives(edges, people, ["hasChild"]).join(grand, "anchor")
    context = _said(F.col("anchor_name"), "'s children are: ", all_, ". Their children include: ", F.array_join("grand", ", "), ".")
    out.append(_rows(df, 3, n_hops=F.lit(2), question_text=_asked(F.lit("How many grandchildren does {name} have?")), ids=none, names=F.col("grand"), single=F.lit(False), number=F.size("grand").cast("long"), context=context, size=(F.size("grand") + 2).cast("long"), kind=F.lit("count")))
    filters = spark.createDataFrame([(p, "hasBrother" if strict and p == "hasSister" else p, q, w, g) for (p, q), w, g in zip(Q.FILTERS, ("siblings", "siblings", "children", "children"), ("hasSibling", "hasSibling", "hasChild", "hasChild"))], "asked string, pred string, q string, word string, whole string")
    some = _relatives(edges, people, [p for p, _ in Q.FILTERS]).join(F.broadcast(filters), "pred")
    whole = _relatives(edges, people, ["hasSibling", "hasChild"]).select("anchor", F.col("pred").alias("whole"), F.col("names").alias("everyone"))
    df = some.join(whole, ["anchor", "whole"])
    out.append(_rows(df, 3, n_hops=F.lit(1), question_text=_asked(F.col("q")), ids=none, names=F.col("names"), single=F.lit(False), context=_said(F.col("anchor_name"), "'s ", F.col("word"), " are: ", F.array_join("everyone", ", "), "."), size=size, kind=F.lit("filter")))
    return reduce(DataFrame.unionByName, out)


def path_rows(edges: DataFrame, people: DataFrame, wanted: list[str]) -> DataFrame:
    """anchor, anchor_name, path, hops, names, ids, context, size for every anchor and path that reaches someone else. Paths share their prefixes, and the edges walked give both the ends and the contexts."""
    walked = written(P.walk(edges, people, wanted))
    ends = walked.filter(F.col("prefix").isin(*wanted)).select("anchor", F.col("prefix").alias("path"), "dst").distinct().filter("anchor <> dst")
    ends = ends.join(people.select(F.col("id").alias("dst"), "name"), "dst").groupBy("anchor", "path").agg(F.sort_array(F.collect_list(F.struct("name", "dst"))).alias("t"))
    df = ends.join(P.contexts(walked, people, wanted), ["anchor", "path"])
    hops = F.size(F.split("path", r"\."))
    return _anchored(df.select("anchor", "path", hops.alias("hops"), F.col("t.name").alias("names"), F.col("t.dst").alias("ids"), "context", "size"), people)


def path_ends(edges: DataFrame, people: DataFrame, wanted: list[str]) -> DataFrame:
    """path_rows() with null context and size, for questions that are sampled first: with_contexts() walks for those that are left."""
    found = P.traverse_coded(edges, people, wanted).filter("anchor <> node")
    ends = found.join(people.select(F.col("id").alias("node"), "name"), "node").groupBy("anchor", "code").agg(F.sort_array(F.collect_list(F.struct("name", F.col("node").alias("dst")))).alias("t"))
    df = P.named(ends, wanted)
    return _anchored(df.select("anchor", "path", F.size(F.split("path", r"\.")).alias("hops"), F.col("t.name").alias("names"), F.col("t.dst").alias("ids"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("long").alias("size")), people)


def with_contexts(rows: DataFrame, edges: DataFrame, people: DataFrame, wanted: list[str]) -> DataFrame:
    """rows (anchor, path) with their contexts and sizes, as path_rows() has them."""
    rows = written(rows)
    walked = written(P.walk(edges, rows.select(F.col("anchor").alias("id")).distinct(), wanted))
    return rows.drop("context", "size").join(P.contexts(walked, people, wanted), ["anchor", "path"])


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each question text (and by): the shortest, then first path, then anchor."""
    order = Window.partitionBy("question_text", *by).orderBy("n_hops", "path", "anchor")
    return rows.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def multi_hop_rows(found: DataFrame, system: str, extended: bool = False, strict: bool = False) -> DataFrame:
    """Category 2 from path_rows(): biological terms; a text comes once for each number of hops."""
    df = K.resolve_terms(found.drop("hops").withColumn("system", F.lit(system)), found.sparkSession, extended, strict)
    one = F.size("names") == 1
    text = F.when(one, _said("Who is ", F.col("anchor_name"), "'s ", F.col("bio_term"), "?")).otherwise(_said("Who are ", F.col("anchor_name"), "'s ", plural(F.col("bio_term")), "?"))
    return _first(_rows(df, 2, n_hops=F.col("hops"), question_text=text, ids=F.col("ids"), names=F.col("names"), single=one, context=F.col("context"), path=F.col("path"), bio_term=F.col("bio_term"), kin_term=F.col("kin_term"), has_override=F.col("has_override"), size=F.col("size"), kind=F.lit("multi_hop")), "n_hops")


def override_rows(found: DataFrame, system: str, extended: bool = False, strict: bool = False) -> DataFrame:
    """Category 4 from path_rows(): three ways of asking about each overridden path; systems without overrides are asked descriptively."""
    label, me, one = F.lit(system.capitalize()), F.col("anchor_name"), F.size("names") == 1
    df = K.resolve_terms(found.drop("hops").withColumn("system", F.lit(system)), found.sparkSession, extended, strict)
    common = {"n_hops": F.col("hops"), "ids": F.col("ids"), "context": F.col("context"), "path": F.col("path"), "bio_term": F.col("bio_term"), "size": F.col("size")}
    if system in K.WESTERN:
        text = _said("In the ", label, " (descriptive) system, ", F.when(one, _said("who is specifically ", me, "'s ", F.col("bio_term"))).otherwise(_said("who are specifically ", me, "'s ", plural(F.col("bio_term")))), "?")
        return _first(_rows(df, 4, question_text=text, names=F.col("names"), single=one, kind=F.lit("descriptive"), **common))
    term, s, who = F.col("kin_term"), F.when(one, "").otherwise("s"), F.array_join("names", ", ")
    ways = (
        ("cultural_term", _said("In the ", label, " kinship system, ", F.when(one, "who is ").otherwise("who are "), me, "'s ", term, s, "?")),
        ("disambiguation", _said("In the ", label, " system, ", who, F.when(one, " is called ").otherwise(" are called "), me, "'s '", term, s, "'. What is their actual biological relationship?")),
        ("comparison", _said("List all of ", me, "'s ", term, "s according to the ", label, " system.")),
    )
    df = df.filter("has_override").withColumn("way", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in ways])))
    return _first(_rows(df, 4, question_text=F.col("way.text"), names=F.col("names"), single=one | (F.col("way.kind") == "disambiguation"), kin_term=term, has_override=F.lit(True), kind=F.col("way.kind"), **common), "n_hops")


def candidates(edges: DataFrame, people: DataFrame, system: str, quotas: tuple = QUOTAS, strict: bool = False) -> DataFrame:
    """All questions that quotas can ask for; more than six hops have no terms."""
    hops = {h for c, h, _ in quotas if c in (2, 4)}
    extended = max(hops) > 4
    wanted = [p for p in K.paths(extended, strict) if p.count(".") + 1 in hops]
    found = written(path_rows(edges, people, wanted))
    return fact_rows(edges, people).unionByName(constraint_rows(edges, people, strict)).unionByName(multi_hop_rows(found, system, extended, strict)).unionByName(override_rows(found, system, extended, strict))


def sampled(rows: DataFrame, system: str, quotas: tuple = QUOTAS, seed: int = 42, first: int = 1) -> DataFrame:
    """The first rows of each quota's stratum by a seeded hash of the question, with question_id: <system>_0001 and on, by category and hops.

    The rank limit is applied before the rows of a stratum meet; ids are a stratum's offset plus the rank, so no window spans all rows."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(c, h or 0, n) for c, h, n in quotas], "category int, stratum int, quota int")
    stratum = F.when(F.col("category").isin(2, 4), F.col("n_hops")).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("category", "stratum").orderBy(F.md5(_said(f"{seed}|", F.col("question_text"))), "question_text", "path"))
    kept = rows.withColumn("stratum", stratum).withColumn("rank", rank).filter(F.col("rank") <= max(n for *_, n in quotas))
    kept = written(kept.join(F.broadcast(table), ["category", "stratum"]).filter("rank <= quota"))
    sizes = kept.groupBy("category", "stratum").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("category", "stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("before", before).select("category", "stratum", "before")  # one row a stratum
    return kept.join(F.broadcast(offsets), ["category", "stratum"]).withColumn("question_id", F.format_string(f"{system}_%04d", F.col("before") + F.col("rank") + (first - 1))).drop("stratum", "quota", "before")


def as_questions(rows: DataFrame, system: str) -> DataFrame:
    """sampled() rows in the question schema."""
    iri = lambda x: F.concat(F.lit("person_"), x.cast("string"))
    preds = F.create_map(*[F.lit(x) for kv in K.PREDICATES.items() for x in kv])
    path = F.when(F.col("category") == 1, F.array("path")).when(F.col("path").isNotNull(), F.transform(F.split("path", r"\."), lambda c: preds[c]))
    answer = F.when(F.col("kind") == "disambiguation", F.array("bio_term")).otherwise(F.col("names"))
    return rows.select(
        "question_id", "question_text", "category", "n_hops", F.lit(system).alias("kinship_system"), iri(F.col("anchor")).alias("anchor_person"), "anchor_name", F.transform("ids", iri).alias("target_persons"), F.col("names").alias("target_names"),
        F.when(F.col("number").isNotNull(), F.col("number").cast("variant")).otherwise(truth(answer, F.col("single"))).alias("ground_truth"), "context", path.alias("path"), "bio_term", "kin_term", F.col("has_override").alias("has_cultural_override"), F.col("size").cast("int").alias("proof_graph_size"),
    )


def generate(edges: DataFrame, people: DataFrame, system: str, quotas: tuple = QUOTAS, seed: int = 42, strict: bool = False) -> DataFrame:
    """A system's question set, in the question schema."""
    return as_questions(sampled(candidates(edges, people, system, quotas, strict), system, quotas, seed), system)


def further(edges: DataFrame, people: DataFrame, system: str, hops: tuple[int, ...] = (4,), count: int = FOUR_HOP_COUNT, first: int = FOUR_HOP_IDS, seed: int = 42, strict: bool = False) -> DataFrame:
    """Up to count further override questions for each number of hops, with ids from first on; none of a system without overrides. strict leaves out the rules of four hops whose paths have no term."""
    known = K.paths(True, strict)
    mine = sorted({p for s, p, *_ in K.overrides(True) if s == system and p.count(".") + 1 in hops and p in known})
    if not mine:
        return candidates_none(edges, people, system)
    rows = override_rows(path_ends(edges, people, mine), system, True, strict)
    rows = with_contexts(sampled(rows, system, tuple((4, h, count) for h in hops), seed, first), edges, people, mine)
    return as_questions(rows, system)


def further_of_all(graphs: dict[tuple[str, str], tuple[DataFrame, DataFrame]], seed: int = 42, strict: bool = False) -> DataFrame:
    """Further questions of 5 and 6 hops of every system that has overrides, each from its own graph: graphs holds (edges, people) by (system, time span); a system whose graph isn't there is an error."""
    parts = []
    for system, span in LONG_HOP_GRAPH.items():
        if (system, span) not in graphs:
            raise ValueError(f"{system} needs its graph of {span}")
        edges, people = graphs[system, span]
        parts.append(further(edges, people, system, (5, 6), LONG_HOP_COUNT, LONG_HOP_IDS, seed, strict))
    return reduce(DataFrame.unionByName, parts)


def path_label(path: Column) -> Column:
    """A path's predicates (an array) as one text, joined by slashes."""
    return F.concat_ws("/", path)


def candidates_none(edges: DataFrame, people: DataFrame, system: str) -> DataFrame:
    """An empty question set."""
    empty = fact_rows(edges.limit(0), people.limit(0)).withColumn("question_id", F.lit(""))
    return as_questions(empty, system).limit(0)


def augmented(base: DataFrame, more: DataFrame) -> DataFrame:
    """base with the questions of more whose ids it lacks; without any, base as it is."""
    return base.unionByName(more.join(base.select("question_id").distinct(), "question_id", "left_anti"), allowMissingColumns=True)


def funnel(edges: DataFrame, people: DataFrame, system: str, wanted: list[str]) -> DataFrame:
    """hops, asked (anchors times paths), reached (someone else), kept (one for each text): how many multi-hop candidates each step leaves."""
    found = written(path_ends(edges, people, wanted))
    spark = edges.sparkSession
    n = people.count()
    asked = spark.createDataFrame([(p.count(".") + 1,) for p in wanted], "hops int").groupBy("hops").agg((F.count("*") * n).alias("asked"))
    reached = found.groupBy("hops").agg(F.count("*").alias("reached"))
    kept = multi_hop_rows(found, system, True).groupBy(F.col("n_hops").alias("hops")).agg(F.count("*").alias("kept"))
    return asked.join(reached, "hops", "left").join(kept, "hops", "left").select("hops", "asked", F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce("kept", F.lit(0)).alias("kept"))
