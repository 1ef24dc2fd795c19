"""Turtle graphs: statements as triples, typed views of family graphs, and a writer.

A file is read in statement blocks (they end with a full stop at a line's end), so one large graph
is split over tasks; all parsing is in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem

#: The namespaces of family graphs.
PREFIXES = {
    "family": "http://example.org/family/",
    "kin": "http://example.org/kinship/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "person": "http://example.org/person/",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
#: A literal with its type or language, an address, a comment, a separator, or a name.
_TOKEN = r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|\^\^[^\s;,]+|@[A-Za-z-]+)?|<[^>]*>|#[^\n]*|[;,]|[^\s;,"<]+'
_MARK = "\x01"


def _compact(token: Column) -> Column:
    """<address> -> prefix:name where the namespace is known."""
    out = token
    for prefix, space in PREFIXES.items():
        out = F.when(token.startswith(f"<{space}"), F.concat(F.lit(f"{prefix}:"), F.substring(token, len(space) + 2, 2147483647).substr(F.lit(1), F.length(token) - len(space) - 2))).otherwise(out)
    return out


def _bindings(spark: SparkSession, path: str) -> DataFrame:
    """file, bound: what the prefixes of each file stand for where that isn't what PREFIXES says: "family:" for a known namespace, "<address" for another. Files that keep to PREFIXES have no row."""
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"^\s*@prefix\s+([^\s:]*):\s*<([^>]*)>", 1).alias("prefix"), F.regexp_extract("value", r"^\s*@prefix\s+([^\s:]*):\s*<([^>]*)>", 2).alias("space"), F.col("value").rlike(r"^\s*@prefix\s").alias("is_prefix"))
    known = F.create_map(*[F.lit(x) for prefix, space in PREFIXES.items() for x in (space, f"{prefix}:")])
    line = line.filter("is_prefix").select("file", "prefix", F.coalesce(F.element_at(known, F.col("space")), F.concat(F.lit("<"), "space")).alias("to")).filter(F.col("to") != F.concat("prefix", F.lit(":")))
    return line.groupBy("file", "prefix").agg(F.min("to").alias("to")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "to"))).alias("bound"))


def _bound(token: Column) -> Column:
    """A token under the prefixes of PREFIXES, by the file's own bindings."""
    to = F.element_at("bound", F.regexp_extract(token, r"^([^\s:<\"]*):", 1))
    local = F.regexp_extract(token, r"^[^:]*:(.*)$", 1)
    moved = F.when(to.endswith(":"), F.concat(to, local)).otherwise(F.concat(to, local, F.lit(">")))
    return F.when(F.col("bound").isNull() | token.startswith("<") | token.startswith('"') | ~token.contains(":"), token).otherwise(F.coalesce(moved, token))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """system (the file's stem), subj, pred, obj, kind (iri or literal), datatype (null for plain literals and numbers) for every triple under path.

    Names stay prefixed, under the prefixes of PREFIXES whatever a file calls them; names in other namespaces that a file binds become addresses; "a" stays as it is, literals are unquoted; comments and @prefix statements go; repeated triples are kept. Statements end lines, and comments that follow something on their line don't end with a full stop; the data source in turtle_format takes those as well."""
    blocks = spark.read.option("lineSep", " .\n").text(path).select(F.col("_metadata.file_path").alias("file"), file_stem(F.col("_metadata.file_path")).alias("system"), F.regexp_replace(F.regexp_replace("value", r"(?m)^\s*#.*$", ""), r"\s*\.?\s*$", "").alias("block"))
    # One row a file that has names of its own; the planner broadcasts it while it is small.
    blocks = blocks.join(_bindings(spark, path), "file", "left")
    blocks = blocks.select("system", "bound", F.filter(F.split("block", r"\.\s*\n(?=\s*(?:@prefix|\S*:))"), lambda b: ~b.rlike(r"^\s*(?:@|\z)")).alias("blocks")).select("system", "bound", F.explode("blocks").alias("block"))
    tokens = blocks.select("system", "bound", F.filter(F.regexp_extract_all("block", F.lit(_TOKEN), 0), lambda x: ~x.startswith("#")).alias("t")).filter(F.size("t") > 2)
    parts = F.split(F.array_join(F.slice("t", 2, F.size("t")), _MARK), f"{_MARK};{_MARK}?")
    rows = tokens.select("system", "bound", F.col("t")[0].alias("subj"), F.explode(parts).alias("part")).select("system", "bound", "subj", F.split("part", _MARK).alias("x"))
    rows = rows.filter(F.size("x") > 1).select("system", "bound", "subj", F.col("x")[0].alias("pred"), F.explode(F.filter(F.slice("x", 2, F.size("x")), lambda o: o != ",")).alias("o"))
    body = F.regexp_extract("o", r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.replace(F.replace(F.replace(F.replace(F.replace(body, F.lit("\\\\"), F.lit("\x02")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\x02"), F.lit("\\"))
    quoted, number = F.col("o").startswith('"'), F.col("o").rlike(r"^[-+]?[0-9][0-9.eE+-]*$")
    # In lambdas, so that each step's result is one value for the next.
    terms = F.transform(F.transform(F.array("subj", "pred", "o", F.regexp_extract("o", r"\^\^(\S+)$", 1)), _bound), _compact)
    return rows.select("system", "o", plain.alias("plain"), quoted.alias("quoted"), number.alias("number"), terms.alias("t")).select(
        "system",
        F.col("t")[0].alias("subj"),
        F.col("t")[1].alias("pred"),
        F.when(F.col("quoted"), F.col("plain")).otherwise(F.col("t")[2]).alias("obj"),
        F.when(F.col("quoted") | F.col("number"), "literal").otherwise("iri").alias("kind"),
        F.when(F.col("quoted"), F.nullif(F.col("t")[3], F.lit(""))).alias("datatype"),
    )


def _address(name: Column) -> Column:
    """prefix:name -> <address>; other names as they are."""
    out = name
    for prefix, space in PREFIXES.items():
        out = F.when(name.startswith(f"{prefix}:"), F.concat(F.lit(f"<{space}"), F.substring(name, len(prefix) + 2, 2147483647), F.lit(">"))).otherwise(out)
    return out


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """value: one statement block a subject, predicates and objects in order, each triple once. Names are written out as addresses, so every file that Spark makes of them can be read on its own."""
    esc = F.replace(F.replace(F.replace(F.col("obj"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    typed = F.when(F.col("datatype").isNotNull(), F.concat(F.lit('"'), esc, F.lit('"^^'), _address(F.col("datatype")))).when(F.col("obj").rlike(r"^[-+]?[0-9]+$"), F.col("obj")).otherwise(F.concat(F.lit('"'), esc, F.lit('"')))
    objects = triples.select("subj", "pred", F.when(F.col("kind") == "literal", typed).otherwise(_address(F.col("obj"))).alias("o")).distinct()
    objects = objects.groupBy("subj", "pred").agg(F.array_join(F.sort_array(F.collect_list("o")), ",\n        ").alias("os"))
    said = F.struct((F.col("pred") != "a").alias("later"), F.concat(F.when(F.col("pred") == "a", "a").otherwise(_address(F.col("pred"))), F.lit(" "), F.col("os")).alias("text"))
    lines = objects.groupBy("subj").agg(F.sort_array(F.collect_list(said)).alias("lines"))
    return lines.select(F.concat(_address(F.col("subj")), F.lit(" "), F.array_join(F.transform("lines", lambda x: x["text"]), " ;\n    "), F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str, files: int | None = None) -> None:
    """subj, pred, obj, kind, datatype as Turtle under path, in so many files (None: as many as there are partitions)."""
    blocks = turtle_blocks(triples)
    (blocks.coalesce(files) if files else blocks).write.mode("overwrite").text(path)


# --- typed views -------------------------------------------------------------------------------


def local_name(iri: Column) -> Column:
    """What follows the last slash, sharp or colon of an address or prefixed name."""
    return F.regexp_replace(F.regexp_extract(iri, r"([^/#:]*)$", 1), ">$", "")


def person_number(iri: Column) -> Column:
    """person:person_7 -> 7; null for anything else."""
    return F.regexp_extract(iri, r"person_([0-9]+)>?$", 1).try_cast("int")


def persons(triples: DataFrame) -> DataFrame:
    """system, id, iri, name, sex (M, F or unknown), father_id, mother_id, spouse_id, clan, born: one row for each subject of type Person; the other columns are null where the graph says nothing."""
    who = triples.filter("pred = 'a' and obj = 'family:Person'").select("system", F.col("subj").alias("iri")).distinct()
    said = lambda pred: F.min(F.when(F.col("pred") == pred, F.col("obj")))
    facts = triples.groupBy("system", F.col("subj").alias("iri")).agg(
        F.min(F.when((F.col("pred") == "a") & F.col("obj").isin("family:Male", "family:Female"), F.when(F.col("obj") == "family:Male", "M").otherwise("F"))).alias("sex"),
        said("rdfs:label").alias("label"), said("family:hasFather").alias("f"), said("family:hasMother").alias("m"), said("family:hasSpouse").alias("s"), said("family:belongsToClan").alias("clan"), said("family:yearOfBirth").alias("born"),
    )
    df = who.join(facts, ["system", "iri"], "left")
    return df.select("system", person_number(F.col("iri")).alias("id"), "iri", F.coalesce("label", local_name(F.col("iri"))).alias("name"), F.coalesce("sex", F.lit("unknown")).alias("sex"), person_number(F.col("f")).alias("father_id"), person_number(F.col("m")).alias("mother_id"), person_number(F.col("s")).alias("spouse_id"), local_name(F.col("clan")).alias("clan"), F.col("born").try_cast("int").alias("born"))


def edges(triples: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """system, src, pred (without prefix), dst: the relations between persons; an object that isn't a known person makes no edge."""
    known = (persons(triples) if people is None else people).select("system", F.col("id").alias("dst"))
    df = triples.filter("kind = 'iri' and pred <> 'a'").select("system", person_number(F.col("subj")).alias("src"), local_name(F.col("pred")).alias("pred"), person_number(F.col("obj")).alias("dst"))
    return df.filter("src is not null and dst is not null").distinct().join(known, ["system", "dst"], "left_semi").select("system", "src", "pred", "dst")


def clan_triples(members: DataFrame, system: str) -> DataFrame:
    """id, clan (number) as triples: belongsToClan of each person, and each clan's type."""
    kind = "matriclan" if system == "crow" else "patriclan"
    iri = F.concat(F.lit(f"family:{kind}_"), F.col("clan").cast("string"))
    belongs = members.select(F.concat(F.lit("person:person_"), F.col("id").cast("string")).alias("subj"), F.lit("family:belongsToClan").alias("pred"), iri.alias("obj"))
    types = members.select(iri.alias("subj")).distinct().select("subj", F.lit("a").alias("pred"), F.lit("family:Clan").alias("obj"))
    return belongs.unionByName(types).withColumns({"kind": F.lit("iri"), "datatype": F.lit(None).cast("string")})


def person_triples(people: DataFrame) -> DataFrame:
    """id, sex, first_name, surname, born as triples: the types, the names, the label "First Last" and the year of birth; null facts are left out."""
    fact = lambda pred, obj, kind="literal", datatype=None: F.struct(F.lit(pred).alias("pred"), obj.cast("string").alias("obj"), F.lit(kind).alias("kind"), F.lit(datatype).cast("string").alias("datatype"))
    all_ = F.array(
        fact("a", F.lit("family:Person"), "iri"),
        fact("a", F.when(F.col("sex") == "M", "family:Male").when(F.col("sex") == "F", "family:Female"), "iri"),
        fact("family:firstName", F.col("first_name"), datatype="xsd:string"),
        fact("family:surname", F.col("surname"), datatype="xsd:string"),
        fact("rdfs:label", F.concat("first_name", F.lit(" "), "surname")),
        fact("family:yearOfBirth", F.col("born")),
    )
    return people.select(F.concat(F.lit("person:person_"), F.col("id").cast("string")).alias("subj"), F.explode(F.filter(all_, lambda x: x["obj"].isNotNull())).alias("x")).select("subj", "x.*")


def edge_triples(found: DataFrame, prefix: str = "family") -> DataFrame:
    """src, pred, dst as triples."""
    iri = lambda c: F.concat(F.lit("person:person_"), F.col(c).cast("string"))
    return found.select(iri("src").alias("subj"), F.concat(F.lit(f"{prefix}:"), F.col("pred")).alias("pred"), iri("dst").alias("obj"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"))


#: The vocabulary that every graph declares, and that of some systems, with labels.
CLASSES = {"Person": "Person", "Male": "Male", "Female": "Female", "Marriage": "Marriage", "Clan": "Clan"}
FACTS = {"firstName": ("first name", "xsd:string"), "surname": ("surname", "xsd:string"), "yearOfBirth": ("year of birth", "xsd:integer")}
RELATIONS = {
    "hasFather": "has father",
    "hasMother": "has mother",
    "hasParent": "has parent",
    "hasChild": "has child",
    "hasSon": "has son",
    "hasDaughter": "has daughter",
    "hasSibling": "has sibling",
    "hasBrother": "has brother",
    "hasSister": "has sister",
    "hasSpouse": "has spouse",
    "hasHusband": "has husband",
    "hasWife": "has wife",
    "hasCousin": "has cousin",
    "hasUncle": "has uncle",
    "hasAunt": "has aunt",
    "hasNephew": "has nephew",
    "hasNiece": "has niece",
    "hasGrandparent": "has grandparent",
    "hasGrandfather": "has grandfather",
    "hasGrandmother": "has grandmother",
    "hasGrandchild": "has grandchild",
    "hasMaternalGrandfather": "has maternal grandfather",
    "hasMaternalGrandmother": "has maternal grandmother",
    "hasPaternalGrandfather": "has paternal grandfather",
    "hasPaternalGrandmother": "has paternal grandmother",
    "hasMaternalUncle": "has maternal uncle (mother's brother)",
    "hasMaternalAunt": "has maternal aunt (mother's sister)",
    "hasPaternalUncle": "has paternal uncle (father's brother)",
    "hasPaternalAunt": "has paternal aunt (father's sister)",
}
KIN_RELATIONS = {
    "hasClassificatoryParent": "has classificatory parent",
    "hasClassificatorySibling": "has classificatory sibling",
    "hasCrossCousin": "has cross-cousin",
    "hasParallelCousin": "has parallel cousin",
    "hasCrossAunt": "has cross-aunt (father's sister)",
    "hasCrossUncle": "has cross-uncle (mother's brother)",
    "hasPotentialSpouse": "has potential spouse (cross-cousin)",
    "hasAffinalRelative": "has affinal relative",
    "hasMama": "has Mama (mother's brother)",
    "hasAthai": "has Athai (father's sister)",
    "sameMatriclan": "same matriclan",
    "fathersMatriclan": "father's matriclan",
    "samePatriclan": "same patriclan",
    "mothersPatriclan": "mother's patriclan",
    "hasSkewedGeneration": "has skewed generation relationship",
}
KIN_OF = {
    "hawaiian": ("hasClassificatoryParent", "hasClassificatorySibling"),
    "iroquois": ("hasClassificatoryParent", "hasClassificatorySibling", "hasCrossCousin", "hasParallelCousin", "hasCrossAunt", "hasCrossUncle"),
    "dravidian": ("hasClassificatoryParent", "hasClassificatorySibling", "hasCrossCousin", "hasParallelCousin", "hasCrossAunt", "hasCrossUncle", "hasPotentialSpouse", "hasAffinalRelative", "hasMama", "hasAthai"),
    "crow": ("sameMatriclan", "fathersMatriclan", "hasSkewedGeneration"),
    "omaha": ("samePatriclan", "mothersPatriclan", "hasSkewedGeneration"),
}


def vocabulary(spark: SparkSession, system: str) -> DataFrame:
    """subj, pred, obj, kind, datatype: the classes and properties that a system's graph declares."""
    rows = []
    for name, label in CLASSES.items():
        rows += [(f"family:{name}", "a", "owl:Class", "iri"), (f"family:{name}", "rdfs:label", label, "literal")]
    for name, (label, kind) in FACTS.items():
        rows += [(f"family:{name}", "a", "owl:DatatypeProperty", "iri"), (f"family:{name}", "rdfs:label", label, "literal"), (f"family:{name}", "rdfs:range", kind, "iri")]
    for name, label in RELATIONS.items():
        rows += [(f"family:{name}", "a", "owl:ObjectProperty", "iri"), (f"family:{name}", "rdfs:label", label, "literal"), (f"family:{name}", "rdfs:domain", "family:Person", "iri"), (f"family:{name}", "rdfs:range", "family:Person", "iri")]
    for name in KIN_OF.get(system, ()):
        rows += [(f"kin:{name}", "a", "owl:ObjectProperty", "iri"), (f"kin:{name}", "rdfs:label", KIN_RELATIONS[name], "literal")]
    return spark.createDataFrame([(*r, None) for r in rows], "subj string, pred string, obj string, kind string, datatype string")
