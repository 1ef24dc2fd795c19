"""Kinship vocabulary: path codes, biological terms and per-system overrides as DataFrames.

Paths are written as codes joined by dots: F father, M mother, B brother, Z sister, C child,
Sb sibling, Sp spouse, S son, D daughter; the number of codes is the number of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code -> predicate.
PREDICATES = {"F": "hasFather", "M": "hasMother", "B": "hasBrother", "Z": "hasSister", "C": "hasChild", "Sb": "hasSibling", "Sp": "hasSpouse", "S": "hasSon", "D": "hasDaughter"}
SYSTEMS = ("eskimo", "sudanese", "hawaiian", "iroquois", "dravidian", "crow", "omaha")
WESTERN = ("eskimo", "sudanese")

#: The biological term of each base path.
BIO_PATHS = {
    "F": "father", "M": "mother", "Sb": "sibling", "B": "brother", "Z": "sister", "Sp": "spouse", "C": "child", "S": "son", "D": "daughter",
    "F.F": "paternal grandfather", "F.M": "paternal grandmother", "M.F": "maternal grandfather", "M.M": "maternal grandmother",
    "F.B": "paternal uncle (FB)", "F.Z": "paternal aunt (FZ)", "M.B": "maternal uncle (MB)", "M.Z": "maternal aunt (MZ)",
    "F.B.C": "father's brother's child (FBC)", "F.Z.C": "father's sister's child (FZC)", "M.B.C": "mother's brother's child (MBC)", "M.Z.C": "mother's sister's child (MZC)",
    "F.F.F": "paternal great-grandfather", "F.F.M": "paternal great-grandmother", "M.M.M": "maternal great-grandmother", "M.M.F": "maternal great-grandfather",
    "F.B.C.C": "paternal uncle's grandchild", "M.Z.C.C": "maternal aunt's grandchild", "F.F.B.C": "father's paternal uncle's child", "M.M.Z.C": "mother's maternal aunt's child",
    "F.F.B.C.C": "father's paternal uncle's grandchild", "M.M.Z.C.C": "mother's maternal aunt's grandchild",
    "F.M.B.C.C": "paternal grandmother's brother's grandchild", "M.F.Z.C.C": "maternal grandfather's sister's grandchild",
    "F.F.B.C.C.C": "father's paternal uncle's great-grandchild", "M.M.Z.C.C.C": "mother's maternal aunt's great-grandchild",
    "F.F.B.C.B.C": "grandfather's brother's grandchild's nephew's child", "M.M.Z.C.Z.C": "grandmother's sister's grandchild's niece's child",
}

#: Terms of further paths of four to six hops, used where a base path has none.
EXTRA_PATHS = {
    "F.Z.C.C": "paternal aunt's grandchild", "M.B.C.C": "maternal uncle's grandchild", "F.F.Z.C": "father's paternal aunt's child", "M.M.B.C": "mother's maternal uncle's child",
    "F.F.F.B.C": "great-grandfather's brother's child", "M.M.M.Z.C": "great-grandmother's sister's child",
    "F.B.C.C.C": "paternal uncle's great-grandchild", "M.Z.C.C.C": "maternal aunt's great-grandchild", "F.Z.C.C.C": "paternal aunt's great-grandchild",
    "F.F.Z.C.C": "father's paternal aunt's grandchild", "M.B.C.C.C": "maternal uncle's great-grandchild", "M.M.B.C.C": "mother's maternal uncle's grandchild",
    "F.F.F.B.C.C": "great-grandfather's brother's grandchild", "M.M.M.Z.C.C": "great-grandmother's sister's grandchild",
    "F.Z.C.C.C.C": "paternal aunt's great-great-grandchild", "F.F.Z.C.C.C": "father's paternal aunt's great-grandchild",
    "F.B.C.C.C.C": "paternal uncle's great-great-grandchild", "M.B.C.C.C.C": "maternal uncle's great-great-grandchild",
    "M.M.B.C.C.C": "mother's maternal uncle's great-grandchild", "M.Z.C.C.C.C": "maternal aunt's great-great-grandchild",
}
#: The four-hop terms that the strict mode leaves out, so that their overrides never apply.
STRICT_MISSING = ("F.Z.C.C", "M.B.C.C", "F.F.Z.C", "M.M.B.C")

_PARALLEL = "parallel cousin (classificatory sibling)"
_NIECE = "parallel niece/nephew (classificatory)"
_CP, _CS, _PC, _CC = "kin:hasClassificatoryParent", "kin:hasClassificatorySibling", "kin:hasParallelCousin", "kin:hasCrossCousin"
_SK, _NN, _GC, _GP, _CH = "kin:hasSkewedGeneration", "kin:hasParallelNieceNephew", "kin:hasClassificatoryGrandchild", "kin:hasClassificatoryGrandparent", "kin:hasClassificatoryChild"
_LINE_M, _LINE_P = "father/female father (skewed - same matrilineage)", "mother/male mother (skewed - same patrilineage)"

#: System -> path -> (term, predicate).
OVERRIDES = {
    "hawaiian": {
        "F.B": ("classificatory father", _CP), "F.Z": ("classificatory mother", _CP), "M.B": ("classificatory father", _CP), "M.Z": ("classificatory mother", _CP),
        "F.B.C": ("classificatory sibling", _CS), "F.Z.C": ("classificatory sibling", _CS), "M.B.C": ("classificatory sibling", _CS), "M.Z.C": ("classificatory sibling", _CS),
    },
    "iroquois": {
        "F.B": ("classificatory father", _CP), "M.Z": ("classificatory mother", _CP), "F.Z": ("cross-aunt", "kin:hasCrossAunt"), "M.B": ("cross-uncle", "kin:hasCrossUncle"),
        "F.B.C": (_PARALLEL, _PC), "M.Z.C": (_PARALLEL, _PC), "F.Z.C": ("cross-cousin", _CC), "M.B.C": ("cross-cousin", _CC),
    },
    "dravidian": {
        "F.B": ("classificatory father (Periyappa/Chithappa)", _CP), "M.Z": ("classificatory mother (Chitti/Periyamma)", _CP),
        "F.Z": ("Athai (potential mother-in-law)", "kin:hasAthai"), "M.B": ("Mama (potential father-in-law)", "kin:hasMama"), "F.B.C": (_PARALLEL, _PC), "M.Z.C": (_PARALLEL, _PC),
        "F.Z.C": ("cross-cousin (potential spouse)", "kin:hasPotentialSpouse"), "M.B.C": ("cross-cousin (potential spouse)", "kin:hasPotentialSpouse"),
    },
    "crow": {
        "F.B": ("classificatory father", _CP), "M.Z": ("classificatory mother", _CP), "F.Z": ("female father (skewed generation)", _SK),
        "F.Z.C": ("father/female father (skewed - same as FZ)", _SK), "M.B": ("cross-uncle", "kin:hasCrossUncle"), "M.B.C": ("cross-cousin", _CC),
    },
    "omaha": {
        "F.B": ("classificatory father", _CP), "M.Z": ("classificatory mother", _CP), "M.B": ("male mother (skewed generation)", _SK),
        "M.B.C": ("mother/male mother (skewed - same as MB)", _SK), "F.Z": ("cross-aunt", "kin:hasCrossAunt"), "F.Z.C": ("cross-cousin", _CC),
    },
}

#: The overrides of paths of four hops.
OVERRIDES_4 = {
    "hawaiian": {"F.B.C.C": ("classificatory child", _CH), "M.Z.C.C": ("classificatory child", _CH), "F.F.B.C": ("classificatory father", _CP), "M.M.Z.C": ("classificatory mother", _CP)},
    "iroquois": {"F.B.C.C": (_NIECE, _NN), "M.Z.C.C": (_NIECE, _NN), "F.F.B.C": ("classificatory father", _CP), "M.M.Z.C": ("classificatory mother", _CP)},
    "dravidian": {"F.B.C.C": (_NIECE, _NN), "M.Z.C.C": (_NIECE, _NN), "F.F.B.C": ("classificatory father (Periyappa/Chithappa)", _CP), "M.M.Z.C": ("classificatory mother (Chitti/Periyamma)", _CP)},
    "crow": {"F.Z.C.C": (_LINE_M, _SK), "F.B.C.C": ("classificatory niece/nephew", "kin:hasClassificatoryNieceNephew"), "F.F.Z.C": ("father/female father (skewed)", _SK)},
    "omaha": {"M.B.C.C": (_LINE_P, _SK), "M.Z.C.C": ("classificatory niece/nephew", "kin:hasClassificatoryNieceNephew"), "M.M.B.C": ("mother/male mother (skewed)", _SK)},
}

#: The overrides of paths of five and six hops.
OVERRIDES_56 = {
    "hawaiian": {
        "F.F.B.C.C": ("classificatory sibling", _CS), "M.M.Z.C.C": ("classificatory sibling", _CS), "F.F.F.B.C": ("classificatory grandparent", _GP), "M.M.M.Z.C": ("classificatory grandparent", _GP),
        "F.B.C.C.C": ("classificatory grandchild", _GC), "M.Z.C.C.C": ("classificatory grandchild", _GC), "F.F.B.C.C.C": ("classificatory child", _CH), "M.M.Z.C.C.C": ("classificatory child", _CH),
        "F.F.F.B.C.C": ("classificatory parent", _CP), "M.M.M.Z.C.C": ("classificatory parent", _CP),
    },
    "iroquois": {
        "F.F.B.C.C": (_PARALLEL, _PC), "M.M.Z.C.C": (_PARALLEL, _PC), "F.F.F.B.C": ("classificatory paternal grandfather (parallel)", _GP), "M.M.M.Z.C": ("classificatory maternal grandmother (parallel)", _GP),
        "F.F.B.C.C.C": (_NIECE, _NN), "M.M.Z.C.C.C": (_NIECE, _NN), "F.F.F.B.C.C": ("classificatory father (parallel)", _CP), "M.M.M.Z.C.C": ("classificatory mother (parallel)", _CP),
    },
    "dravidian": {
        "F.F.B.C.C": (_PARALLEL, _PC), "M.M.Z.C.C": (_PARALLEL, _PC),
        "F.F.F.B.C": ("classificatory paternal grandfather (parallel, Periya-Thatha)", _GP), "M.M.M.Z.C": ("classificatory maternal grandmother (parallel, Periya-Patti)", _GP),
        "F.F.B.C.C.C": (_NIECE, _NN), "M.M.Z.C.C.C": (_NIECE, _NN),
        "F.F.F.B.C.C": ("classificatory father (parallel, Periyappa/Chithappa)", _CP), "M.M.M.Z.C.C": ("classificatory mother (parallel, Chitti/Periyamma)", _CP),
    },
    "crow": {
        "F.Z.C.C.C": (_LINE_M, _SK), "F.F.Z.C.C": ("father/female father (skewed - FFZ matrilineage)", _SK), "F.B.C.C.C": ("classificatory grandchild (parallel)", _GC),
        "F.Z.C.C.C.C": (_LINE_M, _SK), "F.F.Z.C.C.C": ("father/female father (skewed - FFZ matrilineage)", _SK), "F.B.C.C.C.C": ("classificatory great-grandchild (parallel)", _GC),
    },
    "omaha": {
        "M.B.C.C.C": (_LINE_P, _SK), "M.M.B.C.C": ("mother/male mother (skewed - MMB patrilineage)", _SK), "M.Z.C.C.C": ("classificatory grandchild (parallel)", _GC),
        "M.B.C.C.C.C": (_LINE_P, _SK), "M.M.B.C.C.C": ("mother/male mother (skewed - MMB patrilineage)", _SK), "M.Z.C.C.C.C": ("classificatory great-grandchild (parallel)", _GC),
    },
}


def paths(extended: bool = False, strict: bool = False) -> dict[str, str]:
    """Path -> biological term; extended adds the further paths, strict leaves out the four that have overrides but no term."""
    extra = {p: t for p, t in EXTRA_PATHS.items() if not (strict and p in STRICT_MISSING)} if extended else {}
    return extra | BIO_PATHS


def overrides(extended: bool = False) -> list[tuple[str, str, str, str]]:
    """(system, path, term, predicate)."""
    tables = (OVERRIDES, OVERRIDES_4, OVERRIDES_56) if extended else (OVERRIDES,)
    return [(s, p, *x) for t in tables for s, rules in t.items() for p, x in rules.items()]


def bio_path(spark: SparkSession, extended: bool = False, strict: bool = False) -> DataFrame:
    """path, bio_term, hops."""
    rows = [(p, t, p.count(".") + 1) for p, t in paths(extended, strict).items()]
    return spark.createDataFrame(rows, "path string, bio_term string, hops int")


def kin_override(spark: SparkSession, extended: bool = False) -> DataFrame:
    """system, path, kin_term, kin_predicate."""
    return spark.createDataFrame(overrides(extended), "system string, path string, kin_term string, kin_predicate string")


def resolve_terms(rows: DataFrame, spark: SparkSession, extended: bool = False, strict: bool = False) -> DataFrame:
    """rows with system and path -> with bio_term, kin_term, has_override; an unknown path drops the row, an override wins."""
    named = rows.join(F.broadcast(bio_path(spark, extended, strict)), "path")
    named = named.join(F.broadcast(kin_override(spark, extended)), ["system", "path"], "left")
    return named.withColumn("has_override", F.col("kin_term").isNotNull()).withColumn("term", F.coalesce("kin_term", "bio_term"))
