"""Queries over the star-schema tables, by name, with their DuckDB oracles.

Graph queries run over the pedigree that sources.pedigree computes from customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinship_terms as K
from ..functions import text as X
from ..operators import dataset as D
from ..operators import evaluation, metrics, paths, prompts, scoring, transform
from ..operators import genealogy as G
from ..operators import questions as Q
from ..sources import turtle as T
from ..sources.datasets import gold
from ..sources.pedigree import PEDIGREE, persons
from ..sources.shared import spread, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(build):
    """A query on persons, which are written once, as most queries join them with themselves, and dealt out: a person is a few bytes, but joins make many rows of each, and one file would leave them to one task."""
    return lambda spark, d: build(written(spread(persons(spark, d), "id")))


# --- SQL blocks -----------------------------------------------------------------------------

_PERSON = "person AS (" + PEDIGREE.format(customer="customer") + ")"
_SIB = """sib AS (SELECT DISTINCT a.id AS src, b.id AS dst, b.sex FROM person a JOIN person b
  ON a.id <> b.id AND (a.mother_id = b.mother_id OR a.father_id = b.father_id)
  WHERE a.mother_id IS NOT NULL AND a.father_id IS NOT NULL AND b.mother_id IS NOT NULL AND b.father_id IS NOT NULL)"""
_PAR = """par AS (SELECT id, sex, mother_id AS parent, 'Mother' AS who, 'Maternal' AS side FROM person WHERE mother_id IS NOT NULL
  UNION ALL SELECT id, sex, father_id, 'Father', 'Paternal' FROM person WHERE father_id IS NOT NULL)"""
_PE = """pe AS (SELECT id AS src, 'has' || who AS pred, parent AS dst FROM par UNION ALL SELECT id, 'hasParent', parent FROM par
  UNION ALL SELECT parent, 'hasChild', id FROM par UNION ALL SELECT parent, CASE sex WHEN 'M' THEN 'hasSon' ELSE 'hasDaughter' END, id FROM par)"""
_SP = """sp AS (SELECT id AS src, 'hasSpouse' AS pred, spouse_id AS dst FROM person WHERE spouse_id IS NOT NULL
  UNION ALL SELECT id, CASE sex WHEN 'M' THEN 'hasWife' ELSE 'hasHusband' END, spouse_id FROM person WHERE spouse_id IS NOT NULL)"""
_SE = "se AS (SELECT src, 'hasSibling' AS pred, dst FROM sib UNION ALL SELECT src, CASE sex WHEN 'M' THEN 'hasBrother' ELSE 'hasSister' END, dst FROM sib)"
_GP = """gg AS (SELECT a.id AS src, a.side, lower(b.who) AS who, b.parent AS dst FROM par a JOIN par b ON a.parent = b.id),
gp AS (SELECT src, 'has' || side || 'Grand' || who AS pred, dst FROM gg UNION SELECT src, 'hasGrand' || who, dst FROM gg
  UNION SELECT src, 'hasGrandparent', dst FROM gg UNION SELECT dst, 'hasGrandchild', src FROM gg)"""
_AU = """ps AS (SELECT p.id AS src, p.side, s.dst, s.sex FROM par p JOIN sib s ON s.src = p.parent),
au AS (SELECT src, CASE sex WHEN 'M' THEN 'hasUncle' ELSE 'hasAunt' END AS pred, dst FROM ps
  UNION SELECT src, 'has' || side || CASE sex WHEN 'M' THEN 'Uncle' ELSE 'Aunt' END, dst FROM ps)"""
_CL = """cl0 AS (SELECT id, id AS anc, 0 AS dist FROM person UNION SELECT c.id, p.parent, c.dist + 1 FROM cl0 c JOIN par p ON p.id = c.anc),
cl AS MATERIALIZED (SELECT id, anc, min(dist) AS dist FROM cl0 GROUP BY ALL)"""
_BEST = "min({'s': x.dist + y.dist, 'mrca': x.anc, 'da': x.dist, 'db': y.dist}) AS z"
#: All related pairs, or those of a table x(a, b).
_MR = f"mr AS MATERIALIZED (SELECT a, b, z.mrca, z.da, z.db FROM (SELECT x.id AS a, y.id AS b, {_BEST} FROM cl x JOIN cl y ON x.anc = y.anc AND x.id <> y.id GROUP BY ALL))"
_MRX = f"mr AS MATERIALIZED (SELECT a, b, z.mrca, z.da, z.db FROM (SELECT q.a, q.b, {_BEST} FROM (SELECT DISTINCT a, b FROM x) q JOIN cl x ON x.id = q.a JOIN cl y ON y.id = q.b AND y.anc = x.anc GROUP BY ALL))"
#: The walk of a linking relative: k rounds done, cur the node reached, hit the relative once found, dead without parents.
_CO = """need AS (SELECT a AS x, mrca AS m, da AS n FROM mr WHERE da = db AND da >= 2 UNION SELECT b, mrca, db FROM mr WHERE da = db AND da >= 2),
walk AS (SELECT x, m, n, 0 AS k, x AS cur, NULL::INT AS hit, false AS dead FROM need UNION ALL
  SELECT x, m, n, k + 1, coalesce(CASE WHEN c.mother_id IS NOT NULL THEN u.father_id ELSE c.father_id END, c.mother_id, cur),
    CASE WHEN u.id = m OR u.mother_id = m OR u.father_id = m THEN u.id WHEN o.id = m OR o.mother_id = m OR o.father_id = m THEN o.id END,
    c.mother_id IS NULL AND c.father_id IS NULL
  FROM walk JOIN person c ON c.id = cur LEFT JOIN person u ON u.id = c.mother_id
  LEFT JOIN person o ON o.id = CASE WHEN c.mother_id IS NOT NULL THEN u.father_id ELSE c.father_id END
  WHERE k < n - 1 AND hit IS NULL AND NOT dead),
lk AS (SELECT w.x, w.m, w.n, p.sex FROM (SELECT walk.x, walk.m, walk.n, coalesce(hit, CASE WHEN k = walk.n - 1 THEN CASE WHEN u.mother_id = walk.m OR u.father_id = walk.m THEN c.mother_id ELSE c.father_id END END) AS link
  FROM walk JOIN person c ON c.id = walk.x LEFT JOIN person u ON u.id = c.mother_id WHERE NOT dead AND (hit IS NOT NULL OR k = walk.n - 1)) w JOIN person p ON p.id = w.link),
co AS MATERIALIZED (SELECT a AS src, b AS dst, (da - 1)::INT AS degree, CASE WHEN s.sex = t.sex THEN 'parallel' ELSE 'cross' END AS type
  FROM mr JOIN lk s ON s.x = a AND s.m = mrca AND s.n = da JOIN lk t ON t.x = b AND t.m = mrca AND t.n = db WHERE da = db AND da >= 2)"""


def _sql(select: str, *blocks: str) -> str:
    return "WITH RECURSIVE " + ", ".join([_PERSON, *blocks]) + " " + select


# --- relations ------------------------------------------------------------------------------

_E = (_PAR, _PE, _SP, _SIB, _SE)
_ALL = (*_E, _GP, _AU)
_add("kin_parent_edges", _graph(G.parent_edges), _sql("SELECT * FROM pe", _PAR, _PE))
_add("kin_spouse_edges", _graph(G.spouse_edges), _sql("SELECT * FROM sp", _SP))
_add("kin_siblings", _graph(G.siblings), _sql("SELECT * FROM sib", _SIB))
_add("kin_brothers_sisters", _graph(G.sibling_edges), _sql("SELECT * FROM se", _SIB, _SE))
_add("kin_grandparents", _graph(G.grandparent_edges), _sql("SELECT * FROM gp", _PAR, _GP))
_add("kin_aunts_uncles", _graph(G.aunt_uncle_edges), _sql("SELECT * FROM au", _PAR, _SIB, _AU))
_add("kin_edges_basic", _graph(lambda p: G.basic_edges(p).groupBy("pred").agg(F.count("*").alias("n"))), _sql("SELECT pred, count(*) AS n FROM (SELECT * FROM pe UNION ALL SELECT * FROM sp UNION ALL SELECT * FROM se UNION ALL SELECT * FROM gp UNION ALL SELECT * FROM au) GROUP BY pred", *_ALL))
_add("ancestor_closure", _graph(G.closure), _sql("SELECT * FROM cl", _PAR, _CL))
# One row for each pair of relatives would be the square of the population: the whole relation is counted by subject.
_add("mrca_pairs", _graph(G.mrca_totals), _sql("SELECT a, da, db, count(*) AS n, sum(b)::BIGINT AS sum_b, sum(mrca)::BIGINT AS sum_mrca FROM mr GROUP BY ALL", _PAR, _CL, _MR))
_add("cousins_typed", _graph(G.cousin_totals), _sql("SELECT src, degree, type, count(*) AS n, sum(dst)::BIGINT AS sum_dst FROM co GROUP BY ALL", _PAR, _CL, _MR, _CO))
_add("kin_cousins", _graph(lambda p: G.cousin_totals(p).groupBy("src", F.lit("hasCousin").alias("pred")).agg(F.sum("n").alias("n"), F.sum("sum_dst").alias("sum_dst"))), _sql("SELECT src, 'hasCousin' AS pred, count(*) AS n, sum(dst)::BIGINT AS sum_dst FROM co GROUP BY ALL", _PAR, _CL, _MR, _CO))
for _line, _name in (("mother_id", "matri"), ("father_id", "patri")):
    _add(f"clan_{_name}", _graph(lambda p, line=_line: G.clans(p, line)), _sql(f"SELECT id, founder FROM ln WHERE up IS NULL", f"ln AS (SELECT id, id AS founder, {_line} AS up FROM person UNION ALL SELECT l.id, p.id, p.{_line} FROM ln l JOIN person p ON p.id = l.up)"))
for _sys, _line, _other, _a, _b in (("crow", "mother_id", "father_id", "sameMatriclan", "fathersMatriclan"), ("omaha", "father_id", "mother_id", "samePatriclan", "mothersPatriclan")):
    _add(
        f"clan_pairs_{_sys}",
        _graph(lambda p, s=_sys: G.clan_degrees(p, s)),
        _sql(
            f"""SELECT src, pred, count(*) AS n, sum(dst)::BIGINT AS sum_dst FROM (
            SELECT s.id AS src, CASE WHEN d.founder = c.founder THEN '{_a}' ELSE '{_b}' END AS pred, d.id AS dst
            FROM person s JOIN clan c ON c.id = s.id JOIN clan f ON f.id = s.{_other} JOIN clan d ON d.id <> s.id AND (d.founder = c.founder OR d.founder = f.founder)) GROUP BY ALL""",
            f"ln AS (SELECT id, id AS founder, {_line} AS up FROM person UNION ALL SELECT l.id, p.id, p.{_line} FROM ln l JOIN person p ON p.id = l.up), clan AS (SELECT id, founder FROM ln WHERE up IS NULL)",
        ),
    )
_KIN = {
    "hawaiian": "SELECT src, 'hasClassificatorySibling' AS pred, dst FROM co",
    "iroquois": "SELECT src, unnest(CASE type WHEN 'parallel' THEN ['hasParallelCousin', 'hasClassificatorySibling'] ELSE ['hasCrossCousin'] END) AS pred, dst FROM co",
    "dravidian": "SELECT src, unnest(CASE type WHEN 'parallel' THEN ['hasParallelCousin', 'hasClassificatorySibling'] ELSE CASE degree WHEN 1 THEN ['hasCrossCousin', 'hasPotentialSpouse'] ELSE ['hasCrossCousin'] END END) AS pred, dst FROM co",
}
_CPAR = " UNION SELECT src, 'hasClassificatoryParent', dst FROM ps WHERE (side = 'Maternal') = (sex = 'F')"
_CROSS = " UNION SELECT src, CASE sex WHEN 'M' THEN '{m}' ELSE '{f}' END, dst FROM ps WHERE (side = 'Maternal') = (sex = 'M')"
_REST = {"hawaiian": _CPAR, "iroquois": _CPAR + _CROSS.format(m="hasCrossUncle", f="hasCrossAunt"), "dravidian": _CPAR + _CROSS.format(m="hasCrossUncle", f="hasCrossAunt") + _CROSS.format(m="hasMama", f="hasAthai")}
for _sys in _KIN:
    _add(
        f"kin_edges_{_sys}",
        _graph(lambda p, s=_sys: G.kin_totals(p, s)),
        _sql(f"SELECT src, pred, count(*) AS n, sum(dst)::BIGINT AS sum_dst FROM (SELECT DISTINCT * FROM ({_KIN[_sys]}{_REST[_sys]})) GROUP BY ALL", _PAR, _SIB, _AU, _CL, _MR, _CO),
    )


def _candidates(p: DataFrame) -> DataFrame:
    """Men and women whose ids differ by ten at most: a band join through blocks of eleven ids."""
    block = F.floor(F.col("id") / 11)
    men = p.filter("sex = 'M'").select(F.col("id").alias("a"), F.explode(F.array(block - 1, block, block + 1)).alias("k"))
    return men.join(p.filter("sex = 'F'").select(F.col("id").alias("b"), block.alias("k")), "k").filter("abs(a - b) <= 10").select("a", "b")


_LN = "ln{t} AS (SELECT id, id AS founder, {l} AS up FROM person UNION ALL SELECT l.id, p.id, p.{l} FROM ln{t} l JOIN person p ON p.id = l.up), clan{t} AS (SELECT id, founder FROM ln{t} WHERE up IS NULL)"
_RULES = {
    "eskimo": "(da = 2 AND db = 2)", "hawaiian": "(da >= 2 AND db >= 2)", "sudanese": "(da <= 2 AND db <= 2)", "iroquois": "type = 'parallel'", "dravidian": "type = 'parallel'",
    "crow": "(ca.founder = cb.founder OR ca.founder = fb.founder OR cb.founder = fa.founder)", "omaha": "(ca.founder = cb.founder OR ca.founder = fb.founder OR cb.founder = fa.founder)",
}
for _sys, _rule in _RULES.items():
    _own, _oth = ("mother_id", "father_id") if _sys != "omaha" else ("father_id", "mother_id")
    _add(
        f"marriage_ok_{_sys}",
        _graph(lambda p, s=_sys: G.marriage_allowed(written(_candidates(p)), p, s)),
        _sql(
            f"""SELECT x.a, x.b, NOT (coalesce({_rule}, false) OR EXISTS (SELECT 1 FROM sib WHERE src = x.a AND dst = x.b)
            OR EXISTS (SELECT 1 FROM par WHERE (id = x.a AND parent = x.b) OR (id = x.b AND parent = x.a))) AS allowed
            FROM x LEFT JOIN mr ON mr.a = x.a AND mr.b = x.b LEFT JOIN co ON co.src = x.a AND co.dst = x.b
            LEFT JOIN clan1 ca ON ca.id = x.a LEFT JOIN clan1 cb ON cb.id = x.b LEFT JOIN clan1 fa ON fa.id = x.pa LEFT JOIN clan1 fb ON fb.id = x.pb""",
            _PAR, _SIB, _CL, f"x AS (SELECT a.id AS a, b.id AS b, a.{_oth} AS pa, b.{_oth} AS pb FROM person a JOIN person b ON a.sex = 'M' AND b.sex = 'F' AND abs(a.id - b.id) <= 10)", _MRX, _CO, _LN.format(t=1, l=_own),
        ),
    )
_add(
    "marriage_mix",
    _graph(lambda p: G.marriage_mix(p.filter("sex = 'M' and spouse_id is not null").select(F.col("id").alias("a"), F.col("spouse_id").alias("b")), p)),
    _sql("SELECT coalesce(type, 'other') AS type, count(*) AS n FROM x LEFT JOIN co ON co.src = x.a AND co.dst = x.b GROUP BY ALL", _PAR, _CL, "x AS (SELECT id AS a, spouse_id AS b FROM person WHERE sex = 'M' AND spouse_id IS NOT NULL)", _MRX, _CO),
)
_add("clan_members", _graph(lambda p: G.clan_members(p, "crow")), _sql("SELECT id, dense_rank() OVER (ORDER BY founder)::INT AS clan FROM ln WHERE up IS NULL", "ln AS (SELECT id, id AS founder, mother_id AS up FROM person UNION ALL SELECT l.id, p.id, p.mother_id FROM ln l JOIN person p ON p.id = l.up)"))

# --- paths ----------------------------------------------------------------------------------


def _walk(path: str) -> str:
    """Blocks h0..hn of a path's frontier."""
    out = ["h0 AS (SELECT id AS anchor, id AS node FROM person)", "edge AS (SELECT * FROM pe UNION ALL SELECT * FROM sp UNION ALL SELECT * FROM se)"]
    for k, c in enumerate(path.split("."), 1):
        out.append(f"h{k} AS (SELECT DISTINCT h.anchor, e.dst AS node FROM h{k - 1} h JOIN edge e ON e.src = h.node AND e.pred = '{K.PREDICATES[c]}')")
    return ", ".join(out)


def _edges(p: DataFrame) -> DataFrame:
    return G.parent_edges(p).unionByName(G.spouse_edges(p)).unionByName(G.sibling_edges(p))


for _path in ("F.B", "F.B.C", "F.F.B.C", "F.F.B.C.C", "F.F.B.C.C.C"):
    _n = _path.count(".") + 1
    _add(f"path_{_n}hop", _graph(lambda p, x=_path: paths.traverse(_edges(p), p, x)), _sql(f"SELECT * FROM h{_n}", *_E, _walk(_path)))
_TWO = [p for p in K.BIO_PATHS if p.count(".") == 1]
_UNION2 = " UNION ALL ".join(f"SELECT a.anchor, '{p}' AS path, e.dst AS node FROM (SELECT DISTINCT src AS anchor, dst AS node FROM edge WHERE pred = '{K.PREDICATES[p.split('.')[0]]}') a JOIN (SELECT DISTINCT src, dst FROM edge WHERE pred = '{K.PREDICATES[p.split('.')[1]]}') e ON e.src = a.node" for p in _TWO)
_T2 = f"edge AS (SELECT * FROM pe UNION ALL SELECT * FROM sp UNION ALL SELECT * FROM se), t2 AS (SELECT DISTINCT * FROM ({_UNION2}))"
_add("paths_2hop_all", _graph(lambda p: paths.traverse_all(_edges(p), p, _TWO)), _sql("SELECT * FROM t2", *_E, _T2))
_add("paths_at_distance", _graph(lambda p: paths.at_distance(_edges(p), p, list(K.BIO_PATHS), 2).withColumn("paths", F.concat_ws(",", "paths"))), _sql("SELECT anchor, node, string_agg(path, ',' ORDER BY path) AS paths FROM t2 WHERE anchor <> node GROUP BY ALL", *_E, _T2))
_W3 = """wk AS (SELECT DISTINCT anchor, 1 AS hop, src, pred, dst FROM h0 JOIN edge ON src = node AND pred = 'hasFather'
  UNION ALL SELECT DISTINCT anchor, 2, src, pred, dst FROM h1 JOIN edge ON src = node AND pred = 'hasBrother'
  UNION ALL SELECT DISTINCT anchor, 3, src, pred, dst FROM h2 JOIN edge ON src = node AND pred = 'hasChild')"""
_add("context_facts", _graph(lambda p: paths.context_edges(_edges(p), p, "F.B.C")), _sql("SELECT * FROM wk", *_E, _walk("F.B.C"), _W3))
_add(
    "proof_size",
    _graph(lambda p: paths.proof(_edges(p), p, "F.B.C")),
    _sql(
        """SELECT f.anchor, f.context, (f.n + q.persons)::BIGINT AS size FROM (SELECT anchor, string_agg('P' || src || '''s ' || lower(replace(pred, 'has', '')) || ' is P' || dst || '.', ' ' ORDER BY hop, src, dst, pred) AS context, sum(n) AS n
        FROM (SELECT anchor, src, pred, dst, min(hop) AS hop, count(*) AS n FROM wk GROUP BY ALL) GROUP BY anchor) f
        JOIN (SELECT anchor, count(DISTINCT x) AS persons FROM (SELECT anchor, src AS x FROM wk UNION ALL SELECT anchor, dst FROM wk) GROUP BY anchor) q USING (anchor)""",
        *_E, _walk("F.B.C"), _W3,
    ),
)


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_BIO = f"bio(path, bio_term) AS (VALUES {_values(list(K.BIO_PATHS.items()))})"
# --- questions ------------------------------------------------------------------------------

_joined = lambda df, *cols: df.withColumns({c: F.concat_ws("|", c) for c in cols})
_EDGE = "edge AS (SELECT * FROM pe UNION ALL SELECT * FROM sp UNION ALL SELECT * FROM se)"
_add(
    "cat1_lookup",
    _graph(lambda p: _joined(Q.fact_questions(_edges(p)), "names")),
    _sql(
        """SELECT anchor, pred AS template, replace(q, '{name}', 'P' || anchor) AS question_text, CASE kind WHEN 'person' THEN all_names[1] ELSE array_to_string(all_names, '|') END AS names,
        'P' || anchor || CASE kind WHEN 'person' THEN '''s ' || lower(replace(pred, 'has', '')) || ' is ' || all_names[1] || '.' ELSE ' has the following ' || lower(replace(pred, 'has', '')) || 's: ' || array_to_string(all_names, ', ') || '.' END AS context
        FROM (SELECT src AS anchor, pred, q, kind, list(DISTINCT 'P' || dst ORDER BY 'P' || dst) AS all_names FROM edge JOIN t USING (pred) GROUP BY ALL)""",
        *_E, _EDGE, f"t(pred, q, kind) AS (VALUES {_values(list(Q.FACTS))})",
    ),
)
_add(
    "cat3_counts",
    _graph(lambda p: Q.count_questions(_edges(p))),
    _sql(
        """SELECT src AS anchor, pred AS template, replace(q, '{name}', 'P' || src) AS question_text, count(*) AS n FROM edge JOIN t USING (pred) GROUP BY ALL
        UNION ALL SELECT a.src, 'hasGrandchild', 'How many grandchildren does P' || a.src || ' have?', count(*) FROM edge a JOIN edge b ON a.dst = b.src AND a.pred = 'hasChild' AND b.pred = 'hasChild' GROUP BY ALL""",
        *_E, _EDGE, f"t(pred, q) AS (VALUES {_values(list(Q.COUNTS))})",
    ),
)
_add("cat3_filters", _graph(lambda p: _joined(Q.filter_questions(_edges(p)), "names")), _sql("SELECT src AS anchor, pred AS template, replace(q, '{name}', 'P' || src) AS question_text, string_agg('P' || dst, '|' ORDER BY 'P' || dst) AS names FROM edge JOIN t USING (pred) GROUP BY ALL", *_E, _EDGE, f"t(pred, q) AS (VALUES {_values(list(Q.FILTERS))})"))
_PLURAL = "CASE WHEN ends_with({t}, ')') THEN regexp_replace({t}, '^(.*) (\\(.*)$', '\\1s \\2') ELSE {t} || 's' END"
# Over all paths and overrides, base and extended.
_EVERY = list(K.paths(extended=True))
_BIO_EVERY = f"bio(path, bio_term) AS (VALUES {_values(list(K.paths(extended=True).items()))})"


def _tree(wanted: list[str]) -> str:
    """Blocks edge and tn (anchor, path, node) of all wanted paths; each prefix is walked once."""
    name = lambda x: "w_" + x.replace(".", "_")
    out = [_EDGE]
    for x in sorted({".".join(p.split(".")[:k]) for p in wanted for k in range(1, p.count(".") + 2)}):
        up, _, code = x.rpartition(".")
        step = f"SELECT DISTINCT w.anchor, e.dst AS node FROM {name(up)} w JOIN edge e ON e.src = w.node AND" if up else "SELECT DISTINCT e.src AS anchor, e.dst AS node FROM edge e WHERE"
        out.append(f"{name(x)} AS MATERIALIZED ({step} e.pred = '{K.PREDICATES[code]}')")
    out.append("tn AS (" + " UNION ALL ".join(f"SELECT anchor, '{p}' AS path, node FROM {name(p)}" for p in wanted) + ")")
    return ", ".join(out)


_RN = "rn AS (SELECT anchor, path, list('P' || node ORDER BY 'P' || node) AS names FROM tn WHERE anchor <> node GROUP BY ALL)"
_add("top_paths", _graph(lambda p: paths.traverse_all(_edges(p), p, _EVERY).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(10)), _sql("SELECT path, count(*) AS n FROM tn GROUP BY path ORDER BY n DESC, path LIMIT 10", *_E, _tree(_EVERY)))
_add(
    "cat2_questions",
    _graph(lambda p: _joined(Q.path_questions(_edges(p), p, _EVERY), "names")),
    _sql(
        f"""SELECT anchor, path, hops, question_text, array_to_string(names, '|') AS names, bio_term FROM (SELECT *, row_number() OVER (PARTITION BY question_text, hops ORDER BY path) AS k FROM (
        SELECT anchor, path, len(string_split(path, '.'))::INT AS hops, names, bio_term, CASE len(names) WHEN 1 THEN 'Who is P' || anchor || '''s ' || bio_term || '?' ELSE 'Who are P' || anchor || '''s ' || {_PLURAL.format(t="bio_term")} || '?' END AS question_text FROM rn JOIN bio USING (path))) WHERE k = 1""",
        *_E, _tree(_EVERY), _RN, _BIO_EVERY,
    ),
)
for _sys in K.SYSTEMS:
    _rules = [(p, t, k) for s, p, t, k in K.overrides(True) if s == _sys] or [("none", "none", "none")]
    _add(
        f"cultural_terms_{_sys}",
        _graph(lambda p, s=_sys: K.resolve_terms(paths.named(paths.traverse_coded(_edges(p), p, _EVERY).groupBy("code").agg(F.count("*").alias("n")).withColumn("anchor", F.lit(0)), _EVERY).withColumn("system", F.lit(s)), p.sparkSession, True).select("system", "path", "bio_term", "kin_term", "has_override", "term", "n")),
        _sql(f"SELECT '{_sys}' AS system, tn.path, bio_term, kin_term, kin_term IS NOT NULL AS has_override, coalesce(kin_term, bio_term) AS term, count(*) AS n FROM tn JOIN bio USING (path) LEFT JOIN ov USING (path) GROUP BY ALL", *_E, _tree(_EVERY), _BIO_EVERY, f"ov(path, kin_term, kin_predicate) AS (VALUES {_values(_rules)})"),
    )
for _sys in ("hawaiian", "iroquois", "dravidian", "crow", "omaha"):
    _rules = [(p, t) for s, p, t, _ in K.overrides(True) if s == _sys and p in K.paths(extended=True)]
    _cap = _sys.capitalize()
    _add(
        f"cat4_{_sys}",
        _graph(lambda p, s=_sys: _joined(Q.override_questions(_edges(p), p, s, extended=True), "gold")),
        _sql(
            f"""SELECT x.text AS question_text, min(x.kind) AS kind, min(anchor) AS anchor, list(path ORDER BY length(path), path)[1] AS path, array_to_string(list_sort(list_distinct(flatten(list(x.gold)))), '|') AS gold
            FROM (SELECT anchor, path, unnest([
            {{'kind': 'cultural_term', 'text': 'In the {_cap} kinship system, ' || CASE len(names) WHEN 1 THEN 'who is P' || anchor || '''s ' || kin_term ELSE 'who are P' || anchor || '''s ' || kin_term || 's' END || '?', 'gold': names}},
            {{'kind': 'disambiguation', 'text': 'In the {_cap} system, ' || array_to_string(names, ', ') || CASE len(names) WHEN 1 THEN ' is called P' || anchor || '''s ''' || kin_term ELSE ' are called P' || anchor || '''s ''' || kin_term || 's' END || '''. What is their actual biological relationship?', 'gold': [bio_term]}},
            {{'kind': 'comparison', 'text': 'List all of P' || anchor || '''s ' || kin_term || 's according to the {_cap} system.', 'gold': names}}]) AS x FROM rn JOIN ov USING (path) JOIN bio USING (path)) GROUP BY x.text""",
            *_E, _tree([p for p, _ in _rules]), _RN, _BIO_EVERY, f"ov(path, kin_term) AS (VALUES {_values(_rules)})",
        ),
    )


_C2 = f"""c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_text, hops ORDER BY path) AS k FROM (
    SELECT anchor, path, len(string_split(path, '.'))::INT AS hops, names, bio_term, CASE len(names) WHEN 1 THEN 'Who is P' || anchor || '''s ' || bio_term || '?' ELSE 'Who are P' || anchor || '''s ' || {_PLURAL.format(t="bio_term")} || '?' END AS question_text FROM rn JOIN bio USING (path))) WHERE k = 1)"""


def _sample(p: DataFrame) -> DataFrame:
    q = Q.path_questions(_edges(p), p, _EVERY).select("anchor", "path")
    scattered = (F.col("anchor").cast("long") * 7919 + 13) % 10007  # beyond int from 271,178 persons on
    return Q.sampled(q, "path", 50, [scattered, F.col("anchor")], "crow").select("question_id", "anchor", "path", "rank")


_add(
    "question_sample_ids",
    _graph(_sample),
    _sql(
        """SELECT 'crow_' || lpad((row_number() OVER (ORDER BY path, rank))::VARCHAR, 4, '0') AS question_id, anchor, path, rank FROM (SELECT anchor, path, (row_number() OVER (PARTITION BY path ORDER BY (anchor * 7919 + 13) % 10007, anchor))::INT AS rank FROM c2) WHERE rank <= 50""",
        *_E, _tree(_EVERY), _RN, _BIO_EVERY, _C2,
    ),
)


def _people(p: DataFrame) -> DataFrame:
    return p.select("id", F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"))


_SEVERAL = [p for p in K.BIO_PATHS if 2 <= p.count(".") + 1 <= 4]


def _question_set(p: DataFrame) -> DataFrame:
    found = D.path_ends(_edges(p), _people(p), _SEVERAL)
    rows = D.sampled(D.multi_hop_rows(found, "crow"), "crow")
    return rows.select("question_id", "n_hops", "question_text", "path", F.concat_ws("|", "names").alias("names"), "bio_term", "kin_term", "has_override")


_CROW = [(p, t, k) for s, p, t, k in K.overrides() if s == "crow"]
_add(
    "question_set",
    _graph(_question_set),
    _sql(
        """SELECT 'crow_' || lpad((row_number() OVER (ORDER BY hops, r))::VARCHAR, 4, '0') AS question_id, hops AS n_hops, question_text, path, array_to_string(names, '|') AS names, bio_term, kin_term, kin_term IS NOT NULL AS has_override
        FROM (SELECT c2.*, kin_term, row_number() OVER (PARTITION BY hops ORDER BY md5('42|' || question_text), question_text, path) AS r FROM c2 LEFT JOIN ov USING (path)) WHERE r <= 50""",
        *_E, _tree(_SEVERAL), _RN, _BIO_EVERY, _C2, f"ov(path, kin_term, kin_predicate) AS (VALUES {_values(_CROW)})",
    ),
)
_add(
    "question_funnel",
    _graph(lambda p: D.funnel(_edges(p), _people(p), "crow", _SEVERAL)),
    _sql(
        f"""SELECT hops, asked, coalesce(reached, 0) AS reached, coalesce(kept, 0) AS kept FROM (SELECT hops, count(*) * (SELECT count(*) FROM person) AS asked FROM (VALUES {_values([(p.count('.') + 1,) for p in _SEVERAL])}) AS w(hops) GROUP BY hops)
        LEFT JOIN (SELECT len(string_split(path, '.')) AS hops, count(*) AS reached FROM rn GROUP BY ALL) USING (hops) LEFT JOIN (SELECT hops, count(*) AS kept FROM c2 GROUP BY hops) USING (hops)""",
        *_E, _tree(_SEVERAL), _RN, _BIO_EVERY, _C2,
    ),
)


def _described(p: DataFrame) -> DataFrame:
    return D.override_rows(D.path_ends(_edges(p), _people(p), _SEVERAL), "eskimo").select("anchor", "path", "question_text", F.concat_ws("|", "names").alias("names"))


_add(
    "cat4_eskimo",
    _graph(_described),
    _sql(
        f"""SELECT anchor, path, question_text, array_to_string(names, '|') AS names FROM (SELECT *, row_number() OVER (PARTITION BY question_text, hops ORDER BY path) AS k FROM (SELECT anchor, path, names, len(string_split(path, '.')) AS hops,
        'In the Eskimo (descriptive) system, ' || CASE len(names) WHEN 1 THEN 'who is specifically P' || anchor || '''s ' || bio_term ELSE 'who are specifically P' || anchor || '''s ' || {_PLURAL.format(t="bio_term")} END || '?' AS question_text FROM rn JOIN bio USING (path))) WHERE k = 1""",
        *_E, _tree(_SEVERAL), _RN, _BIO_EVERY,
    ),
)
for _hops, _count, _first_id in (((4,), D.FOUR_HOP_COUNT, D.FOUR_HOP_IDS), ((5, 6), D.LONG_HOP_COUNT, D.LONG_HOP_IDS)):
    _rules = [(p, t) for s, p, t, _ in K.overrides(True) if s == "crow" and p.count(".") + 1 in _hops]
    _add(
        f"augment_{'_'.join(map(str, _hops))}hop",
        _graph(lambda p, h=_hops, n=_count, f=_first_id: D.further(_edges(p), _people(p), "crow", h, n, f).select("question_id", "n_hops", "question_text", "kin_term", F.concat_ws("|", gold(F.col("ground_truth"))).alias("answer"))),
        _sql(
            f"""SELECT 'crow_' || lpad(({_first_id - 1} + row_number() OVER (ORDER BY n_hops, r))::VARCHAR, 4, '0') AS question_id, n_hops, question_text, kin_term, answer FROM (
            SELECT *, row_number() OVER (PARTITION BY n_hops ORDER BY md5('42|' || question_text), question_text, path) AS r FROM (
            SELECT *, row_number() OVER (PARTITION BY question_text, n_hops ORDER BY path, anchor) AS k FROM (SELECT anchor, path, len(string_split(path, '.'))::INT AS n_hops, kin_term, x.text AS question_text, x.answer AS answer FROM (SELECT *, unnest([
            {{'text': 'In the Crow kinship system, ' || CASE len(names) WHEN 1 THEN 'who is P' || anchor || '''s ' || kin_term ELSE 'who are P' || anchor || '''s ' || kin_term || 's' END || '?', 'answer': array_to_string(names, '|')}},
            {{'text': 'In the Crow system, ' || array_to_string(names, ', ') || CASE len(names) WHEN 1 THEN ' is called P' || anchor || '''s ''' || kin_term ELSE ' are called P' || anchor || '''s ''' || kin_term || 's' END || '''. What is their actual biological relationship?', 'answer': bio_term}},
            {{'text': 'List all of P' || anchor || '''s ' || kin_term || 's according to the Crow system.', 'answer': array_to_string(names, '|')}}]) AS x FROM rn JOIN ov USING (path) JOIN bio USING (path)))) WHERE k = 1) WHERE r <= {_count}""",
            *_E, _tree([p for p, _ in _rules]), _RN, _BIO_EVERY, f"ov(path, kin_term) AS (VALUES {_values(_rules)})",
        ),
    )
_add(
    "turtle_blocks",
    _graph(lambda p: T.turtle_blocks(T.edge_triples(G.parent_edges(p).filter("pred in ('hasFather', 'hasMother')")))),
    _sql("SELECT '<http://example.org/person/person_' || id || '> <http://example.org/family/hasFather> <http://example.org/person/person_' || father_id || '> ;' || chr(10) || '    <http://example.org/family/hasMother> <http://example.org/person/person_' || mother_id || '> .' AS value FROM person WHERE father_id IS NOT NULL"),
)


# --- text -----------------------------------------------------------------------------------


def _text(name: str, column, sql: str, table: str = "conversations", keys: str = "conv_id, turn") -> None:
    ks = keys.split(", ")
    _add(name, lambda spark, d: _table(spark, d, table).select(*ks, column(F.col("text")).alias("value")), f"SELECT {keys}, {sql} AS value FROM {table}")


_S = X._S
_STRIP = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_NORM = lambda x: f"regexp_replace(regexp_replace(lower({_STRIP(f'coalesce({x}, {chr(39)*2})')}), '{_S}+', ' ', 'g'), '[^A-Za-z0-9_ ]', '', 'g')"
_text("normalize_text", X.normalize_name, _NORM("text"))
_text("question_type", X.question_type, "CASE WHEN contains(lower(text), 'how many') THEN 'count' WHEN contains(lower(text), 'biological relationship') OR contains(lower(text), 'what is their') THEN 'relationship' ELSE 'name' END")
_text("extract_number", lambda x: X.extract_number(x, strict=True), "CASE WHEN text IS NULL OR starts_with(text, '[ERROR') OR starts_with(text, '[BLOCKED') THEN NULL WHEN regexp_extract(text, '\\b([0-9]+)\\b', 1) <> '' THEN TRY_CAST(regexp_extract(text, '\\b([0-9]+)\\b', 1) AS BIGINT) " + " ".join(f"WHEN contains(lower(text), '{w}') THEN {k}" for k, w in enumerate(X.NUMBERS)) + " END")
_text("extract_relationship", X.extract_relationship, "CASE WHEN text IS NULL OR text = '' OR starts_with(text, '[ERROR') OR starts_with(text, '[BLOCKED') THEN NULL " + " ".join("WHEN contains(lower(text), '" + t.replace("'", "''") + f"') THEN '" + t.replace("'", "''") + "'" for t in X.RELATIONSHIPS) + f" ELSE lower({_STRIP('text')}) END")
# DuckDB's \b knows ASCII only: accented letters are put as _, other characters beyond ASCII as a full stop; neither can be part of a name.
_ASCII = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\pL\p{Nd}\pM]', '.', 'g'), '[^\x00-\x7F]', '_', 'g')"
_NAMED = rf"regexp_extract_all({_ASCII}, '\b([A-Z][a-z]+{_S}+[A-Z][a-z]+)\b', 1)"
_add(
    "extract_names",
    lambda spark, d: _table(spark, d, "documents").select("doc_id", F.concat_ws("|", X.extract_names(F.col("text"))).alias("value")),
    rf"""SELECT doc_id, CASE WHEN text IS NULL OR text = '' OR starts_with(text, '[ERROR') OR starts_with(text, '[BLOCKED') THEN ''
    WHEN len({_NAMED}) > 0 THEN array_to_string(list_filter({_NAMED}, lambda n, i: list_position(list_transform({_NAMED}, lambda y: lower(y)), lower(n)) = i), '|')
    WHEN regexp_extract({_ASCII}, '\b([A-Z][a-z]{{2,}})\b', 1) <> '' THEN regexp_extract({_ASCII}, '\b([A-Z][a-z]{{2,}})\b', 1) ELSE {_STRIP("text")} END AS value FROM documents""",
)
_add(
    "cot_answer",
    lambda spark, d: _table(spark, d, "part").select("p_partkey", X.cot_answer(F.concat(F.lit("STEP 1 - look.\n"), F.col("p_type"), F.lit("\nFINAL ANSWER: The part is "), F.col("p_name"), F.lit(".\n"))).alias("value")),
    "SELECT p_partkey, p_name AS value FROM part",
)
for _mode in transform.MODES:
    _term = "classificatory father" if _mode == "system_only" else "tier-pater"
    _who = "Crow" if _mode == "term_only" else "Vespian"
    _add(
        f"relabel_{_mode}",
        lambda spark, d, m=_mode: transform.relabel(_table(spark, d, "part").select("p_partkey", F.concat(F.lit("In the Crow kinship system, who is "), F.col("p_brand"), F.lit("'s classificatory father?")).alias("question_text")), "crow", m),
        f"SELECT p_partkey, 'In the {_who} kinship system, who is ' || p_brand || '''s {_term}?' AS question_text, 'crow' AS kinship_system_original, 'fictional_crow_{_mode}' AS kinship_system, {'NULL' if _mode == 'term_only' else chr(39) + 'Vespian' + chr(39)}::VARCHAR AS fictional_label, '{_mode}' AS fictional_mode FROM part",
    )


def _paraphrased(spark: SparkSession, d: str) -> DataFrame:
    q = _table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("In the Omaha system, who is "), F.initcap("n_name"), F.lit("'s cross-aunt?"))).otherwise(F.concat(F.lit("List all of "), F.initcap("n_name"), F.lit("'s cross-aunts according to the Omaha system."))).alias("q"))
    text, idx = transform.paraphrase(F.col("q"))
    return q.select("n_nationkey", text.alias("value"), idx.alias("pattern"))


_CAPN = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_add("paraphrase_text", _paraphrased, f"SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Under the Omaha kinship convention, identify ' || {_CAPN} || '''s cross-aunt.' ELSE 'Within the Omaha system, give the complete list of ' || {_CAPN} || '''s cross-aunts.' END AS value, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 2 END AS pattern FROM nation")

# --- scoring and metrics --------------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Orders' line statuses against their return flags, as small sets."""
    li = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("predicted"), F.collect_set(F.when(F.col("l_linestatus") == "O", "N").otherwise("R")).alias("gold"), F.min("l_linenumber").alias("m"), F.count("*").alias("k"))
    s = scoring.set_scores(F.col("predicted"), F.col("gold"))
    return li.withColumns(s).withColumns({"category": (F.col("k") % 4 + 1).cast("int"), "n_hops": F.col("k").cast("int"), "has_override": F.col("l_orderkey") % 2 == 0, "is_error": F.lit(False)})


_SC = """p AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS p, list(DISTINCT CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END) AS g, count(*) AS k FROM lineitem GROUP BY ALL),
i AS (SELECT *, len(list_intersect(p, g)) AS b FROM p),
s AS (SELECT l_orderkey, k, p, g, b = len(p) AND b = len(g) AS exact_match, b > 0 AS partial_match, b / len(p) AS precision, b / len(g) AS recall,
  CASE WHEN b > 0 THEN 2 * (b / len(p)) * (b / len(g)) / (b / len(p) + b / len(g)) ELSE 0.0::DOUBLE END AS f1, (k % 4 + 1)::INT AS category, k::INT AS n_hops, l_orderkey % 2 = 0 AS has_override FROM i)"""
_add("score_sets", lambda spark, d: _pairs(spark, d).select("l_orderkey", "exact_match", "partial_match", "precision", "recall", "f1"), f"WITH {_SC} SELECT l_orderkey, exact_match, partial_match, precision, recall, f1 FROM s")
_rounded = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
_add(
    "score_summary",
    lambda spark, d: _rounded(scoring.summary(_pairs(spark, d)), "mean_precision", "mean_recall", "mean_f1"),
    f"WITH {_SC} SELECT category, n_hops, has_override, grouping(category, n_hops, has_override)::BIGINT AS grouping, count(*) AS n, count(*) FILTER (exact_match) AS exact, count(*) FILTER (partial_match) AS partial, 0::BIGINT AS errors, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1 FROM s GROUP BY GROUPING SETS ((), (category), (n_hops), (has_override))",
)
_add(
    "error_taxonomy",
    lambda spark, d: _pairs(spark, d).withColumn("class", scoring.error_class(F.col("predicted"), F.col("gold"), F.array(F.lit("A")))).groupBy("class").agg(F.count("*").alias("n")),
    f"WITH {_SC} SELECT CASE WHEN exact_match THEN NULL WHEN len(p) = 0 THEN 'empty_format' WHEN len(list_intersect(p, g)) = len(g) THEN 'over_inclusion' WHEN len(list_intersect(p, g)) = len(p) THEN 'partial_under' WHEN partial_match THEN 'partial_overlap' WHEN p = ['A'] THEN 'default_substitution' ELSE 'wrong_disjoint' END AS class, count(*) AS n FROM s GROUP BY ALL",
)
_ORD = "(SELECT n_regionkey AS region, n_nationkey AS nation, o_orderpriority AS priority, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = _table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


_add("macro_mean", lambda spark, d: _rounded(metrics.macro(_orders(spark, d), "region", "nation", "price"), "macro_mean"), f"SELECT region, round(avg(mean), 6) AS macro_mean, count(*) AS systems FROM (SELECT region, nation, avg(price) AS mean FROM {_ORD} GROUP BY ALL) GROUP BY region")
_add("std_pop_samp", lambda spark, d: _rounded(metrics.spread(_orders(spark, d), ["region"], "price"), "mean", "std_pop", "std_samp").drop("x"), f"SELECT region, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS std_pop, round(stddev_samp(price), 6) AS std_samp, count(*) AS n FROM {_ORD} GROUP BY region")
_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_add("summary_pivot", lambda spark, d: _orders(spark, d).groupBy("region").pivot("priority", _PRI).count().select("region", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"p{p[0]}") for p in _PRI]), "SELECT region, " + ", ".join(f"count(*) FILTER (priority = '{p}') AS p{p[0]}" for p in _PRI) + f" FROM {_ORD} GROUP BY region")
_LI = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'real' WHEN 'NF' THEN 'fictional' WHEN 'NO' THEN 'system_only' ELSE 'term_only' END"
_ABL = [f"round({c}, 6) AS {c}" for c in ("real", "fictional", "system_only", "term_only", "delta_full", "delta_sys", "delta_term", "interaction")]
_add(
    "ablation_2x2",
    lambda spark, d: _rounded(metrics.ablation(_table(spark, d, "lineitem").select("l_linenumber", F.expr(_LI).alias("mode"), (F.col("l_quantity") / 50).alias("em")), ["l_linenumber"]), "real", "fictional", "system_only", "term_only", "delta_full", "delta_sys", "delta_term", "interaction"),
    f"WITH m AS (SELECT l_linenumber, " + ", ".join(f"avg(l_quantity / 50) FILTER ({_LI} = '{m}') AS {m}" for m in ("real", "fictional", "system_only", "term_only")) + f" FROM lineitem GROUP BY l_linenumber), x AS (SELECT *, fictional - real AS delta_full, system_only - real AS delta_sys, term_only - real AS delta_term FROM m), y AS (SELECT *, delta_full - (delta_sys + delta_term) AS interaction FROM x) SELECT l_linenumber, {', '.join(_ABL)} FROM y",
)
_add("envelope_ci", lambda spark, d: metrics.envelope(_table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi")), ["l_returnflag"]), "SELECT l_returnflag, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag")
_add("dup_names", lambda spark, d: _table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1"), "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
_add("limit_filtered", lambda spark, d: _table(spark, d, "part").filter("p_size in (1, 3)").orderBy("p_partkey").limit(25).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 3) ORDER BY p_partkey LIMIT 25")
_add("augment_merge", lambda spark, d: transform.merged(_table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), _table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"]), "SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size < 25 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
_add(
    "population_stats",
    _graph(lambda p: p.agg(F.count("*").alias("people"), F.count_if(F.col("spouse_id").isNotNull()).alias("married"), F.count_if(F.col("spouse_id").isNull()).alias("single"), F.count_distinct("father_id").alias("fathers"))),
    _sql("SELECT count(*) AS people, count(spouse_id) AS married, count(*) - count(spouse_id) AS single, count(DISTINCT father_id) AS fathers FROM person"),
)


_ASKED = "CASE p_partkey % 3 WHEN 0 THEN 'How many are there?' WHEN 1 THEN 'What is their actual biological relationship?' ELSE 'Who are they?' END"
_SAID = """CASE WHEN p_partkey % 11 = 0 THEN '[ERROR: none]' WHEN p_partkey % 3 = 0 THEN 'There are ' || CAST(p_size + p_partkey % 2 AS STRING) || ' of them.'
  WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 4 < 2 THEN 'He is the paternal uncle.' ELSE 'A cousin' END ELSE CASE WHEN p_partkey % 4 < 2 THEN 'Larry Williams and Ann Brown' ELSE 'Ann Brown, Sam Hill and ann brown' END END"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part")
    q = part.select(F.col("p_partkey").cast("string").alias("question_id"), F.expr(_ASKED).alias("question_text"), (F.col("p_partkey") % 4 + 1).cast("int").alias("category"), (F.col("p_partkey") % 5 + 1).cast("int").alias("n_hops"), F.element_at(F.array(*map(F.lit, K.SYSTEMS)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("kinship_system"), (F.col("p_partkey") % 2 == 0).alias("has_cultural_override"), F.lit("b").alias("bio_term"), F.lit(None).cast("string").alias("kin_term"), F.expr("CASE p_partkey % 3 WHEN 0 THEN cast(p_size AS VARIANT) WHEN 1 THEN cast('paternal uncle (FB)' AS VARIANT) ELSE cast(array('Larry Williams', 'Ann Brown') AS VARIANT) END").alias("ground_truth"))
    r = part.select(F.col("p_partkey").cast("string").alias("question_id"), F.expr(_SAID).alias("response"), F.lit(0.5).alias("response_time"))
    return evaluation.evaluated(q, r)


_EV = f"""ev AS (SELECT p_partkey::VARCHAR AS question_id, (p_partkey % 4 + 1)::INT AS category, (p_partkey % 5 + 1)::INT AS n_hops, ([{', '.join(f"'{x}'" for x in K.SYSTEMS)}])[p_partkey % 7 + 1] AS kinship_system, p_partkey % 2 = 0 AS has_override, p_partkey % 11 = 0 AS is_error, p_partkey % 3 AS kind, 0.5::DOUBLE AS response_time,
  CASE WHEN p_partkey % 11 = 0 THEN 0.0 WHEN p_partkey % 3 = 0 THEN (p_partkey % 2 = 0)::INT::DOUBLE WHEN p_partkey % 4 < 2 THEN 1.0 WHEN p_partkey % 3 = 1 THEN 0.0 ELSE 0.5 END AS precision FROM part),
es AS (SELECT *, precision = 1.0 AS exact_match, precision > 0 AS partial_match, precision AS recall, precision AS f1 FROM ev)"""
_add("answers_scored", lambda spark, d: _answers(spark, d).select("question_id", "category", "n_hops", "kinship_system", "has_override", "is_error", "exact_match", "partial_match", "precision", "recall", "f1", "response_time"), f"WITH {_EV} SELECT question_id, category, n_hops, kinship_system, has_override, is_error, exact_match, partial_match, precision, recall, f1, response_time FROM es")
_MEANS = ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in ("exact_match", "partial_match", "precision", "recall", "f1"))
_add(
    "answers_breakdown",
    lambda spark, d: _rounded(evaluation.breakdown(_answers(spark, d), "kinship_system"), "exact_match", "partial_match", "precision", "recall", "f1"),
    f"""WITH {_EV} SELECT kinship_system, CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(n_hops) = 0 THEN 'hops' WHEN grouping(has_override) = 0 THEN 'override' ELSE 'overall' END AS part,
    CASE WHEN grouping(category) = 0 THEN 'cat_' || category WHEN grouping(n_hops) = 0 THEN 'hop_' || n_hops WHEN grouping(has_override) = 0 THEN CASE WHEN has_override THEN 'with_override' ELSE 'no_override' END ELSE 'all' END AS value,
    count(*) AS total, {_MEANS}, count(*) FILTER (is_error) AS errors, sum(response_time) AS seconds FROM es GROUP BY GROUPING SETS ((kinship_system), (kinship_system, category), (kinship_system, n_hops), (kinship_system, has_override))""",
)
_add(
    "systems_table",
    lambda spark, d: _rounded(evaluation.systems_table(_answers(spark, d)), "exact", "f1", "cat1", "cat2", "cat3", "cat4"),
    f"WITH {_EV} SELECT kinship_system, count(*) AS total, round(avg(exact_match::DOUBLE) * 100, 6) AS exact, round(avg(f1) * 100, 6) AS f1, " + ", ".join(f"round(coalesce(avg(exact_match::DOUBLE) FILTER (category = {k}) * 100, 0), 6) AS cat{k}" for k in (1, 2, 3, 4)) + " FROM es GROUP BY kinship_system",
)
_add("western_means", lambda spark, d: _rounded(evaluation.western_means(_answers(spark, d)), "macro_mean"), f"WITH {_EV} SELECT kinship_system IN ('eskimo', 'sudanese') AS western, round(avg(m), 6) AS macro_mean, count(*) AS systems FROM (SELECT kinship_system, avg(exact_match::DOUBLE) AS m FROM es GROUP BY ALL) GROUP BY ALL")
_add(
    "taxonomy_by_system",
    lambda spark, d: evaluation.taxonomy(_pairs(spark, d).select(F.element_at(F.array(*map(F.lit, K.SYSTEMS)), F.col("m").cast("int")).alias("kinship_system"), "predicted", "gold", F.array(F.lit("A")).alias("default")), ["over_inclusion", "partial_overlap", "default_substitution", "wrong_disjoint"]),
    f"""WITH {_SC}, m AS (SELECT l_orderkey, min(l_linenumber) AS m FROM lineitem GROUP BY ALL), c AS (SELECT ([{', '.join(f"'{x}'" for x in K.SYSTEMS)}])[m] AS kinship_system, CASE WHEN len(list_intersect(p, g)) = len(g) THEN 'over' WHEN len(list_intersect(p, g)) = len(p) THEN 'under' WHEN partial_match THEN 'overlap' WHEN p = ['A'] THEN 'default' ELSE 'disjoint' END AS class FROM s JOIN m USING (l_orderkey) WHERE NOT exact_match)
    SELECT kinship_system, count(*) FILTER (class = 'over') AS over_inclusion, count(*) FILTER (class = 'overlap') AS partial_overlap, count(*) FILTER (class = 'default') AS default_substitution, count(*) FILTER (class = 'disjoint') AS wrong_disjoint FROM c GROUP BY ALL""",
)
_PS = "l_returnflag AS kinship_system, l_linenumber AS pattern_idx, l_quantity > 25 AS original_exact_match, l_quantity / 50 AS original_f1, l_tax > 0.04 AS exact_match, l_discount * 10 AS f1"
_add(
    "paraphrase_summary",
    lambda spark, d: evaluation.paraphrase_summary(_table(spark, d, "lineitem").selectExpr(*_PS.split(", "))).select("part", "value", "n", "flips", *[F.round(c, 1).alias(c) for c in ("orig_em", "para_em", "orig_f1")]),
    f"""SELECT CASE WHEN grouping(kinship_system) = 0 THEN 'system' WHEN grouping(pattern_idx) = 0 THEN 'pattern' ELSE 'overall' END AS part, CASE WHEN grouping(kinship_system) = 0 THEN kinship_system WHEN grouping(pattern_idx) = 0 THEN pattern_idx::VARCHAR ELSE 'all' END AS value, count(*) AS n,
    count(*) FILTER (original_exact_match <> exact_match) AS flips, round(round(avg(original_exact_match::DOUBLE) * 100, 2), 1) AS orig_em, round(round(avg(exact_match::DOUBLE) * 100, 2), 1) AS para_em, round(round(avg(original_f1) * 100, 2), 1) AS orig_f1 FROM (SELECT {_PS} FROM lineitem) GROUP BY GROUPING SETS ((), (kinship_system), (pattern_idx))""",
)


def _prompted(spark: SparkSession, d: str, **options) -> DataFrame:
    q = _table(spark, d, "part").select("p_partkey", F.col("p_name").alias("question_text"), F.col("p_type").alias("context"), (F.col("p_partkey") % 4 + 1).cast("int").alias("category"), F.element_at(F.array(*map(F.lit, K.SYSTEMS)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("kinship_system"))
    return prompts.with_prompts(q, **options).select("p_partkey", "prompt")


def _filled(wording: str, **parts: str) -> str:
    out = "'" + wording.replace("'", "''") + "'"
    for k, v in ({"context": "p_type", "question": "p_name"} | parts).items():
        out = out.replace(f"{{{k}}}", f"' || {v} || '")
    return out


_RULE = "coalesce('Cultural Rule: ' || (MAP {" + ", ".join(f"'{k}': '" + v.replace("'", "''") + "'" for k, v in prompts.RULES.items()) + "})[([" + ", ".join(f"'{x}'" for x in K.SYSTEMS) + "])[p_partkey % 7 + 1]] || chr(10) || chr(10), '')"
_add("prompts_direct", lambda spark, d: _prompted(spark, d, rules=True), f"SELECT p_partkey, {_filled(prompts.DIRECT, rule=_RULE)} AS prompt FROM part")
for _style in prompts.STYLES:
    _add(f"prompts_{_style}", lambda spark, d, s=_style: _prompted(spark, d, protocol="zero_shot_cot", style=s), f"SELECT p_partkey, {_filled(prompts.STYLES[_style])} AS prompt FROM part")


def _few_shot(spark: SparkSession, d: str) -> DataFrame:
    shown = _table(spark, d, "supplier").filter("s_suppkey < 6").select(F.when(F.col("s_suppkey") < 4, 2).otherwise(3).alias("category"), F.lit("c").alias("context"), F.col("s_name").alias("question_text"), F.lit("r").alias("reasoning"), F.lit("a").alias("answer"), F.col("s_suppkey").alias("place"))
    return _prompted(spark, d, protocol="few_shot_cot", examples=shown)


_BLOCK = "chr(10) || '--- Example ' || k || ' ---' || chr(10) || 'Context: c' || chr(10) || 'Question: ' || s_name || chr(10) || 'Reasoning: r' || chr(10) || 'FINAL ANSWER: a' || chr(10)"
_add(
    "prompts_few_shot",
    _few_shot,
    f"""WITH x AS (SELECT s_name, s_suppkey AS place, CASE WHEN s_suppkey < 4 THEN 2 ELSE 3 END AS cat FROM supplier WHERE s_suppkey < 6),
    e AS (SELECT cat, string_agg({_BLOCK}, '' ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY place) AS k FROM x) WHERE k <= 3 GROUP BY cat UNION ALL
      SELECT NULL, string_agg({_BLOCK}, '' ORDER BY k) FROM (SELECT *, row_number() OVER (ORDER BY place) AS k FROM x) WHERE k <= 3)
    SELECT p_partkey, {_filled(prompts.FEW_SHOT, examples="coalesce(m.t, r.t)")} AS prompt FROM part LEFT JOIN e m ON m.cat = p_partkey % 4 + 1 JOIN e r ON r.cat IS NULL""",
)


def _known(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_system_sample(_table(spark, d, "part").select(F.col("p_brand").alias("kinship_system"), "p_partkey"), key="p_partkey")


_add("per_system_sample", _known, "SELECT kinship_system, p_partkey FROM (SELECT p_brand AS kinship_system, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42|' || p_partkey), p_partkey) AS k FROM part) WHERE k <= 10")
_add("question_counts", lambda spark, d: _pairs(spark, d).groupingSets([["category"], ["n_hops"]], "category", "n_hops").agg(F.count("*").alias("n")), f"WITH {_SC} SELECT category, n_hops, count(*) AS n FROM s GROUP BY GROUPING SETS ((category), (n_hops))")


def _bootstrap(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    counts = li.groupBy(F.col("l_returnflag").alias("model"), F.when(F.col("l_linenumber") <= 2, "a").otherwise("b").alias("side")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("exact"))
    return _rounded(metrics.bootstrap_gap(counts), "gap", "lo", "hi")


_U = "(('0x' || substr(md5('0|' || replicate || '|' || model || '|' || side), 1, 7))::BIGINT::DOUBLE / 268435456)"
_add(
    "bootstrap_ci",
    _bootstrap,
    f"""WITH c AS (SELECT l_returnflag AS model, CASE WHEN l_linenumber <= 2 THEN 'a' ELSE 'b' END AS side, count(*) AS n, count(*) FILTER (l_quantity > 25) AS exact FROM lineitem GROUP BY ALL),
    p AS (SELECT *, exact / n AS p, sqrt(n * (exact / n) * (1 - exact / n)) AS sd, CASE side WHEN 'a' THEN 1 ELSE -1 END AS sign FROM c),
    k AS (SELECT n, exact, unnest(range(greatest(0, floor(exact - 9 * sd) - 10)::BIGINT, least(n, ceil(exact + 9 * sd) + 10)::BIGINT + 1)) AS k FROM (SELECT DISTINCT n, exact, sd FROM p)),
    l AS (SELECT *, sum(CASE WHEN k = k0 THEN 0 ELSE ln((n - k + 1) / k) + ln(exact / (n - exact)) END) OVER (PARTITION BY n, exact ORDER BY k) AS l FROM (SELECT *, min(k) OVER (PARTITION BY n, exact) AS k0 FROM k)),
    w AS (SELECT n, exact, k, exp(l - max(l) OVER (PARTITION BY n, exact)) AS w FROM l),
    h AS (SELECT n, exact, k, sum(w) OVER (PARTITION BY n, exact ORDER BY k) / sum(w) OVER (PARTITION BY n, exact) AS hi FROM w),
    t AS (SELECT n, exact, k, coalesce(lag(hi) OVER (PARTITION BY n, exact ORDER BY k), 0) AS lo FROM h),
    u AS (SELECT model, n, exact, sign, replicate, {_U} AS u FROM p, range(10000) AS x(replicate)),
    d AS (SELECT replicate, model, sum(sign * (k / u.n)) AS gap FROM u ASOF JOIN t ON u.n = t.n AND u.exact = t.exact AND u.u >= t.lo GROUP BY ALL),
    g AS (SELECT avg(gap) AS gap FROM d GROUP BY replicate)
    SELECT round((SELECT avg(gap) FROM (SELECT sum(sign * p) AS gap FROM p GROUP BY model)), 6) AS gap, round(quantile_cont(gap, 0.025), 6) AS lo, round(quantile_cont(gap, 0.975), 6) AS hi FROM g""",
)


def queries() -> dict:
    """Name -> callable (spark, sf_dir) -> DataFrame."""
    from . import graph_queries

    return QUERIES | graph_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    from . import graph_queries

    return ORACLES | graph_queries.ORACLES
