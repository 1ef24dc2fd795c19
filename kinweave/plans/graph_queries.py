"""Queries of the graph operators that take expressions, patterns and pairs, with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import kinship_terms as K
from ..operators import dataset as D
from ..operators import evaluation, paths
from ..operators import patterns as GP
from ..operators import regular_paths as RP
from ..operators.band import age_in_year, band_join
from ..sources import turtle as T
from ..sources.datasets import gold
from ..sources.shared import folder, written
from ..sources.turtle_format import TurtleSource
from ..streaming import answers
from . import registry as base

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


# --- regular paths --------------------------------------------------------------------------

_MOTHER, _FATHER, _PARENT, _CHILD = map(RP.step, ("hasMother", "hasFather", "hasParent", "hasChild"))
_SIBLING = RP.any_of("hasBrother", "hasSister")
#: Name -> expression: every ancestor; the collateral kin of up to three generations above and two below; the spouses' siblings of every descendant, the children walked as parents backwards; the maternal line's women, their brothers and the children of these.
EXPRESSIONS = {
    "regular_lineage": (_MOTHER | _FATHER).plus(),
    "regular_collateral": _PARENT.times(1, 3) + _SIBLING + _CHILD.times(0, 2),
    "regular_inlaws": (~_PARENT).star() + RP.step("hasSpouse") + _SIBLING,
    "regular_avunculate": _MOTHER.plus() + RP.step("hasBrother").maybe() + (~_FATHER).maybe(),
}


def regular_sql(path: RP.Path) -> str:
    """The walk of an expression's automaton as a recursive query; for expressions that go on for ever only along lines of descent."""
    plan = RP.automaton(path)
    moves = base._values([(s, pred, int(back), to) for s, pred, back, to in plan.moves])
    return base._sql(
        f"""SELECT anchor, node, min(dist)::INT AS dist, array_to_string(arg_min(word, (dist, word)), '/') AS word FROM rp WHERE state IN ({', '.join(map(str, sorted(plan.ends)))}) GROUP BY ALL""",
        *base._E, base._EDGE, f"mv(state, pred, back, nxt) AS (VALUES {moves})",
        "way AS MATERIALIZED (SELECT DISTINCT mv.state, mv.nxt, pred, back, CASE back WHEN 1 THEN dst ELSE src END AS a, CASE back WHEN 1 THEN src ELSE dst END AS b FROM edge JOIN mv USING (pred))",
        """rp AS (SELECT id AS anchor, 0 AS state, id AS node, 0 AS dist, []::VARCHAR[] AS word FROM person
          UNION ALL SELECT anchor, state, node, dist, min(word) FROM (SELECT r.anchor, w.nxt AS state, w.b AS node, r.dist + 1 AS dist, list_append(r.word, CASE back WHEN 1 THEN '^' ELSE '' END || pred) AS word FROM rp r JOIN way w ON w.a = r.node AND w.state = r.state) GROUP BY ALL)""",
    )


for _name, _path in EXPRESSIONS.items():
    _add(_name, base._graph(lambda p, x=_path: RP.reach(base._edges(p), p, x).withColumn("word", F.concat_ws("/", "word"))), regular_sql(_path))

_HOP = ("hasFather", "hasMother", "hasSpouse", "hasBrother", "hasSister", "hasSon", "hasDaughter")
_add(
    "regular_two_hops",
    base._graph(lambda p: RP.exactly(base._edges(p), p, list(_HOP), 2).withColumn("words", F.array_join(F.transform("words", lambda w: F.concat_ws("/", w)), ","))),
    base._sql(
        "SELECT anchor, node, string_agg(word, ',' ORDER BY word) AS words FROM (SELECT DISTINCT a.src AS anchor, b.dst AS node, a.pred || '/' || b.pred AS word FROM hop a JOIN hop b ON b.src = a.dst WHERE a.src <> b.dst) GROUP BY ALL",
        *base._E, base._EDGE, f"hop AS (SELECT DISTINCT * FROM edge WHERE pred IN {_HOP})",
    ),
)

# --- answers as a stream --------------------------------------------------------------------

#: A user's answers of one type, reported so many minutes after they were given; beyond DELAY they are late.
_DELAY = "30 MINUTES"


def _reported(events):
    """events as answers: k of props says how many minutes before ts the answer was given."""
    minutes = F.get_json_object("props", "$.k").cast("int")
    answered = F.col("ts").cast("timestamp") - F.make_dt_interval(mins=minutes)
    return events.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), answered.alias("answered"), F.col("ts").cast("timestamp").alias("arrived"), F.col("event_id").alias("seq"), F.col("value").cast("string").alias("response"))


def _stream_last(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    states = answers.replayed(spark, path, spark.read.parquet(path).schema, lambda s: answers.last_answers(_reported(s), _DELAY))
    return answers.merged(states).select("key", "n", "late", "seq", F.col("response").cast("double").alias("last_value"))


_add(
    "stream_last_answers",
    _stream_last,
    """WITH a AS (SELECT user_id || '/' || event_type AS key, event_id, value, regexp_extract(props, '"k": *(\\d+)', 1)::INT AS k, ts FROM events)
    SELECT key, count(*) AS n, count(*) FILTER (k > 30) AS late, arg_max(event_id, (ts - to_minutes(k), event_id)) FILTER (k <= 30) AS seq, arg_max(value, (ts - to_minutes(k), event_id)) FILTER (k <= 30) AS last_value FROM a GROUP BY key""",
)

# --- graph patterns -------------------------------------------------------------------------


def _triples(p):
    """The pedigree as a graph: types, labels, parents, spouses and siblings. The first and last two persons have no sex, for the optional part."""
    named = p.select("id", F.when((F.col("id") > 2) & F.col("spouse_id").isNotNull(), F.col("sex")).alias("sex"), F.concat(F.lit("P"), "id").alias("first_name"), F.concat(F.lit("of "), F.col("father_id").cast("string")).alias("surname"), F.lit(None).cast("int").alias("born"))
    return written(T.person_triples(named).unionByName(T.edge_triples(base._edges(p))))


_TRIPLES = """tr AS MATERIALIZED (SELECT DISTINCT subj, pred, obj FROM (
  SELECT 'person:person_' || id AS subj, unnest(['a', 'family:firstName', 'family:surname', 'rdfs:label', 'a']) AS pred, unnest(['family:Person', 'P' || id, 'of ' || father_id, 'P' || id || ' of ' || father_id, CASE WHEN id > 2 AND spouse_id IS NOT NULL THEN CASE sex WHEN 'M' THEN 'family:Male' ELSE 'family:Female' END END]) AS obj FROM person
  UNION ALL SELECT 'person:person_' || src, 'family:' || pred, 'person:person_' || dst FROM edge) WHERE obj IS NOT NULL)"""
_PERSON_OF = (("?person", "a", "family:Person"), ("?person", "rdfs:label", "?name"))
_SEX_OF = GP.Group(either=[GP.Group(("?person", "a", "family:Male"), bind={"gender": "male"}), GP.Group(("?person", "a", "family:Female"), bind={"gender": "female"})])
_add(
    "pattern_persons",
    base._graph(lambda p: GP.solutions(_triples(p), GP.Group(*_PERSON_OF, optional=[_SEX_OF]), "person", "name", "gender")),
    base._sql(
        """SELECT t.subj AS person, n.obj AS name, g.gender FROM tr t JOIN tr n ON n.subj = t.subj AND n.pred = 'rdfs:label'
        LEFT JOIN (SELECT subj, CASE obj WHEN 'family:Male' THEN 'male' ELSE 'female' END AS gender FROM tr WHERE pred = 'a' AND obj IN ('family:Male', 'family:Female')) g ON g.subj = t.subj
        WHERE t.pred = 'a' AND t.obj = 'family:Person'""",
        *base._E, base._EDGE, _TRIPLES,
    ),
)
_add(
    "pattern_uncles",
    base._graph(lambda p: GP.solutions(_triples(p), GP.Group(("?child", "family:hasFather", "?father"), ("?father", "family:hasBrother", "?uncle"), ("?uncle", "rdfs:label", "?name"), optional=[GP.Group(("?uncle", "family:hasWife", "?aunt"), ("?aunt", "a", "family:Female"))]), "child", "uncle", "name", "aunt")),
    base._sql(
        """SELECT f.subj AS child, b.obj AS uncle, n.obj AS name, w.aunt FROM tr f JOIN tr b ON b.subj = f.obj AND b.pred = 'family:hasBrother' JOIN tr n ON n.subj = b.obj AND n.pred = 'rdfs:label'
        LEFT JOIN (SELECT x.subj, x.obj AS aunt FROM tr x JOIN tr y ON y.subj = x.obj AND y.pred = 'a' AND y.obj = 'family:Female' WHERE x.pred = 'family:hasWife') w ON w.subj = b.obj WHERE f.pred = 'family:hasFather'""",
        *base._E, base._EDGE, _TRIPLES,
    ),
)
_add(
    "pattern_in_laws",
    base._graph(lambda p: GP.solutions(_triples(p), GP.Group(("?a", "family:hasSpouse", "?b"), either=[GP.Group(("?b", "family:hasBrother", "?c"), bind={"how": "brother"}), GP.Group(("?b", "family:hasMother", "?c"), bind={"how": "mother"})]), "a", "c", "how")),
    base._sql("SELECT s.subj AS a, t.obj AS c, CASE t.pred WHEN 'family:hasBrother' THEN 'brother' ELSE 'mother' END AS how FROM tr s JOIN tr t ON t.subj = s.obj AND t.pred IN ('family:hasBrother', 'family:hasMother') WHERE s.pred = 'family:hasSpouse'", *base._E, base._EDGE, _TRIPLES),
)


# --- Turtle as a data source ----------------------------------------------------------------


def _round_trip(p):
    """The pedigree's graph written and read through format("turtle"): what it says of each person."""
    spark = p.sparkSession
    spark.dataSource.register(TurtleSource)
    path = f"{folder(spark)}/kinweave/{uuid.uuid4().hex}.ttl"
    made = _triples(p).withColumn("system", F.lit("pedigree"))
    made.repartition("subj").sortWithinPartitions("subj").write.format("turtle").mode("append").save(path)
    back = spark.read.format("turtle").load(path)
    return back.groupBy("subj").agg(F.count("*").alias("n"), F.concat_ws("|", F.array_sort(F.collect_set(F.concat_ws(" ", "pred", "obj")))).alias("says"))


_add("turtle_format", base._graph(_round_trip), base._sql("SELECT subj, count(*) AS n, string_agg(pred || ' ' || obj, '|' ORDER BY pred || ' ' || obj) AS says FROM tr GROUP BY subj", *base._E, base._EDGE, _TRIPLES))


# --- bands and default answers --------------------------------------------------------------


def _couples(p):
    """Men and women born at most three years apart, by the man: a generation is 25 years, and each person's year moves by up to 24."""
    born = F.expr("1700 + 25 * cast(floor(log2(id + 1)) as int) + (id * 7) % 25 + id div 12")
    side = lambda sex, i, y: p.filter(F.col("sex") == sex).select(F.col("id").alias(i), born.alias(y))
    pairs = band_join(side("M", "a", "born_a"), side("F", "b", "born_b"), ("born_a", "born_b"), 3)
    return pairs.groupBy("a").agg(F.count("*").alias("n"), F.sum("b").alias("sum_b"), F.max(F.abs(age_in_year(F.col("born_a"), F.lit(2000)) - age_in_year(F.col("born_b"), F.lit(2000)))).cast("int").alias("gap"))


_add(
    "band_couples",
    base._graph(_couples),
    base._sql("SELECT a.id AS a, count(*) AS n, sum(b.id)::BIGINT AS sum_b, max(abs(a.y - b.y))::INT AS gap FROM y a JOIN y b ON a.sex = 'M' AND b.sex = 'F' AND abs(a.y - b.y) <= 3 GROUP BY a.id", "y AS (SELECT id, sex, 1700 + 25 * floor(log2(id + 1))::INT + (id * 7) % 25 + id // 12 AS y FROM person)"),
)

_RULES = [(s, p, t) for s, p, t, _ in K.overrides(True)]
_READ = sorted({(t, p) for _, _, t in _RULES for p in evaluation.default_paths(t)})


def _taxonomy(p):
    """Every question on an overridden path, answered in one of seven ways by anchor and path: right, by the biological reading, with the anchor added, a part only, not at all, by the anchor alone, a part with the anchor."""
    edges = written(base._edges(p))
    rules = p.sparkSession.createDataFrame(_RULES, "kinship_system string, path string, kin_term string")
    found = paths.traverse_all(edges, p, sorted({x for _, x, _ in _RULES})).filter("anchor <> node").groupBy("anchor", "path").agg(F.array_sort(F.collect_set("node")).alias("gold"))
    asked = written(found.join(F.broadcast(rules), "path"))
    df = evaluation.with_defaults(asked, edges)
    me, part = F.array("anchor"), F.slice("gold", 1, 1)
    ways = [F.col("gold"), F.col("default"), F.concat("gold", me), part, F.array().cast("array<int>"), me, F.concat(part, me)]
    answers = df.withColumn("predicted", F.element_at(F.array(*ways), (F.pmod(F.col("anchor") * 31 + F.length("path"), F.lit(7)) + 1).cast("int")))
    return evaluation.taxonomy(answers)


_add(
    "taxonomy_defaults",
    base._graph(_taxonomy),
    base._sql(
        """SELECT kinship_system, count(*) FILTER (class = 'over') AS over_inclusion, count(*) FILTER (class = 'default') AS default_substitution, count(*) FILTER (class = 'disjoint') AS wrong_disjoint, count(*) FILTER (class = 'overlap') AS partial_overlap, count(*) FILTER (class = 'under') AS partial_under, count(*) FILTER (class = 'empty') AS empty_format
        FROM (SELECT kinship_system, CASE WHEN len(p) = len(g) AND len(list_intersect(p, g)) = len(g) THEN NULL WHEN len(p) = 0 THEN 'empty' WHEN len(list_intersect(p, g)) = len(g) THEN 'over' WHEN len(list_intersect(p, g)) = len(p) THEN 'under' WHEN len(list_intersect(p, g)) > 0 THEN 'overlap' WHEN len(list_intersect(p, d)) = len(p) THEN 'default' ELSE 'disjoint' END AS class
          FROM (SELECT *, CASE (anchor * 31 + length(path)) % 7 WHEN 0 THEN g WHEN 1 THEN d WHEN 2 THEN list_append(g, anchor) WHEN 3 THEN g[1:1] WHEN 4 THEN [] WHEN 5 THEN [anchor] ELSE [g[1], anchor] END AS p FROM q)) WHERE class IS NOT NULL GROUP BY kinship_system""",
        *base._E, base._tree(sorted({x for _, x, _ in _RULES} | {x for _, x in _READ})),
        f"rules(kinship_system, path, kin_term) AS (VALUES {base._values(_RULES)}), readings(kin_term, reading) AS (VALUES {base._values(_READ)})",
        "gold AS MATERIALIZED (SELECT anchor, path, list(DISTINCT node ORDER BY node) AS g FROM tn WHERE anchor <> node GROUP BY ALL)",
        "def AS MATERIALIZED (SELECT anchor, kin_term, list(DISTINCT node) AS d FROM tn JOIN readings ON reading = path WHERE anchor <> node GROUP BY ALL)",
        "q AS (SELECT kinship_system, anchor, path, g, coalesce(d, []) AS d FROM gold JOIN rules USING (path) LEFT JOIN def USING (anchor, kin_term))",
    ),
)

# --- override questions of every system: augmentation and quotas ----------------------------


def _override_sql(system: str, rules: list[tuple[str, str]], quotas: dict[int, int], first: int, columns: str) -> str:
    """The first questions of each number of hops in the seeded order, by system, with ids from first on."""
    label = system.capitalize()
    quota = "CASE n_hops " + " ".join(f"WHEN {h} THEN {n}" for h, n in quotas.items()) + " END"
    return base._sql(
        f"""SELECT {columns} FROM (SELECT *, '{system}_' || lpad(({first - 1} + row_number() OVER (ORDER BY n_hops, r))::VARCHAR, 4, '0') AS question_id FROM (
        SELECT *, row_number() OVER (PARTITION BY n_hops ORDER BY md5('42|' || question_text), question_text, path) AS r FROM (
        SELECT *, row_number() OVER (PARTITION BY question_text, n_hops ORDER BY path, anchor) AS k FROM (SELECT anchor, path, bio_term, array_to_string(names, '|') AS names, len(string_split(path, '.'))::INT AS n_hops, kin_term, x.text AS question_text, x.answer AS answer FROM (SELECT *, unnest([
        {{'text': 'In the {label} kinship system, ' || CASE len(names) WHEN 1 THEN 'who is P' || anchor || '''s ' || kin_term ELSE 'who are P' || anchor || '''s ' || kin_term || 's' END || '?', 'answer': array_to_string(names, '|')}},
        {{'text': 'In the {label} system, ' || array_to_string(names, ', ') || CASE len(names) WHEN 1 THEN ' is called P' || anchor || '''s ''' || kin_term ELSE ' are called P' || anchor || '''s ''' || kin_term || 's' END || '''. What is their actual biological relationship?', 'answer': bio_term}},
        {{'text': 'List all of P' || anchor || '''s ' || kin_term || 's according to the {label} system.', 'answer': array_to_string(names, '|')}}]) AS x FROM rn JOIN ov USING (path) JOIN bio USING (path)))) WHERE k = 1) WHERE r <= {quota})""",
        *base._E, base._tree([p for p, _ in rules]), base._RN, base._BIO_EVERY, f"ov(path, kin_term) AS (VALUES {base._values(rules)})",
    )


def _further(p, system, hops, count, first):
    df = D.further(base._edges(p), base._people(p), system, hops, count, first)
    return df.select("question_id", "n_hops", "question_text", "kin_term", F.concat_ws("|", gold(F.col("ground_truth"))).alias("answer"))


def _overridden(p, system):
    """The category 4 part of a system's question set, by its quotas."""
    hops = {h for c, h, _ in D.QUOTAS if c == 4}
    found = D.path_ends(base._edges(p), base._people(p), [x for s, x, *_ in K.overrides() if s == system and x.count(".") + 1 in hops])
    rows = D.sampled(D.override_rows(found, system), system)
    return rows.select("question_id", "n_hops", "question_text", "path", "bio_term", "kin_term", F.concat_ws("|", "names").alias("names"))


for _system in ("hawaiian", "iroquois", "dravidian", "crow", "omaha"):
    for _hops, _count, _first in (((4,), D.FOUR_HOP_COUNT, D.FOUR_HOP_IDS), ((5, 6), D.LONG_HOP_COUNT, D.LONG_HOP_IDS)):
        _mine = [(p, t) for s, p, t, _ in K.overrides(True) if s == _system and p.count(".") + 1 in _hops]
        _name = f"augment_{_system}_{'_'.join(map(str, _hops))}hop"
        if _system != "crow":  # which the base registry has
            _add(_name, base._graph(lambda p, s=_system, h=_hops, n=_count, f=_first: _further(p, s, h, n, f)), _override_sql(_system, _mine, dict.fromkeys(_hops, _count), _first, "question_id, n_hops, question_text, kin_term, answer"))
    _quotas = {h: n for c, h, n in D.QUOTAS if c == 4}
    _mine = [(p, t) for s, p, t, _ in K.overrides() if s == _system and p.count(".") + 1 in _quotas]
    _add(f"question_set_{_system}_overrides", base._graph(lambda p, s=_system: _overridden(p, s)), _override_sql(_system, _mine, _quotas, 1, "question_id, n_hops, question_text, path, bio_term, kin_term, names"))
