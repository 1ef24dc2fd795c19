"""Evaluation end to end: answers joined to questions, scored, summed up and written out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinship_terms as K
from ..sources.datasets import gold
from ..sources.shared import discard, written
from . import paths, scoring

#: Characters of a response that a result keeps.
RAW = 1000

#: name -> callable(prompt, **options) -> text or None; further ones are put here by whoever has a text generator.
CONNECTORS: dict[str, Callable] = {}


def connector(name: str) -> Callable:
    """A registered text generator."""
    if name not in CONNECTORS:
        raise ValueError(f"unknown connector {name!r}; registered: {', '.join(sorted(CONNECTORS)) or 'none'}")
    return CONNECTORS[name]


def respond(prompts: DataFrame, generate: Callable[[str], str | None], prompt: str = "prompt", retries: int = 3, pause: float = 0.0, after: float = 0.0) -> DataFrame:
    """prompts with response and response_time from an outside text generator, called in the tasks. A call that raises is tried again, up to retries times with a pause that grows by its number; then the response is "[ERROR: ...]". None is an answer and isn't tried again. after is a rest between calls."""
    schema = f"{prompts.schema.simpleString()[7:-1]}, response:string, response_time:double"

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said, took = [], []
            for text in batch[prompt]:
                began, answer = time.time(), None
                for k in range(retries):
                    try:
                        answer = generate(text)
                        break
                    except Exception as e:  # noqa: BLE001  the generator is foreign code
                        answer = f"[ERROR: {str(e)[:100]}]"
                        if k + 1 < retries:
                            time.sleep(pause * (k + 1))
                said.append(answer)
                took.append(time.time() - began)
                time.sleep(after)
            yield batch.assign(response=said, response_time=took)

    return prompts.mapInPandas(asked, schema)


def resumed(prompts: DataFrame, generate: Callable[[str], str | None], path: str, key: str = "question_id", every: int = 10_000, rate: float | None = None, **settings) -> DataFrame:
    """prompts with their responses, of which the table at path holds those given so far: only prompts whose key it lacks are asked, in rounds of some every prompts, each of which is appended once it is whole. A run that is broken off asks no finished round again.

    rate: calls a second of all tasks together; each task gets its share as a bucket of one second's calls. Null and repeated keys are asked once, the prompt that comes first in order for a key. settings are respond()'s."""
    spark = prompts.sparkSession
    schema = respond(prompts, generate, **settings).schema
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = store.getFileSystem(spark._jsc.hadoopConfiguration())
    first = prompts.groupBy(key).agg(F.min(F.struct(*[c for c in prompts.columns if c != key])).alias("x")).select(key, "x.*").select(*prompts.columns)
    done = lambda: spark.read.schema(schema).parquet(path) if files.exists(store) else None
    have = done()
    left = first if have is None else first.join(have.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    left = written(left)
    rounds = -(-left.count() // every)
    tasks = spark.sparkContext.defaultParallelism
    for k in range(rounds):
        some = left.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == k).repartition(tasks)
        paced = _paced(generate, rate / tasks) if rate else generate
        respond(some, paced, **settings).write.mode("append").parquet(path)
    discard(left)
    out = done()
    return respond(first.limit(0), generate, **settings) if out is None else out


def _paced(generate: Callable, rate: float) -> Callable:
    """generate held to so many calls a second in a task: a bucket that fills at the rate and holds one second's calls, or one."""
    held = {"calls": max(1.0, rate), "at": None}

    def call(prompt: str) -> str | None:
        now = time.monotonic()
        held["calls"] = min(max(1.0, rate), held["calls"] + (now - (held["at"] or now)) * rate)
        held["at"] = now
        if held["calls"] < 1:
            time.sleep((1 - held["calls"]) / rate)
            held["calls"], held["at"] = 1.0, time.monotonic()
        held["calls"] -= 1
        return generate(prompt)

    return call


def evaluated(questions: DataFrame, responses: DataFrame, categories: list[int] | None = None, cot: bool = False) -> DataFrame:
    """One row for each question with a response (question_id, response, response_time; also model and protocol, if there): the question's fields with defaults for missing ones, what was read from the response, and the scores. Of several responses to one question by one model and protocol the last in time and text counts; responses to unknown questions go."""
    q = questions if categories is None else questions.filter(F.col("category").isin(*categories))
    by = ["question_id", *[c for c in ("model", "protocol") if c in responses.columns]]
    last = responses.groupBy(*by).agg(F.max(F.struct(F.coalesce("response_time", F.lit(0.0)).alias("t"), F.col("response").alias("r"))).alias("x"))
    last = last.select(*by, F.col("x.r").alias("response"), F.col("x.t").alias("response_time"))
    df = q.join(last, "question_id").withColumn("gold", gold(F.col("ground_truth")))
    df = scoring.score(df, cot=cot)
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    keys = [c for c in by if c != "question_id"]
    system = "system_name" if "system_name" in questions.columns else "kinship_system"
    return df.select(
        "question_id", *keys, default("category", 0), default("n_hops", 0), F.col(system).alias("kinship_system"), default("question_text", ""), "gold", "predicted", "exact_match", "partial_match", "precision", "recall", "f1", "response_time",
        F.coalesce("has_cultural_override", F.lit(False)).alias("has_override"), default("bio_term", ""), default("kin_term", ""), F.substring(F.coalesce("response", F.lit("")), 1, RAW).alias("raw_response"), "is_error",
    )


def breakdown(results: DataFrame, *by: str) -> DataFrame:
    """by, part (overall, category, hops, override), value, total, exact_match, partial_match, precision, recall, f1, errors, seconds: means over each part in one pass of grouping sets."""
    dims = ["category", "n_hops", "has_override"]
    g = results.groupingSets([[*by], *[[*by, d] for d in dims]], *by, *dims)
    mean = lambda c: (F.sum(F.col(c).cast("double")) / F.greatest(F.count("*"), F.lit(1))).alias(c)
    df = g.agg(*[F.grouping(d).alias(f"g_{d}") for d in dims], F.count("*").alias("total"), *[mean(c) for c in ("exact_match", "partial_match", "precision", "recall", "f1")], F.count_if("is_error").alias("errors"), F.sum("response_time").alias("seconds"))
    part = F.when(F.col("g_category") == 0, "category").when(F.col("g_n_hops") == 0, "hops").when(F.col("g_has_override") == 0, "override").otherwise("overall")
    value = F.when(F.col("g_category") == 0, F.concat(F.lit("cat_"), F.col("category").cast("string"))).when(F.col("g_n_hops") == 0, F.concat(F.lit("hop_"), F.col("n_hops").cast("string"))).when(F.col("g_has_override") == 0, F.when(F.col("has_override"), "with_override").otherwise("no_override")).otherwise("all")
    return df.select(*by, part.alias("part"), value.alias("value"), "total", "exact_match", "partial_match", "precision", "recall", "f1", "errors", "seconds")


def summary_documents(results: DataFrame, *by: str) -> DataFrame:
    """by, value: the breakdown as one JSON text each, with counts, accuracy, parts and timing."""
    b = breakdown(results, *by)
    stats = F.struct("total", "exact_match", "partial_match", "precision", "recall", "f1")
    of = lambda part: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("value", F.to_json(stats).alias("json"))))))
    all_ = lambda c: F.max(F.when(F.col("part") == "overall", F.col(c)))
    df = b.groupBy(*by).agg(all_("total").alias("total_questions"), all_("errors").alias("error_count"), F.max(F.when(F.col("part") == "overall", stats.dropFields("total"))).alias("accuracy"), of("category").alias("by_category"), of("hops").alias("by_hops"), of("override").alias("by_cultural_override"), all_("seconds").alias("seconds"))
    parts = {c: F.transform_values(c, lambda _, v: F.parse_json(v)).alias(c) for c in ("by_category", "by_hops", "by_cultural_override")}
    timing = F.struct(F.col("seconds").alias("total_seconds"), (F.col("seconds") / F.greatest("total_questions", F.lit(1))).alias("avg_per_question")).alias("timing")
    return df.select(*by, F.to_json(F.struct(*by, "total_questions", "error_count", "accuracy", *parts.values(), timing)).alias("value"))


def result_lines(results: DataFrame) -> DataFrame:
    """value: one JSON text for each result; with the summary documents they make up a results file."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def systems_table(results: DataFrame) -> DataFrame:
    """kinship_system, total, exact, f1 and the exact match of each category in percent, in the systems' usual order, unknown ones last."""
    place = F.coalesce(*[F.when(F.col("kinship_system") == s, k) for k, s in enumerate(K.SYSTEMS)], F.lit(len(K.SYSTEMS)))
    share = lambda c: F.avg(F.col(c).cast("double")) * 100
    overall = results.groupBy("kinship_system").agg(F.count("*").alias("total"), share("exact_match").alias("exact"), share("f1").alias("f1"))
    cats = results.groupBy("kinship_system").pivot("category", [1, 2, 3, 4]).agg(share("exact_match"))
    cats = cats.select("kinship_system", *[F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(f"cat{k}") for k in (1, 2, 3, 4)])
    return overall.join(cats, "kinship_system").orderBy(place, "kinship_system")


def western_means(results: DataFrame) -> DataFrame:
    """western, macro_mean, systems: the mean over systems of their exact match; systems that aren't known count as non-western."""
    each = results.groupBy("kinship_system").agg(F.avg(F.col("exact_match").cast("double")).alias("mean"))
    return each.groupBy(F.col("kinship_system").isin(*K.WESTERN).alias("western")).agg(F.avg("mean").alias("macro_mean"), F.count("*").alias("systems"))


#: The plain kin word in a cultural term, tried in order, and the paths by which someone reads it who takes it biologically.
DEFAULT_PATHS = (
    ("great-grandchild", ("C.C.C",)),
    ("grandchild", ("C.C",)),
    ("paternal grandfather", ("F.F",)),
    ("maternal grandmother", ("M.M",)),
    ("grandparent", ("F.F", "F.M", "M.F", "M.M")),
    ("niece/nephew", ("Sb.C",)),
    ("cousin", ("F.B.C", "F.Z.C", "M.B.C", "M.Z.C")),
    ("aunt", ("F.Z", "M.Z")),
    ("Athai", ("F.Z", "M.Z")),
    ("uncle", ("F.B", "M.B")),
    ("Mama", ("F.B", "M.B")),
    ("sibling", ("Sb",)),
    ("child", ("C",)),
    ("parent", ("F", "M")),
    ("father", ("F",)),
    ("mother", ("M",)),
)


def default_paths(term: str) -> tuple[str, ...]:
    """The biological reading of a cultural term; none of a term without a kin word."""
    return next((p for word, p in DEFAULT_PATHS if word in term), ())


def with_defaults(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """questions (anchor, kin_term and others) with default: the ids that the term's biological reading gives for the anchor, sorted, empty without any. The readings are a few rows a term; all of them are walked for all anchors at once."""
    spark = questions.sparkSession
    terms = [r["kin_term"] for r in questions.select("kin_term").dropna().distinct().collect()]  # the vocabulary's terms
    readings = [(t, p) for t in terms for p in default_paths(t)]
    if not readings:
        return questions.withColumn("default", F.array().cast("array<int>"))
    anchors = questions.select(F.col("anchor").alias("id")).dropna().distinct()
    reached = paths.traverse_all(edges, anchors, sorted({p for _, p in readings})).filter("anchor <> node")
    table = spark.createDataFrame(readings, "kin_term string, reading string")
    found = reached.join(F.broadcast(table), F.col("path") == F.col("reading")).groupBy("anchor", "kin_term").agg(F.array_sort(F.collect_set("node")).alias("default"))
    return questions.join(found, ["anchor", "kin_term"], "left").withColumn("default", F.coalesce("default", F.array().cast("array<int>")))


def taxonomy(answers: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """answers(kinship_system, predicted, gold, default) -> kinship_system and the number of wrong answers of each class, one column a class."""
    wrong = answers.withColumn("class", scoring.error_class(F.col("predicted"), F.col("gold"), F.col("default"))).filter("class is not null")
    names = classes or ["over_inclusion", "default_substitution", "wrong_disjoint", "partial_overlap", "partial_under", "empty_format"]
    df = wrong.groupBy("kinship_system").pivot("class", names).count()
    return df.select("kinship_system", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


def paraphrase_summary(pairs: DataFrame) -> DataFrame:
    """pairs(kinship_system, pattern_idx, original_exact_match, original_f1, exact_match, f1) -> part (overall, system, pattern), value, n, orig_em, para_em, delta_em, orig_f1, para_f1, delta_f1 (percent) and flips, in one pass."""
    g = pairs.groupingSets([[], ["kinship_system"], ["pattern_idx"]], "kinship_system", "pattern_idx")
    share = lambda c: F.avg(F.col(c).cast("double")) * 100
    df = g.agg(F.grouping("kinship_system").alias("gs"), F.grouping("pattern_idx").alias("gp"), F.count("*").alias("n"), share("original_exact_match").alias("oe"), share("exact_match").alias("pe"), share("original_f1").alias("of"), share("f1").alias("pf"), F.count_if(F.col("original_exact_match") != F.col("exact_match")).alias("flips"))
    part = F.when(F.col("gs") == 0, "system").when(F.col("gp") == 0, "pattern").otherwise("overall")
    value = F.when(F.col("gs") == 0, F.col("kinship_system")).when(F.col("gp") == 0, F.col("pattern_idx").cast("string")).otherwise("all")
    two = lambda c: F.bround(c, 2)
    return df.select(part.alias("part"), value.alias("value"), "n", two(F.col("oe")).alias("orig_em"), two(F.col("pe")).alias("para_em"), two(F.col("pe") - F.col("oe")).alias("delta_em"), two(F.col("of")).alias("orig_f1"), two(F.col("pf")).alias("para_f1"), two(F.col("pf") - F.col("of")).alias("delta_f1"), "flips")


def per_system_sample(rows: DataFrame, count: int = 10, seed: int = 42, key: str = "question_id") -> DataFrame:
    """Up to count rows of each kinship_system, by a seeded hash."""
    rank = F.row_number().over(Window.partitionBy("kinship_system").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= count).drop("rank")


def percent(share: Column) -> Column:
    """A share as text, in percent with one decimal."""
    return F.concat(F.format_number(F.bround(share * 100, 1), 1), F.lit("%"))
