"""Question sets, examples and result documents as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem

#: The question schema; ground_truth is a text, a number or a list.
QUESTION = """question_id string, question_text string, category int, n_hops int, kinship_system string, anchor_person string, anchor_name string,
target_persons array<string>, target_names array<string>, ground_truth variant, context string, path array<string>, bio_term string, kin_term string,
has_cultural_override boolean, proof_graph_size int"""
#: What relabelling adds.
RELABELLED = "kinship_system_original string, fictional_label string, fictional_mode string"
EXAMPLE = "category int, context string, question_text string, reasoning string, answer string"


def read_questions(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """The questions of all JSON-lines files under path (a glob is fine) with system_name, the file's stem without "_dataset" and "_natural". Fields that a row lacks are null, but has_cultural_override is false, and unreadable lines are left out; more names further columns, as a schema."""
    schema = QUESTION + (f", {more}" if more else "") + ", _corrupt string"
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.withColumn("system_name", F.regexp_replace(file_stem(F.col("_metadata.file_path")), "_dataset|_natural", ""))
    return df.filter("_corrupt is null").drop("_corrupt").fillna(False, ["has_cultural_override"])


def dataset_path(spark: SparkSession, folder: str, system: str) -> str | None:
    """<system>_dataset.jsonl, else <system>.jsonl under folder, else None; asks the file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in (f"{system}_dataset.jsonl", f"{system}.jsonl"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(conf).exists(path):
            return f"{folder}/{name}"
    return None


def gold(ground_truth: Column) -> Column:
    """A ground truth as array<string>: a list as it is, anything else as its one text."""
    listed, text = F.try_variant_get(ground_truth, "$", "array<string>"), ground_truth.cast("string")
    return F.coalesce(listed, F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text)))


def truth(names: Column, single: Column) -> Column:
    """names as a ground truth: its first text where single says so, else the list."""
    return F.when(single, names[0].cast("variant")).otherwise(names.cast("variant"))


def write_questions(questions: DataFrame, path: str, files: int | None = 1) -> None:
    """Questions as JSON lines, null fields written out, in so many files (None: as many as there are partitions)."""
    df = questions.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    (df.coalesce(files) if files else df).write.mode("overwrite").text(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """category, context, question_text, reasoning, answer, place: the worked examples of a JSON document, a list or lists by any key, in their order."""
    one = f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in EXAMPLE.split(', ')).replace(': ', ':')}>>"
    raw = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value"))
    lists = F.when(F.col("value").startswith("["), F.array(F.from_json("value", one))).otherwise(F.map_values(F.from_json("value", f"map<string,{one}>")))
    return raw.select(F.posexplode(F.flatten(lists)).alias("place", "x")).select("x.*", "place")


def summary_document(questions: DataFrame, system: str, config: dict | None = None) -> DataFrame:
    """value: one JSON text with kinship_system, total_questions, by_category, by_hops and config, from one pass over questions."""
    counts = questions.groupingSets([["category"], ["n_hops"]], "category", "n_hops").agg(F.count("*").alias("n"), F.grouping("n_hops").alias("cat"))
    of = lambda flag, key: F.map_from_entries(F.sort_array(F.collect_list(F.when((F.col("cat") == flag) & F.col(key).isNotNull(), F.struct(F.col(key).cast("string"), "n")))))
    df = counts.agg(F.coalesce(F.sum(F.when(F.col("cat") == 1, F.col("n"))), F.lit(0)).alias("total_questions"), of(1, "category").alias("by_category"), of(0, "n_hops").alias("by_hops"))
    own = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(str(v))) for k, v in sorted((config or {}).items())])) if config else F.create_map().cast("map<string,string>")
    return df.select(F.to_json(F.struct(F.lit(system).alias("kinship_system"), "total_questions", "by_category", "by_hops", own.alias("config"))).alias("value"))


def write_document(document: DataFrame, path: str) -> None:
    """A frame of one text as one file."""
    document.coalesce(1).write.mode("overwrite").text(path)
