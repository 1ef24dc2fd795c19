"""Path queries: all anchors and all paths at once, hop by hop, with set semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinship_terms import PREDICATES
from ..sources.shared import written


def traverse(edges: DataFrame, anchors: DataFrame, path: str) -> DataFrame:
    """anchor, node at the end of one path; distinct after each hop, the start is not excluded."""
    front = anchors.select(F.col("id").alias("anchor"), F.col("id").alias("node"))
    for code in path.split("."):
        step = edges.filter(F.col("pred") == PREDICATES[code]).select("src", "dst")
        front = front.join(step, F.col("node") == F.col("src")).select("anchor", F.col("dst").alias("node")).distinct()
    return front


def traverse_all(edges: DataFrame, anchors: DataFrame, paths: list[str]) -> DataFrame:
    """anchor, path, node for all paths. Paths share their prefixes: each prefix is walked once, so the work follows the prefix tree and not the list of paths."""
    return named(traverse_coded(edges, anchors, paths), paths)


def named(found: DataFrame, paths: list[str]) -> DataFrame:
    """found with path in place of code, the path's place in the list."""
    table = found.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(paths))), "code int, path string")
    return found.join(F.broadcast(table), "code").select("anchor", "path", *[c for c in found.columns if c not in ("anchor", "code")])


def traverse_coded(edges: DataFrame, anchors: DataFrame, paths: list[str]) -> DataFrame:
    """anchor, code, node for all paths, a path as its place in the list (repeated ones once). Rows of a walk are numbers only, predicates and prefixes among them."""
    spark = edges.sparkSession
    codes = {p: k for k, p in enumerate(dict.fromkeys(paths))}
    prefixes = [p for p in sorted({".".join(p.split(".")[:k]) for p in paths for k in range(1, p.count(".") + 2)}) if p not in codes]
    codes |= {p: -2 - k for k, p in enumerate(prefixes)}  # below 0: only on the way
    steps = {p: k for k, p in enumerate(sorted({PREDICATES[x.split(".")[-1]] for x in codes}))}
    tree = [(codes.get(x.rpartition(".")[0], -1), k, steps[PREDICATES[x.split(".")[-1]]], x.count(".") + 1) for x, k in codes.items()]
    tree = spark.createDataFrame(tree, "code int, longer int, step int, hop int")
    front = anchors.select(F.col("id").alias("anchor"), F.lit(-1).alias("code"), F.col("id").alias("node"))
    ends, last = [], max(p.count(".") for p in paths) + 1
    # Each hop reads the one before twice; long walks keep it as a table.
    keep = written if last > 3 else lambda df: df
    numbers = spark.createDataFrame(list(steps.items()), "pred string, step int")
    edges = keep(edges.join(F.broadcast(numbers), "pred").select("src", "step", "dst"))
    for hop in range(1, last + 1):
        grown = front.join(F.broadcast(tree.filter(F.col("hop") == hop).drop("hop")), "code")
        front = keep(grown.join(edges.withColumnRenamed("step", "by"), (F.col("node") == F.col("src")) & (F.col("step") == F.col("by"))).select("anchor", F.col("longer").alias("code"), F.col("dst").alias("node")).distinct())
        ends.append(front.filter("code >= 0"))
    return reduce(DataFrame.unionByName, ends)


def walk(edges: DataFrame, anchors: DataFrame, paths: list[str]) -> DataFrame:
    """anchor, prefix, hop, src, pred, dst: every edge walked from any anchor along any prefix of the paths, also those of walks that end early."""
    spark = edges.sparkSession
    prefixes = sorted({".".join(p.split(".")[:k]) for p in paths for k in range(1, p.count(".") + 2)})
    tree = spark.createDataFrame([(".".join(x.split(".")[:-1]), x, PREDICATES[x.split(".")[-1]], x.count(".") + 1) for x in prefixes], "prefix string, longer string, step_pred string, hop int")
    front, edges, steps = anchors.select(F.col("id").alias("anchor"), F.lit("").alias("prefix"), F.col("id").alias("node")), written(edges.select("src", "pred", "dst")), []
    for hop in range(1, max(x.count(".") for x in prefixes) + 2):
        grown = front.join(F.broadcast(tree.filter(F.col("hop") == hop)), "prefix")
        step = written(grown.join(edges, (F.col("node") == F.col("src")) & (F.col("step_pred") == F.col("pred"))).select("anchor", F.col("longer").alias("prefix"), "hop", "src", "pred", "dst").distinct())
        steps.append(step)
        front = step.select("anchor", "prefix", F.col("dst").alias("node")).distinct()
    return reduce(DataFrame.unionByName, steps)


def contexts(walked: DataFrame, people: DataFrame, paths: list[str]) -> DataFrame:
    """anchor, path, context (fact sentences by hop, each once), size (distinct persons plus edge rows) from walk()."""
    from ..functions.text import predicate_words

    of = walked.sparkSession.createDataFrame([(p, ".".join(p.split(".")[:k])) for p in paths for k in range(1, p.count(".") + 2)], "path string, prefix string")
    facts = walked.join(F.broadcast(of), "prefix").groupBy("anchor", "path", "src", "pred", "dst").agg(F.min("hop").alias("hop"), F.count("*").alias("n"))
    name = lambda c: people.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    facts = facts.join(name("src"), "src").join(name("dst"), "dst").withColumn("fact", F.concat("src_name", F.lit("'s "), predicate_words(F.col("pred")), F.lit(" is "), "dst_name", F.lit(".")))
    g = facts.groupBy("anchor", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "src", "dst", "fact"))), lambda x: x["fact"]).alias("facts"), F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))).alias("persons"))
    return g.select("anchor", "path", F.concat_ws(" ", "facts").alias("context"), (F.col("n") + F.col("persons")).cast("long").alias("size"))


def at_distance(edges: DataFrame, anchors: DataFrame, paths: list[str], hops: int) -> DataFrame:
    """anchor, node, paths: who is reached by which known paths of so many hops, but the anchor itself."""
    found = traverse_all(edges, anchors, [p for p in paths if p.count(".") + 1 == hops]).filter("anchor <> node")
    return found.groupBy("anchor", "node").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def context_edges(edges: DataFrame, anchors: DataFrame, path: str) -> DataFrame:
    """anchor, hop, src, pred, dst: every edge walked along a path (also those of walks that end early)."""
    front = anchors.select(F.col("id").alias("anchor"), F.col("id").alias("node"))
    out = None
    for k, code in enumerate(path.split(".")):
        step = edges.filter(F.col("pred") == PREDICATES[code]).select("src", "pred", "dst")
        walked = front.join(step, F.col("node") == F.col("src")).select("anchor", F.lit(k + 1).alias("hop"), "src", "pred", "dst").distinct()
        out = walked if out is None else out.unionByName(walked)
        front = walked.select("anchor", F.col("dst").alias("node")).distinct()
    return out


def proof(edges: DataFrame, anchors: DataFrame, path: str, label: str = "P") -> DataFrame:
    """anchor, context (fact sentences by hop, source and target, each once), size (distinct persons plus edge rows)."""
    from ..functions.text import predicate_words

    walked = context_edges(edges, anchors, path)
    name = lambda c: F.concat(F.lit(label), F.col(c).cast("string"))
    say = F.concat(name("src"), F.lit("'s "), predicate_words(F.col("pred")), F.lit(" is "), name("dst"), F.lit("."))
    facts = walked.groupBy("anchor", "src", "pred", "dst").agg(F.min("hop").alias("hop"), F.count("*").alias("n")).withColumn("fact", say)
    g = facts.groupBy("anchor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hop", "src", "dst", "fact"))), lambda x: x["fact"]).alias("facts"),
        F.sum("n").alias("n"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))).alias("persons"),
    )
    return g.select("anchor", F.concat_ws(" ", "facts").alias("context"), (F.col("n") + F.col("persons")).cast("long").alias("size"))
