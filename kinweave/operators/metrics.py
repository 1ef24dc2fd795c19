"""Published analytics: ablation, bootstrap intervals, pivots and spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ablation(cells: DataFrame, by: list[str], mode: str = "mode", value: str = "em") -> DataFrame:
    """by, the four modes' means, delta_full, delta_sys, delta_term and the interaction: full less the sum of the single ones."""
    modes = ["real", "fictional", "system_only", "term_only"]
    df = cells.groupBy(*by).pivot(mode, modes).agg(F.avg(value))
    df = df.withColumns({"delta_full": F.col("fictional") - F.col("real"), "delta_sys": F.col("system_only") - F.col("real"), "delta_term": F.col("term_only") - F.col("real")})
    return df.withColumn("interaction", F.col("delta_full") - (F.col("delta_sys") + F.col("delta_term")))


def macro(scores: DataFrame, group: str, system: str = "system", value: str = "em") -> DataFrame:
    """The mean over systems of their means, by group."""
    return scores.groupBy(group, system).agg(F.avg(value).alias("mean")).groupBy(group).agg(F.avg("mean").alias("macro_mean"), F.count("*").alias("systems"))


def spread(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean with population and sample deviation."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.stddev_samp(value).alias("std_samp"), F.count("*").alias("n"))


def envelope(intervals: DataFrame, by: list[str]) -> DataFrame:
    """The least lower and greatest upper bound of several intervals."""
    return intervals.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


#: Resolution of a drawn number, and the draws' place in a text's MD5.
_DRAW = 1 << 28


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from parts by MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("double") / _DRAW


#: Standard deviations on either side of the mean that a table of draws holds: what lies beyond is less than 10^-17, below the resolution of a drawn number.
_REACH = 9
#: Bins of [0, 1) by which draws meet a table's intervals.
_BINS = 4096


def binomial_table(counts: DataFrame) -> DataFrame:
    """n, exact, k, lo, hi for each different (n, exact) of counts: a number in [lo, hi) of [0, 1) stands for k right answers of n where one is right with probability exact / n.

    Each k's weight follows from the one before by a ratio, so running sums give them all, and running
    sums of the weights the intervals. A table has some 18 standard deviations of rows, which is the
    root of n; shares of 0 and 1 have one row."""
    p = F.col("exact") / F.col("n")
    deviation = F.sqrt(F.col("n") * p * (1 - p))
    ends = [F.greatest(F.lit(0), F.floor(F.col("exact") - _REACH * deviation) - 10), F.least(F.col("n"), F.ceil(F.col("exact") + _REACH * deviation) + 10)]
    certain = (F.col("exact") == 0) | (F.col("exact") == F.col("n"))
    ks = F.when(certain, F.array(F.col("exact").cast("long"))).otherwise(F.sequence(ends[0].cast("long"), ends[1].cast("long")))
    df = counts.select("n", "exact").distinct().select("n", "exact", F.explode(ks).alias("k"))
    by = Window.partitionBy("n", "exact")
    ratio = F.log((F.col("n") - F.col("k") + 1) / F.col("k")) + F.log(F.col("exact") / (F.col("n") - F.col("exact")))
    first = F.col("k") == F.min("k").over(by)
    df = df.withColumn("step", F.when(first, 0.0).otherwise(ratio)).withColumn("log", F.sum("step").over(by.orderBy("k")))
    df = df.withColumn("weight", F.exp(F.col("log") - F.max("log").over(by)))
    upto, all_ = F.sum("weight").over(by.orderBy("k")), F.sum("weight").over(by)
    df = df.select("n", "exact", "k", (upto / all_).alias("hi"))
    last = F.col("k") == F.max("k").over(by)
    return df.select("n", "exact", "k", F.coalesce(F.lag("hi").over(by.orderBy("k")), F.lit(0.0)).alias("lo"), F.when(last, 2.0).otherwise(F.col("hi")).alias("hi"))


def binomial(draws: DataFrame, number: str = "u") -> DataFrame:
    """draws (n, exact and a number in [0, 1)) with k, the binomial draw that the number stands for: a range lookup in binomial_table(), by an equi-join on the bins that an interval touches."""
    at = F.floor(F.col(number) * _BINS)
    upto = F.least(F.floor(F.col("hi") * _BINS), F.lit(_BINS - 1))
    table = written(binomial_table(draws)).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * _BINS), F.greatest(upto, F.floor(F.col("lo") * _BINS)))))
    found = draws.withColumn("bin", at).join(table, ["n", "exact", "bin"]).filter((F.col("lo") <= F.col(number)) & (F.col(number) < F.col("hi")))
    return found.drop("bin", "lo", "hi")


def bootstrap_gap(counts: DataFrame, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """counts(model, side ('a' or 'b'), n, exact) -> gap, lo, hi: the mean over models of a's less b's share, with a percentile interval.

    How many of n resampled right-or-wrong answers are right is a binomial draw, made by inversion from an MD5 number of (seed, replicate, model, side), so
    any engine gives the same replicates, and the answers themselves aren't needed again. The counts are a few rows a model, repeated for each replicate."""
    signed = lambda x: F.when(F.col("side") == "a", x).otherwise(-x)
    key = [F.lit(str(seed)), F.col("replicate").cast("string"), F.col("model"), F.col("side")]
    draws = counts.filter("n > 0").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("u", uniform(*key))
    drawn = binomial(draws).select("replicate", "model", "side", (F.col("k") / F.col("n")).alias("share"))
    # The answers as they are go along as replicate -1.
    seen = counts.filter("n > 0").select(F.lit(-1).alias("replicate"), "model", "side", (F.col("exact") / F.col("n")).alias("share"))
    gaps = drawn.unionByName(seen).groupBy("replicate", "model").agg(F.sum(signed(F.col("share"))).alias("gap")).groupBy("replicate").agg(F.avg("gap").alias("gap"))
    ends = F.percentile(F.when(F.col("replicate") >= 0, F.col("gap")), F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    return gaps.agg(F.max(F.when(F.col("replicate") < 0, F.col("gap"))).alias("gap"), ends).select("gap", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
