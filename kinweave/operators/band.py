"""Band joins: rows of two tables whose numbers differ by a width at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of one side in a bin that one task is to hold; larger bins are split.
BIN_ROWS = 100_000


def age_in_year(born: Column, year: Column) -> Column:
    """Years from birth to a year; null where either is unknown."""
    return year - born


def band_join(left: DataFrame, right: DataFrame, on: tuple[str, str], width: float, by: tuple[str, str] | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """All pairs of a left and a right row with abs(left[on[0]] - right[on[1]]) <= width, and equal columns by, if given; the columns of both, which must have different names.

    An equi-join on bins as wide as the band: a right row lies in one bin, a left row is looked for in three, and the
    band itself is checked after. A bin with more than bin_rows left rows is split: its left rows are dealt to parts by their hash,
    its right rows are repeated for each part, so a crowded year is as many tasks as it needs. The counts that say so
    are one row a bin over bin_rows.

    Defined cases: null and NaN numbers, and null columns by, meet nothing; repeated rows make a pair each; a width of 0 joins equal numbers, a negative one nothing; an empty side gives an empty table."""
    if clash := {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    step = width if width > 0 else 1
    l, r = F.col(on[0]).cast("double"), F.col(on[1]).cast("double")
    number = lambda c: c.isNotNull() & ~F.isnan(c)
    at = F.floor(l / step)
    side = lambda c: F.col(c) if by else F.lit(0)
    one = left.filter(number(l) & side(by[0] if by else "").isNotNull()).withColumn("__bin", F.explode(F.array(at - 1, at, at + 1))).withColumn("__by", side(by[0] if by else ""))
    two = right.filter(number(r) & side(by[1] if by else "").isNotNull()).withColumn("__bin", F.floor(r / step)).withColumn("__by", side(by[1] if by else ""))
    full = written(one.groupBy("__by", "__bin").agg(F.count("*").alias("__n")).filter(F.col("__n") > bin_rows).select("__by", "__bin", F.ceil(F.col("__n") / bin_rows).cast("int").alias("__parts")))
    whole = F.coalesce("__parts", F.lit(1))
    one = one.join(full, ["__by", "__bin"], "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), whole).cast("int"))
    two = two.join(full, ["__by", "__bin"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), whole - 1)))
    both = one.drop("__parts").join(two.drop("__parts"), ["__by", "__bin", "__part"])
    return both.filter(F.abs(l - r) <= width).select(*left.columns, *right.columns)
