"""Exact order statistics of groups of any size, by histograms that are merged and refined; no group is ever sorted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

#: Bins of a histogram.
BINS = 256


def _written(df: DataFrame) -> DataFrame:
    path = work_dir(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_ranks(df: DataFrame, group: str, value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """group, n and, for each name in ranks, the value of that rank (from 0, by size): expressions over n, the number of the
    group's values. Null values don't count, null is a group like any other; a rank outside the group gives null.

    A pass counts, for every rank that is still open, the values between its bounds in BINS bins, with each bin's least and
    greatest value. The bin that holds the rank gives the next, narrower bounds; where they are equal, the value is found.
    Tasks merge their counts before the shuffle: a group takes at most BINS rows from each, whatever its size or skew, and
    values that repeat end in a bin of their own.
    """
    rows = df.select(F.struct(group).alias("g"), F.col(value).alias("v")).where("v IS NOT NULL")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("k")) for name, rank in ranks.items()])).alias("w")
    open_ = sizes.select("g", "n", "lo", "hi", F.lit(0).cast("long").alias("below"), wanted).select("g", "n", "lo", "hi", "below", "w.*")
    open_ = _written(open_.where(F.col("k").between(0, F.col("n") - 1)))
    found = [open_.where("lo = hi")]
    open_ = open_.where("lo < hi")
    while not open_.isEmpty():
        # The quotient is taken of halves, so that no difference of two doubles overflows.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.when(F.col("v") == F.col("hi"), BINS - 1).when(F.col("v") == F.col("lo"), 0).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1))).cast("int")
        inside = rows.join(open_.select("g", "name", "lo", "hi"), "g").where("v BETWEEN lo AND hi")
        bins = inside.groupBy("g", "name", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy("g", "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        placed = bins.withColumn("upto", upto).join(open_, ["g", "name"]).where("below + upto > k AND below + upto - c <= k")
        now = _written(placed.select("g", "n", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), "name", "k"))
        found.append(now.where("lo = hi"))
        open_ = now.where("lo < hi")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    each = every.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in ranks])
    return sizes.select("g", "n").join(each, "g", "left").select(f"g.{group}", "n", *ranks)


def median_of_positives(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the median (mean of the middle two) of the values above zero; groups without one are left out."""
    out = at_ranks(df.where(F.col(value) > 0), group, value, {"a": F.floor((F.col("n") - 1) / 2), "b": F.floor(F.col("n") / 2)})
    return out.select(group, ((F.col("a") + F.col("b")) / 2).alias("median"))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the upper of the middle two values."""
    return at_ranks(df, group, value, {"median": F.floor(F.col("n") / 2)}).select(group, "median")


def spread(df: DataFrame, group: str, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """group, spread: the value at the share `high` of the ranks less that at `low` (ranks rounded down)."""
    rank = lambda p: F.floor(F.lit(p) * (F.col("n") - 1))
    return at_ranks(df, group, value, {"low": rank(low), "high": rank(high)}).select(group, (F.col("high") - F.col("low")).alias("spread"))
