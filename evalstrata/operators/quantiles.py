"""Exact quantiles from counts by value, without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What is said of latencies.
LATENCY = {"median_ms": 0.5, "p95_ms": 0.95}


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, of: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of a numeric column by ``keys``, exact; nulls of the column and of keys are left out.

    Rows are counted by value first, and the values lie in buckets 1/64 of a
    natural logarithm wide (at most some 90,000 a key).  A running sum over a
    key's buckets tells which ones hold the wanted ranks; only their values are
    ranked, a bucket at a time, so no task holds all values of a key.
    """
    v = F.col(value).cast("double")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("bucket", F.floor(F.signum("v") * F.log1p(F.abs("v")) * 64))
    sizes = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("size"))
    w = W.partitionBy(*keys)
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("size").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("size").over(w)})
    ranks = {name: (F.col("total") - 1) * F.lit(q) for name, q in of.items()}

    def inside(rank: Column) -> Column:
        return (rank >= F.col("before")) & (rank < F.col("before") + F.col("size"))

    wanted = F.lit(False)
    for at in ranks.values():
        wanted = wanted | inside(F.floor(at)) | inside(F.ceil(at))
    some = counts.join(sizes.filter(wanted), [*keys, "bucket"])
    upto = F.col("before") + F.sum("n").over(W.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    some = some.withColumn("upto", upto)
    picks = []
    for name, at in ranks.items():
        low, high = F.min(F.when(F.col("upto") > F.floor(at), F.col("v"))), F.min(F.when(F.col("upto") > F.ceil(at), F.col("v")))
        picks.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return some.groupBy(*keys).agg(*picks)


def quantiles(counts: DataFrame, value: str, of: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of a table of values with counts ``n``, in one row.

    ``counts`` has a row a distinct value; a running sum gives each its ranks.
    """
    upto = F.sum("n").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(W.partitionBy()))
    picks = []
    for name, q in of.items():
        at = (F.col("total") - 1) * F.lit(q)
        below, above = F.floor(at), F.ceil(at)
        low = F.min(F.when(F.col("upto") > below, F.col(value)))
        high = F.min(F.when(F.col("upto") > above, F.col(value)))
        part = F.max(at - F.floor(at))
        picks.append((low + (high - low) * part).alias(name))
    return ranked.agg(*picks)
