"""Cost of model calls by provider: errors, latency, throughput, memory, time left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .quantiles import LATENCY, grouped_quantiles


def provider_stats(calls: DataFrame) -> DataFrame:
    """Counts, rates and latencies of each provider's calls; what has no basis is null, not 0."""
    settled = F.col("parser") != "error"
    timed = F.col("completion_tokens").isNotNull() & (F.col("latency_ms") != 0)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    speed = grouped_quantiles(calls.filter(settled), ["provider_id"], "latency_ms", LATENCY)
    return calls.groupBy("provider_id").agg(
        F.count("*").alias("total"), F.count_if(~settled).alias("errors"), ratio(F.count_if(~settled), F.count("*")).alias("error_rate"),
        ratio(F.count_if(settled & F.col("format_valid")), F.count_if(settled)).alias("format_rate"),
        F.min(F.when(settled, F.col("latency_ms"))).alias("min_ms"), F.max(F.when(settled, F.col("latency_ms"))).alias("max_ms"),
        F.avg(F.when(settled, F.col("completion_tokens"))).alias("avg_tokens"),
        F.try_divide(F.sum(F.when(settled & timed, F.col("completion_tokens"))).cast("double"), F.sum(F.when(settled & timed, F.col("latency_ms"))) / 1000).alias("tokens_per_second"),
        F.max("created_at").alias("last_used"),
    ).join(speed, "provider_id", "left")


def run_throughput(runs: DataFrame) -> DataFrame:
    """Responses a second over each provider's runs that took time."""
    some = runs.filter("runtime_seconds > 0").groupBy("provider_id").agg(F.sum("completed").alias("completed"), F.sum("runtime_seconds").alias("seconds"))
    return some.select("provider_id", F.try_divide(F.col("completed").cast("double"), F.col("seconds")).alias("responses_per_second"))


def latest_memory(runs: DataFrame) -> DataFrame:
    """Each provider's newest memory reading."""
    return runs.filter("memory_bytes is not null").groupBy("provider_id").agg(F.max_by("memory_bytes", "created_at").alias("memory_bytes"))


def provider_performance(providers: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Every provider, also those without history, with its statistics, throughput and observable memory."""
    out = providers.select(F.col("id").alias("provider_id"), "name", "kind", "is_demo")
    out = out.join(provider_stats(calls), "provider_id", "left").join(run_throughput(runs), "provider_id", "left").join(latest_memory(runs), "provider_id", "left")
    seen = (F.col("kind") == "ollama") & ~F.col("is_demo")
    return out.withColumns({"total": F.coalesce("total", F.lit(0)), "errors": F.coalesce("errors", F.lit(0)), "memory_bytes": F.when(seen, F.col("memory_bytes")), "memory_observable": seen})


def performance_warnings(performance: DataFrame) -> DataFrame:
    rows = [
        performance.filter("total - errors < 5").select("provider_id", F.lit("fewer than 5 settled calls").alias("warning")),
        performance.filter("total >= 5 and error_rate > 0.1").select("provider_id", F.lit("over 10 % errors")),
        performance.filter("not memory_observable").select("provider_id", F.lit("memory cannot be observed")),
    ]
    return rows[0].union(rows[1]).union(rows[2])


def eta(calls: DataFrame, runs: DataFrame, window: int = 200) -> DataFrame:
    """Seconds left of each provider's running runs: the median of its latest settled latencies times what is pending.

    0 without anything pending, null without history.  ``window`` rows a
    provider are kept by a ranked window with a group limit, before the shuffle.
    """
    last = F.row_number().over(W.partitionBy("provider_id").orderBy(F.desc("id")))
    recent = calls.filter("parser != 'error' and latency_ms is not null").withColumn("rn", last).filter(F.col("rn") <= window)
    speed = recent.groupBy("provider_id").agg(F.median("latency_ms").alias("median_ms"))
    pending = runs.filter("status = 'running'").groupBy("provider_id").agg(F.sum(F.greatest(F.col("total") - F.col("completed"), F.lit(0))).alias("pending"))
    out = pending.join(speed, "provider_id", "left")
    return out.withColumn("eta_seconds", F.when(F.col("pending") == 0, 0.0).otherwise(F.col("median_ms") * F.col("pending") / 1000))
