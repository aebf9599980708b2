"""Structured Streaming forms: incremental fragility, provider statistics, consensus and resumable runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pairs, share
from ..operators.agreement import resolve_labels
from ..operators.runs import GRID_KEY


def votes(responses: DataFrame) -> DataFrame:
    """Running votes of each unit of a stream of responses; use with output mode ``update``."""
    return responses.groupBy("run_id", "question_id", "image_id", "variant_id").agg(F.count_if(F.col("answer") == "yes").alias("y"), F.count_if(F.col("answer") == "no").alias("n"))


def provider_windows(calls: DataFrame, time_col: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Calls, errors and mean latency of each provider in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    settled = F.col("parser") != "error"
    out = calls.withWatermark(time_col, late).groupBy(F.window(time_col, width), "provider_id").agg(F.count("*").alias("total"), F.count_if(~settled).alias("errors"), F.avg(F.when(settled, F.col("latency_ms"))).alias("mean_ms"))
    return out.withColumn("error_rate", share("errors", "total"))


def drift_of(votes_table: DataFrame) -> DataFrame:
    """Repeat drift of each run from its votes, as a batch over the state that ``votes`` has written."""
    out = votes_table.groupBy("run_id").agg(F.sum(pairs(F.col("y") + F.col("n"))).alias("comparable"), F.sum(F.col("y") * F.col("n")).alias("disagreeing"))
    return out.withColumn("drift", 100 * share("disagreeing", "comparable"))


def consensus_of_changes(read_labels: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: cases with new labels are resolved anew over all their labels, and only those are written."""

    def run(batch: DataFrame, _: int) -> None:
        changed = batch.select("image_id", "question_id").distinct()
        write(resolve_labels(read_labels().join(changed, ["image_id", "question_id"], "left_semi")))

    return run


def resume(pending: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run still has to do: units without a response free of error. Repeating it changes nothing."""
    return pending.join(done.filter("error is null").select(*GRID_KEY).distinct(), GRID_KEY, "left_anti")


def last_write(responses: DataFrame) -> DataFrame:
    """The last write of each unit of a stream (output mode ``update``): later ``created_at`` wins."""
    value = F.struct("answer", "format_valid", "parser")
    return responses.groupBy("run_id", *GRID_KEY).agg(F.max_by(value, "created_at").alias("r")).select("run_id", *GRID_KEY, "r.*")
