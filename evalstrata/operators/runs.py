"""The run grid: what a run has to do, what is left, and the ledger of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GRID_KEY = ["image_id", "variant_id", "repetition"]


def grid(images: DataFrame, variants: DataFrame, repetitions: int) -> DataFrame:
    """Every (repetition, variant, image) of a run's configuration; variants are few, so they are the broadcast side."""
    reps = variants.select("variant_id", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    return images.select("image_id").crossJoin(F.broadcast(reps))  # the product is the result


def pending_units(grid_rows: DataFrame, responses: DataFrame) -> DataFrame:
    """The grid without what has a response free of error."""
    return grid_rows.join(responses.filter("parser != 'error'").select(*GRID_KEY).distinct(), GRID_KEY, "left_anti")


def last_written(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row a key, the last written."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(order.desc()))).filter("_rn = 1").drop("_rn")


def ledger(runs: DataFrame, status: str | None = None, provider: int | None = None, search: str = "", archived: bool = False, limit: int = 300) -> DataFrame:
    """Runs newest first, at most ``limit``; ``search`` is a substring of the lower-cased name."""
    out = runs.filter(F.col("archived_at").isNotNull() if archived else F.col("archived_at").isNull())
    if status is not None:
        out = out.filter(F.col("status") == status)
    if provider is not None:
        out = out.filter(F.col("provider_id") == provider)
    if search:
        out = out.filter(F.lower("name").contains(search.lower()))
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def project_counts(runs: DataFrame) -> DataFrame:
    """Live runs of each project by status, and its newest."""
    live = runs.filter("archived_at is null")
    return live.groupBy("project_id").agg(F.count("*").alias("runs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "running", "paused")], F.max("created_at").alias("newest"))


def clamp_config(repetitions: Column, temperature: Column, max_tokens: Column, timeout: Column) -> Column:
    """A run's settings inside their ranges."""
    inside = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    return F.struct(inside(repetitions, 1, 20).alias("repetitions"), inside(temperature, 0.0, 2.0).alias("temperature"), inside(max_tokens, 8, 1024).alias("max_tokens"), inside(timeout, 10, 900).alias("timeout"))


def resolve_variants(variants: DataFrame, questions: list[int], requested: list[int] | None = None) -> DataFrame:
    """Variants of the chosen questions, only the requested ones where any are; refuses a choice without variants."""
    out = variants.filter(F.col("question_id").isin(questions))
    if requested:
        out = out.filter(F.col("variant_id").isin(requested))
    if out.isEmpty():
        raise ValueError("no variant of the chosen questions is left")
    return out


# Which status may follow which.
NEXT_STATUS = {"queued": ("running", "cancelled"), "running": ("paused", "completed", "failed", "cancelled"), "paused": ("running", "cancelled"), "completed": (), "failed": ("running",), "cancelled": ()}


def restart(status: Column) -> Column:
    """What a restart makes of a status: active runs become paused."""
    return F.when(status.isin("queued", "running"), "paused").otherwise(status)


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 over the rows' canonical JSON (fields by name, nulls kept), in any order and partitioning of the input.

    Rows are hashed one by one and the hashes are hashed in order in 4096 buckets
    first, so no row set meets in one place.
    """
    line = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    each = rows.select(F.sha2(line, 256).alias("h"))
    part = each.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))


def reviewer_queue(cases: DataFrame, labels: DataFrame, annotator: str) -> DataFrame:
    """Each question's first case (smallest image) without a label of the annotator's own, the name's case ignored."""
    mine = labels.filter((F.lower("annotator") == annotator.lower()) & ~F.col("is_adjudication")).select("image_id", "question_id").distinct()
    left = cases.join(mine, ["image_id", "question_id"], "left_anti")
    return left.groupBy("question_id").agg(F.min("image_id").alias("next_image"), F.count("*").alias("remaining"))


def progress(runs: DataFrame, responses: DataFrame) -> DataFrame:
    """Verdicts stored for each run (errors are none) against its total."""
    done = responses.groupBy("run_id").agg(F.count_if(F.col("parser") != "error").alias("done"))
    return runs.join(done, runs["id"] == done["run_id"], "left").select("id", "total", F.coalesce("done", F.lit(0)).alias("done"))
