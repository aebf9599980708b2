"""The unit table: one row for each (run, question, image, variant), which most metrics start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import majority

DECIDABLE = ("yes", "no")


def eligible() -> Column:
    return F.coalesce(F.col("ground_truth").isin(*DECIDABLE), F.lit(False))


def parsed() -> Column:
    return eligible() & F.coalesce(F.col("answer").isin(*DECIDABLE), F.lit(False))


def correct() -> Column:
    return parsed() & (F.col("answer") == F.col("ground_truth"))


def scene() -> Column:
    """The scene of a row; an empty group makes each image its own. Groups are not trimmed."""
    return F.coalesce(F.nullif(F.col("source_group"), F.lit("")), F.concat(F.lit("image:"), F.col("image_id").cast("string")))


def unit_table(rows: DataFrame) -> DataFrame:
    """Votes and counts of each unit, from one pass and one shuffle over the responses."""
    return (
        rows.groupBy("run_id", "question_id", "image_id", "variant_id")
        .agg(
            F.count_if(F.col("answer") == "yes").alias("y"),
            F.count_if(F.col("answer") == "no").alias("n"),
            F.first("ground_truth", ignorenulls=True).alias("ground_truth"),
            F.first("canonical").alias("canonical"),
            F.first("mutation_type").alias("mutation_type"),
            F.first("source_group").alias("source_group"),
            F.bool_and(F.coalesce("format_valid", F.lit(False))).alias("all_valid"),
            F.count("*").alias("samples"),
            F.count_if(eligible()).alias("eligible"),
            F.count_if(parsed()).alias("parsed"),
            F.count_if(correct()).alias("correct"),
            F.count_if(eligible() & F.col("format_valid")).alias("valid"),
        )
        .withColumn("answer", majority("y", "n"))
    )
