"""Where a model fails: tags of units, risk patterns and failure clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import share, wilson
from ..plans.units import eligible, unit_table


def visual_tags() -> Column:
    """Tags of an image's features, in a fixed order; what is unknown gives none."""
    w, h = F.col("width"), F.col("height")
    sized = (w > 0) & (h > 0)
    rules = [
        ("dark", F.col("brightness") < 0.30), ("bright", F.col("brightness") > 0.76), ("low_contrast", F.col("contrast") < 0.13), ("fine_detail", F.col("edge_density") > 0.12),
        ("small_image", sized & (F.least(w, h) < 512)), ("portrait", sized & (h > 1.2 * w)), ("landscape", sized & (w > 1.2 * h)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in rules]))


def diagnostic_units(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Units with a decided truth and majority: error, format failure and tags (mutation, visual, source)."""
    units = unit_table(rows).filter(eligible() & F.col("answer").isNotNull())
    tagged = units.join(features.select("image_id", visual_tags().alias("visual")), "image_id", "left")
    visual = F.coalesce("visual", F.array().cast("array<string>"))
    source = F.when(F.col("source_group") != "", F.array(F.concat(F.lit("source:"), F.col("source_group")))).otherwise(F.array().cast("array<string>"))
    return tagged.select("run_id", "question_id", "image_id", "variant_id", "mutation_type", visual.alias("visual"), (F.col("answer") != F.col("ground_truth")).alias("error"), (~F.col("all_valid")).alias("format_failure"), F.concat(F.array("mutation_type"), visual, source).alias("tags"))


def risk_patterns(units: DataFrame, least: int = 2) -> DataFrame:
    """Each tag's failure rate against that outside it (total less inside; the whole where nothing is outside), by run."""
    inside = units.select("run_id", "image_id", "error", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("run_id", "tag").agg(
        F.count("*").alias("units"), F.count_if("error").alias("failures")
    )
    # Six examples a tag: Spark keeps only six rows a group before it sends them anywhere.
    failing = units.filter("error").select("run_id", "image_id", F.explode(F.array_distinct("tags")).alias("tag")).distinct()
    nth = F.row_number().over(W.partitionBy("run_id", "tag").orderBy("image_id"))
    few = failing.withColumn("nth", nth).filter("nth <= 6").groupBy("run_id", "tag").agg(F.array_sort(F.collect_list("image_id")).alias("examples"))
    inside = inside.join(few, ["run_id", "tag"], "left").withColumn("examples", F.coalesce("examples", F.array()))
    all_ = units.groupBy("run_id").agg(F.count("*").alias("all_units"), F.count_if("error").alias("all_failures"))
    out = inside.filter(F.col("units") >= least).join(F.broadcast(all_), "run_id")  # one row a run
    outside = F.when(F.col("all_units") > F.col("units"), share(F.col("all_failures") - F.col("failures"), F.col("all_units") - F.col("units"))).otherwise(share("all_failures", "all_units"))
    low, high = wilson("failures", "units")
    out = out.withColumns({"failure_rate": share("failures", "units"), "outside_rate": outside, "wilson_low": low, "wilson_high": high})
    out = out.withColumn("delta", F.col("failure_rate") - F.col("outside_rate"))
    rank = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("delta"), F.desc("failures"), F.desc("units"), "tag"))
    return out.withColumn("rank", rank).filter("rank <= 30").withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


def failure_clusters(units: DataFrame, top: int = 12) -> DataFrame:
    """Errors by mutation and first visual tag, the largest clusters of each run."""
    tag = F.coalesce(F.get("visual", F.lit(0)), F.lit("other_visual"))
    out = units.filter("error").groupBy("run_id", "mutation_type", tag.alias("tag")).agg(F.count("*").alias("failures"), F.count_if("format_failure").alias("format_failures"))
    rank = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("failures"), "mutation_type", "tag"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top)
