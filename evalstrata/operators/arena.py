"""Several runs on the same units: ranking, paired differences, leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import exact_mcnemar_p, paired_difference_interval, pairs, share, wilson
from ..plans.units import eligible, scene, unit_table
from .quantiles import grouped_quantiles


def arena_units(rows: DataFrame) -> DataFrame:
    """(run, image, variant) with a majority on a decidable truth, and whether it is right; ties drop out."""
    ready = unit_table(rows).filter(eligible() & F.col("answer").isNotNull())
    return ready.select("run_id", "question_id", "image_id", "variant_id", scene().alias("scene"), (F.col("answer") == F.col("ground_truth")).alias("right"))


def common_keys(units: DataFrame, n_runs: int) -> DataFrame:
    """Keys (image, variant) that every run has: one count, whatever the number of runs."""
    return units.groupBy("image_id", "variant_id").agg(F.count("run_id").alias("runs")).filter(F.col("runs") == n_runs).drop("runs")


def overlap(units: DataFrame, n_runs: int) -> DataFrame:
    """Common and all keys, and their rate."""
    each = units.groupBy("image_id", "variant_id").agg(F.count("run_id").alias("runs"))
    out = each.agg(F.count_if(F.col("runs") == n_runs).alias("common_units"), F.count("*").alias("union_units"))
    return out.withColumn("overlap_rate", share("common_units", "union_units"))


def flagged_units(rows: DataFrame, n_runs: int) -> DataFrame:
    """The unit table with ``ready`` (a majority on a decidable truth), ``shared`` (ready in all ``n_runs`` runs) and ``right``.

    The window's groups are one unit of each run.
    """
    ready = eligible() & F.col("answer").isNotNull()
    have = F.sum(F.col("ready").cast("int")).over(W.partitionBy("image_id", "variant_id"))
    out = unit_table(rows).withColumn("ready", ready).withColumn("shared", F.col("ready") & (have == n_runs))
    return out.withColumn("right", F.col("ready") & (F.col("answer") == F.col("ground_truth")))


def arena_rank(rows: DataFrame, n_runs: int) -> DataFrame:
    """Runs ranked on their common units: accuracy, scene balance, fragility, drift, latency, id.

    One unit table and one chain of aggregations (cases, scenes, runs); latencies
    alone go back to the rows.
    """
    units = flagged_units(rows, n_runs)
    votes, both = F.col("y") + F.col("n"), F.col("shared")
    cases = units.groupBy("run_id", "question_id", "image_id").agg(
        F.first("source_group").alias("source_group"), F.count_if("ready").alias("own_units"), F.count_if("right").alias("own_correct"), F.count_if(both).alias("units"),
        F.count_if(both & F.col("right")).alias("correct"), F.count_if(both & (F.col("answer") == "yes")).alias("vy"), F.count_if(both & (F.col("answer") == "no")).alias("vn"),
        F.sum(F.when(both, pairs(votes)).otherwise(0)).alias("again"), F.sum(F.when(both, F.col("y") * F.col("n")).otherwise(0)).alias("differ"),
    )
    moved = ("own_units", "own_correct", "units", "correct", "again", "differ")
    scenes = cases.groupBy("run_id", scene().alias("scene")).agg(F.sum(pairs(F.col("vy") + F.col("vn"))).alias("prompts"), F.sum(F.col("vy") * F.col("vn")).alias("split"), *[F.sum(c).alias(c) for c in moved])
    balanced = F.avg(F.when(F.col("units") > 0, F.col("correct") / F.col("units"))).alias("scene_balanced")
    out = scenes.groupBy("run_id").agg(balanced, *[F.sum(c).alias(c) for c in ("prompts", "split", *moved)]).filter("units > 0")
    matched = rows.join(units.filter("shared").select("run_id", "image_id", "variant_id"), ["run_id", "image_id", "variant_id"], "left_semi")
    speed = grouped_quantiles(matched, ["run_id"], "latency_ms", {"median_ms": 0.5})
    out = out.join(speed, "run_id", "left").fillna(0.0, ["median_ms"])
    low, high = wilson("correct", "units")
    out = out.withColumns({"pfs": 100 * share("split", "prompts"), "drift": 100 * share("differ", "again"), "accuracy": share("correct", "units"), "wilson_low": low, "wilson_high": high, "own_accuracy": share("own_correct", "own_units")})
    out = out.drop("prompts", "split", "again", "differ")
    order = W.orderBy(F.desc("accuracy"), F.desc("scene_balanced"), "pfs", "drift", "median_ms", "run_id")  # one row a run
    return out.withColumn("rank", F.row_number().over(order))


def arena_pairwise(rows: DataFrame) -> DataFrame:
    """Each pair of runs on the units that both have: who alone is right, the difference, its interval and p."""
    u = arena_units(rows).select("run_id", "image_id", "variant_id", "right")
    a, b = u.toDF("run_a", "image_id", "variant_id", "a_right"), u.toDF("run_b", "image_id", "variant_id", "b_right")
    out = a.join(b, ["image_id", "variant_id"]).filter("run_a < run_b").groupBy("run_a", "run_b").agg(
        F.count("*").alias("paired"), F.count_if(F.expr("a_right and not b_right")).alias("a_only"), F.count_if(F.expr("b_right and not a_right")).alias("b_only"),
        F.count_if(F.expr("a_right and b_right")).alias("both_right"), F.count_if(F.expr("not a_right and not b_right")).alias("both_wrong"),
    )
    low, high = paired_difference_interval("a_only", "b_only", "paired")
    delta = F.coalesce(F.try_divide((F.col("a_only") - F.col("b_only")).cast("double"), F.col("paired").cast("double")), F.lit(0.0))
    return out.withColumns({"delta": delta, "ci_low": low, "ci_high": high, "p_value": exact_mcnemar_p("a_only", "b_only")})


def sole_leaders(ranked: DataFrame) -> DataFrame:
    """For each measure the run that alone has the best value; null where two share it. No latency counts as the slowest."""
    slow = F.when(F.col("median_ms") > 0, F.col("median_ms")).otherwise(F.lit(float("inf")))
    value = {"accuracy": F.col("accuracy"), "scene_balanced": F.col("scene_balanced"), "fragility": -F.col("pfs"), "drift": -F.col("drift"), "speed": -slow}
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("v")) for m, v in value.items()])
    long = ranked.select("run_id", F.explode(measures).alias("m")).select("run_id", "m.*")
    best = long.withColumn("top", F.max("v").over(W.partitionBy("measure"))).filter("v = top")
    return best.groupBy("measure").agg(F.when(F.count("*") == 1, F.min("run_id")).alias("leader"))


#: What runs must share to meet in an arena, and how many may.
SIGNATURE = ("project_id", "questions", "variants", "repetitions", "temperature_percent", "seed", "max_tokens", "split_no")
MEETING = (2, 12)


def signature_groups(runs: DataFrame) -> DataFrame:
    """Completed runs that may meet in an arena: 2 to 12 of one protocol, in all of SIGNATURE."""
    out = runs.filter("status = 'completed'").groupBy(*SIGNATURE).agg(F.count("*").alias("runs"), F.min("id").alias("first_run"))
    return out.filter(F.col("runs").between(*MEETING))
