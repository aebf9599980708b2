"""Accuracy, prompt fragility, repeat drift and the evidence gate over evaluation rows.

Pair counts use a closed form: y yes and n no votes make C(y+n, 2) comparable
pairs of which y*n disagree, so no pair is ever enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import exact_mcnemar_p, pairs, share, wilson
from ..plans.units import correct, eligible, parsed, scene, unit_table
from .quantiles import LATENCY, grouped_quantiles


def _rates() -> list[Column]:
    return [
        F.count("*").alias("samples"),
        F.count_if(eligible()).alias("eligible"),
        F.count_if(parsed()).alias("parsed"),
        F.count_if(correct()).alias("correct"),
        F.count_if(eligible() & F.col("format_valid")).alias("valid"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    low, high = wilson("correct", "parsed")
    return df.withColumns({"accuracy": share("correct", "parsed"), "wilson_low": low, "wilson_high": high, "coverage": share("parsed", "eligible"), "format_rate": share("valid", "eligible")})


def variant_summary(rows: DataFrame) -> DataFrame:
    """Each variant's counts, accuracy with interval, balanced accuracy (null unless both classes are there) and latency (all rows)."""
    hit = [F.count_if(parsed() & (F.col("ground_truth") == c)).alias(f"of_{c}") for c in ("yes", "no")]
    hit += [F.count_if(correct() & (F.col("ground_truth") == c)).alias(f"hit_{c}") for c in ("yes", "no")]
    out = _with_rates(rows.groupBy("run_id", "question_id", "variant_id", "canonical", "mutation_type").agg(*_rates(), *hit))
    key = ["run_id", "question_id", "variant_id"]
    out = out.join(grouped_quantiles(rows, key, "latency_ms", LATENCY), key, "left").fillna(0.0, list(LATENCY))
    balanced = F.when((F.col("of_yes") > 0) & (F.col("of_no") > 0), (share("hit_yes", "of_yes") + share("hit_no", "of_no")) / 2)
    return out.withColumn("balanced_accuracy", balanced).drop("of_yes", "of_no", "hit_yes", "hit_no")


def case_table(units: DataFrame) -> DataFrame:
    """Each case (run, question, image): how many variants vote yes and no."""
    cases = units.groupBy("run_id", "question_id", "image_id").agg(F.count_if(F.col("answer") == "yes").alias("vy"), F.count_if(F.col("answer") == "no").alias("vn"))
    return cases.withColumns({"comparable": pairs(F.col("vy") + F.col("vn")), "disagree": F.col("vy") * F.col("vn")})


def prompt_fragility(units: DataFrame, *keys: str) -> DataFrame:
    """100 * disagreeing / comparable variant pairs, over all cases, labelled or not."""
    out = case_table(units).groupBy(*keys).agg(F.sum("comparable").alias("comparable_pairs"), F.sum("disagree").alias("disagreeing_pairs"))
    return out.withColumn("pfs", 100 * share("disagreeing_pairs", "comparable_pairs"))


def repeat_drift(units: DataFrame, *keys: str) -> DataFrame:
    """100 * disagreeing / comparable pairs of readable repetitions, and units whose votes tie."""
    out = units.groupBy(*keys).agg(
        F.sum(pairs(F.col("y") + F.col("n"))).alias("comparable_repeats"),
        F.sum(F.col("y") * F.col("n")).alias("disagreeing_repeats"),
        F.count_if((F.col("y") == F.col("n")) & (F.col("y") > 0)).alias("tie_units"),
    )
    return out.withColumn("drift", 100 * share("disagreeing_repeats", "comparable_repeats"))


def scene_balanced(rows: DataFrame, *keys: str) -> DataFrame:
    """The mean over scenes of the accuracy on their parsed rows, each scene counting once."""
    each = rows.filter(parsed()).groupBy(*keys, scene().alias("scene")).agg(F.avg(correct().cast("double")).alias("a"))
    return each.groupBy(*keys).agg(F.avg("a").alias("scene_balanced_accuracy"), F.count("*").alias("independent_groups"))


SUMS = ("samples", "eligible", "parsed", "correct", "valid")


def run_summary(rows: DataFrame) -> DataFrame:
    """One row a run: accuracy with interval, coverage, format, fragility, drift, scene balance.

    One scan and one chain of aggregations, each over the rows of the one before:
    units, cases, scenes, runs.
    """
    votes = F.col("y") + F.col("n")
    cases = unit_table(rows).groupBy("run_id", "question_id", "image_id").agg(
        F.first("source_group").alias("source_group"), F.count_if(F.col("answer") == "yes").alias("vy"), F.count_if(F.col("answer") == "no").alias("vn"),
        F.sum(pairs(votes)).alias("comparable_repeats"), F.sum(F.col("y") * F.col("n")).alias("disagreeing_repeats"),
        F.count_if((F.col("y") == F.col("n")) & (F.col("y") > 0)).alias("tie_units"), *[F.sum(c).alias(c) for c in SUMS],
    )
    moved = ("comparable_repeats", "disagreeing_repeats", "tie_units", *SUMS)
    scenes = cases.groupBy("run_id", scene().alias("scene")).agg(
        F.sum(pairs(F.col("vy") + F.col("vn"))).alias("comparable_pairs"), F.sum(F.col("vy") * F.col("vn")).alias("disagreeing_pairs"), *[F.sum(c).alias(c) for c in moved]
    )
    balanced = F.avg(F.when(F.col("parsed") > 0, F.col("correct") / F.col("parsed"))).alias("scene_balanced_accuracy")
    out = scenes.groupBy("run_id").agg(balanced, F.count_if(F.col("parsed") > 0).alias("independent_groups"), *[F.sum(c).alias(c) for c in ("comparable_pairs", "disagreeing_pairs", *moved)])
    return _with_rates(out).withColumns({"pfs": 100 * share("disagreeing_pairs", "comparable_pairs"), "drift": 100 * share("disagreeing_repeats", "comparable_repeats")})


def fragile_cases(units: DataFrame, limit: int = 100) -> DataFrame:
    """Cases with disagreement and their answers by variant, the most disagreeing first."""
    cases = case_table(units).filter("disagree > 0").orderBy(F.desc("disagree"), "run_id", "image_id", "question_id").limit(limit)
    votes = units.select("run_id", "question_id", "image_id", F.concat_ws(":", F.col("variant_id").cast("string"), "answer").alias("vote"), "answer").filter("answer is not null")
    answers = votes.join(cases, ["run_id", "question_id", "image_id"], "left_semi").groupBy("run_id", "question_id", "image_id").agg(F.array_join(F.sort_array(F.collect_list("vote")), ",").alias("answers"))
    return cases.join(answers, ["run_id", "question_id", "image_id"])


def question_summary(rows: DataFrame) -> DataFrame:
    """Each question's variants, and the least and greatest accuracy of those with parsed rows."""
    v = rows.groupBy("run_id", "question_id", "variant_id").agg(F.count_if(parsed()).alias("parsed"), F.count_if(correct()).alias("correct"))
    some = F.when(F.col("parsed") > 0, share("correct", "parsed"))
    out = v.groupBy("run_id", "question_id").agg(F.count("*").alias("variant_count"), F.coalesce(F.min(some), F.lit(0.0)).alias("min_accuracy"), F.coalesce(F.max(some), F.lit(0.0)).alias("max_accuracy"))
    return out.withColumn("spread", F.col("max_accuracy") - F.col("min_accuracy"))


def parser_breakdown(rows: DataFrame) -> DataFrame:
    """Accuracy and share of the parsed rows by how they were read; a missing parser is ``none``."""
    kind = F.coalesce(F.nullif(F.col("parser"), F.lit("")), F.lit("none"))
    out = rows.filter(parsed()).groupBy("run_id", kind.alias("parser")).agg(F.count("*").alias("parsed"), F.count_if(correct()).alias("correct"))
    low, high = wilson("correct", "parsed")
    return out.withColumns({"accuracy": share("correct", "parsed"), "wilson_low": low, "wilson_high": high, "share": share("parsed", F.sum("parsed").over(W.partitionBy("run_id")))})


def majority_baseline(rows: DataFrame) -> DataFrame:
    """The commoner truth of a run's cases and its share; on a tie the one that comes first by question, variant, image, repetition."""
    first = F.min(F.struct("question_id", "variant_id", "image_id", "repetition"))
    cases = rows.filter(eligible()).groupBy("run_id", "question_id", "image_id").agg(F.first("ground_truth").alias("truth"), first.alias("at"))
    sides = cases.groupBy("run_id", "truth").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = W.partitionBy("run_id")
    best = sides.withColumns({"cases": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "at"))}).filter("rank = 1")
    return best.select("run_id", "truth", "n", "cases", share("n", "cases").alias("baseline"))


def provenance(rows: DataFrame) -> DataFrame:
    """How the truth of each run's annotated cases was reached; verified means two labels or more."""
    last = F.max_by(F.struct("gt_agreement", "gt_labels"), F.struct("question_id", "variant_id", "image_id", "repetition"))
    cases = rows.filter("ground_truth is not null").groupBy("run_id", "question_id", "image_id").agg(last.alias("p"))
    kind, labels = F.coalesce("p.gt_agreement", F.lit("single")), F.coalesce("p.gt_labels", F.lit(1))
    out = cases.groupBy("run_id").agg(F.count("*").alias("cases"), F.count_if(labels >= 2).alias("verified"), *[F.count_if(kind == k).alias(k) for k in ("single", "adjudicated", "conflict")])
    return out.withColumn("verified_share", share("verified", "cases"))


def paired_comparisons(units: DataFrame) -> DataFrame:
    """Each other variant against its question's canonical one, on images where both have a majority and the truth is decidable."""
    ready = units.filter(eligible() & F.col("answer").isNotNull()).withColumn("right", F.col("answer") == F.col("ground_truth"))
    base = ready.filter("canonical").select("run_id", "question_id", "image_id", F.col("variant_id").alias("canonical_id"), F.col("right").alias("base_right"))
    both = ready.filter("not canonical").join(base, ["run_id", "question_id", "image_id"])
    out = both.groupBy("run_id", "question_id", "canonical_id", "variant_id").agg(
        F.count("*").alias("paired"), F.count_if(F.expr("base_right and not right")).alias("canonical_only"), F.count_if(F.expr("right and not base_right")).alias("alternative_only")
    )
    return out.withColumn("p_value", exact_mcnemar_p("canonical_only", "alternative_only"))


#: Thresholds of the evidence gate.
GATE = {"cases": 30, "groups": 5, "coverage": 0.95, "format": 0.90, "comparisons": 20, "baseline": 0.80, "verified": 0.20}


def gate_inputs(rows: DataFrame) -> DataFrame:
    """One row a run with all that the gate looks at."""
    s = run_summary(rows).select("run_id", "coverage", "format_rate", F.coalesce("independent_groups", F.lit(0)).alias("groups"), F.col("comparable_pairs").alias("comparisons"))
    cases = majority_baseline(rows).select("run_id", "cases", "baseline")
    seen = provenance(rows).select("run_id", "verified_share")
    return s.join(cases, "run_id", "left").join(mutation_ready(rows), "run_id").join(seen, "run_id", "left").na.fill({"cases": 0, "baseline": 0.0, "verified_share": 0.0})


def mutation_ready(rows: DataFrame) -> DataFrame:
    """Whether each question of a run has two variants or more."""
    return question_summary(rows).groupBy("run_id").agg((F.min("variant_count") >= 2).alias("mutation_ready"))


def evidence_gate(rows: DataFrame) -> DataFrame:
    """The grade of a run's evidence (A, B, C or E) and how many of the eight checks pass."""
    return graded(gate_inputs(rows))


def graded(inputs: DataFrame) -> DataFrame:
    """``inputs`` (the columns of ``gate_inputs``, and any others) with the grade, the number of checks that pass, and each check."""
    checks = {
        "cases": F.col("cases") >= GATE["cases"], "groups": F.col("groups") >= GATE["groups"], "mutations": F.col("mutation_ready"),
        "coverage": F.col("coverage") >= GATE["coverage"], "format": F.col("format_rate") >= GATE["format"],
        "comparisons": F.col("comparisons") >= GATE["comparisons"], "baseline": F.col("baseline") <= GATE["baseline"], "verified": F.col("verified_share") >= GATE["verified"],
    }
    basic = checks["mutations"] & checks["coverage"] & checks["format"] & checks["comparisons"]
    strong = basic & (F.col("cases") >= 100) & (F.col("groups") >= 15) & (F.col("comparisons") >= 100) & checks["baseline"] & checks["verified"]
    reviewable = basic & checks["cases"] & checks["groups"] & (F.col("baseline") <= 0.85)
    grade = F.when(strong, "A").when(reviewable, "B").when((F.col("cases") > 0) & (F.col("comparisons") > 0), "C").otherwise("E")
    passed = sum((c.cast("long") for c in checks.values()), F.lit(0).cast("long"))
    return inputs.withColumns({"grade": grade, "passed": passed, **{f"check_{k}": c for k, c in checks.items()}})


def normalised_inputs(rows: DataFrame) -> DataFrame:
    """Images of each run that were sent in another form than the original."""
    other = ~F.coalesce(F.col("input_preprocess"), F.lit("")).isin("", "original", "failed")
    return rows.groupBy("run_id").agg(F.count_distinct(F.when(other, F.col("image_id"))).alias("normalised_images"))
