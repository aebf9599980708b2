"""Whole results put together from the single metrics: run summary, arena, agreement intervals, audit warnings, label changes."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import interpret_agreement, share
from ..plans.units import correct, eligible, parsed
from . import agreement, arena, audit, metrics
from .quantiles import LATENCY, grouped_quantiles

VALUES = agreement.VALUES


def _inputs_and_strict(rows: DataFrame) -> DataFrame:
    """Images of a run, those sent in another form, and the parsed rows that were read as strict JSON; images first, so no distinct set is held."""
    other = ~F.coalesce(F.col("input_preprocess"), F.lit("")).isin("", "original", "failed")
    strict = F.col("parser") == "json"
    each = rows.groupBy("run_id", "image_id").agg(F.max(other).alias("changed"), F.count_if(parsed() & strict).alias("sp"), F.count_if(correct() & strict).alias("sc"), F.count_if(parsed()).alias("p"))
    out = each.groupBy("run_id").agg(F.count("*").alias("input_images"), F.count_if("changed").alias("normalised_inputs"), F.sum("sp").alias("strict_parsed"), F.sum("sc").alias("strict_correct"), F.sum("p").alias("p"))
    return out.select("run_id", "input_images", "normalised_inputs", "strict_parsed", share("strict_correct", "strict_parsed").alias("strict_accuracy"), share("strict_parsed", "p").alias("strict_share"))


def run_summary_full(rows: DataFrame) -> DataFrame:
    """Everything a report says of a run, in one row: rates, latency, inputs, baseline, provenance, strict reading, fragility, drift and the evidence grade."""
    base = metrics.majority_baseline(rows).select("run_id", F.col("truth").alias("majority_answer"), F.col("baseline").alias("majority_baseline"), F.col("cases").alias("ground_truth_cases"))
    seen = metrics.provenance(rows).select("run_id", F.col("cases").alias("annotated_cases"), F.col("verified").alias("verified_cases"), "verified_share", F.col("single").alias("single_annotator_cases"), F.col("adjudicated").alias("adjudicated_cases"), F.col("conflict").alias("conflict_cases"))
    out = metrics.run_summary(rows).join(_inputs_and_strict(rows), "run_id").join(metrics.mutation_ready(rows), "run_id")
    for other in (grouped_quantiles(rows, ["run_id"], "latency_ms", LATENCY), base, seen):
        out = out.join(other, "run_id", "left")
    counts = ["ground_truth_cases", "annotated_cases", "verified_cases", "single_annotator_cases", "adjudicated_cases", "conflict_cases"]
    out = out.fillna(0, counts).fillna(0.0, ["median_ms", "p95_ms", "majority_baseline", "verified_share"]).fillna({"majority_answer": ""})
    gate = {"cases": F.col("ground_truth_cases"), "groups": F.coalesce("independent_groups", F.lit(0)), "comparisons": F.col("comparable_pairs"), "baseline": F.col("majority_baseline")}
    keep = [*out.drop("mutation_ready").columns, "grade", "passed"]
    return metrics.graded(out.withColumns(gate)).select(*keep).fillna(0.0, ["scene_balanced_accuracy"])


def arena_models(rows: DataFrame, runs: DataFrame, n_runs: int) -> DataFrame:
    """The ranked runs with coverage (units with a verdict over all decidable ones), format and strict shares and p95 on the common units, elapsed time and throughput.

    ``runs``: id, completed, runtime_seconds.
    """
    shared = arena.flagged_units(rows, n_runs).filter("shared").select("run_id", "image_id", "variant_id")
    decidable = rows.filter(eligible()).groupBy("run_id", "image_id", "variant_id").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count("*").alias("decidable_units"))
    matched = rows.join(shared, ["run_id", "image_id", "variant_id"], "left_semi")
    strict = F.col("parser") == "json"
    kept = matched.groupBy("run_id").agg(F.count_if(eligible() & F.col("format_valid")).alias("valid"), F.count_if(eligible()).alias("e"), F.count_if(parsed() & strict).alias("s"), F.count_if(parsed()).alias("p"))
    kept = kept.select("run_id", share("valid", "e").alias("format_rate"), share("s", "p").alias("strict_share"))
    p95 = grouped_quantiles(matched, ["run_id"], "latency_ms", {"p95_ms": 0.95})
    took = runs.select(F.col("id").alias("run_id"), F.coalesce("runtime_seconds", F.lit(0.0)).cast("double").alias("elapsed_seconds"), "completed")
    out = arena.arena_rank(rows, n_runs).join(decidable, "run_id").join(kept, "run_id").join(p95, "run_id", "left").join(took, "run_id", "left").fillna(0.0, ["p95_ms"])
    return out.withColumns({"coverage": share("own_units", "decidable_units"), "responses_per_second": share("completed", "elapsed_seconds")}).drop("completed")


def arena_refusals(runs: DataFrame, chosen: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Why a choice of runs may not meet, one row a reason; none where it may.

    ``chosen`` (arena, run_id) names the runs of each meeting and ``runs`` has
    id, status, is_demo and arena.SIGNATURE.  With ``rows`` the units that all
    runs answered readably are counted too.
    """
    fields = F.to_json(F.struct(*arena.SIGNATURE), {"ignoreNullFields": "false"})
    r = runs.select(F.col("id").alias("run_id"), "status", "is_demo", fields.alias("protocol"))
    # least and greatest protocol differ where any two do, so no set of them is held
    each = chosen.distinct().join(r, "run_id", "left").groupBy("arena").agg(
        F.count("*").alias("n"), F.count_if(F.col("protocol").isNull()).alias("unknown"), (F.min("protocol") != F.max("protocol")).alias("mixed"),
        (F.min("is_demo") != F.max("is_demo")).alias("demo_and_real"), F.count_if(F.col("status") != "completed").alias("open"),
    )
    if rows is None:
        each = each.withColumn("common", F.lit(1))
    else:
        units = arena.arena_units(rows).select("run_id", "image_id", "variant_id")
        met = units.join(chosen.distinct(), "run_id").groupBy("arena", "image_id", "variant_id").agg(F.count("*").alias("have"))
        met = met.join(each.select("arena", "n"), "arena").filter("have = n").groupBy("arena").agg(F.count("*").alias("common"))
        each = each.join(met, "arena", "left")
    low, high = arena.MEETING
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("n").between(low, high), "not 2 to 12 runs"), F.when(F.col("unknown") > 0, "unknown run"), F.when(F.col("mixed"), "protocols differ"),
            F.when(F.col("demo_and_real"), "demo beside real models"), F.when(F.col("open") > 0, "a run is not completed"), F.when(F.coalesce("common", F.lit(0)) == 0, "no common units"),
        )
    )
    return each.select("arena", F.explode(reasons).alias("reason"))


#: Draws of the intervals by question and by pair, and the seed of all.
SECONDARY_DRAWS, SEED = 300, 20260825


def _interval(key: tuple, counts: np.ndarray, estimate: Callable[[np.ndarray], np.ndarray], draws: int, seed: int) -> tuple[float | None, float | None]:
    """Percentile interval of an estimate over resampled cases, from how many cases are of each kind.

    Cases of one kind are alike, so drawing all cases with replacement is a
    multinomial draw of the kinds' counts.  Null under four cases, where the
    estimate itself is undefined, or where fewer than half of the draws are.
    """
    total = int(counts.sum())
    if total < 4 or np.isnan(estimate(counts[None, :].astype(float))[0]):
        return None, None
    rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
    found = estimate(rng.multinomial(total, counts / total, size=draws).astype(float))
    found = found[~np.isnan(found)]
    return (None, None) if 2 * len(found) < draws else tuple(float(x) for x in np.percentile(found, [2.5, 97.5]))


def question_intervals(labels: DataFrame, draws: int = SECONDARY_DRAWS, seed: int = SEED) -> DataFrame:
    """Each question's alpha, its band and its interval over resampled cases.

    Cases are counted by their votes first; a question's rows in one task are
    the different votes that a panel can give, not its cases.
    """
    kinds = agreement.unit_values(labels, "question_id").groupBy("question_id", *VALUES).agg(F.count("*").alias("cases"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(VALUES))
        votes = rows[list(VALUES)].to_numpy(float)
        n = votes.sum(axis=1)
        unlike = (n * n - (votes * votes).sum(axis=1)) / (n - 1)

        def alpha(times: np.ndarray) -> np.ndarray:
            all_, sums = times @ n, times @ votes
            expected = (all_ * all_ - (sums * sums).sum(axis=1)) / (all_ - 1)
            return np.where(expected > 0, 1 - (times @ unlike) / np.where(expected > 0, expected, 1), np.nan)

        low, high = _interval(key, rows["cases"].to_numpy(), alpha, draws, seed)
        return pd.DataFrame({"question_id": [key[0]], "low": [low], "high": [high]})

    ends = kinds.groupBy("question_id").applyInPandas(run, "question_id long, low double, high double")
    return agreement.coefficients(labels, "question_id").select("question_id", "units", "alpha", "band").join(ends, "question_id", "left")


def pair_intervals(labels: DataFrame, draws: int = SECONDARY_DRAWS, seed: int = SEED) -> DataFrame:
    """Each pair of annotators with Cohen's kappa, its band and its interval over resampled shared cases.

    A pair's shared cases are counted by the two values, so a task gets 16 rows
    of a pair at most.
    """
    kinds = agreement._pairs_of(labels).groupBy("a", "b", "a_value", "b_value").agg(F.count("*").alias("cases"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a_value", "b_value"])
        left, right = (np.array([[x == v for v in VALUES] for x in rows[c]], float) for c in ("a_value", "b_value"))
        same = (rows["a_value"] == rows["b_value"]).to_numpy(float)

        def kappa(times: np.ndarray) -> np.ndarray:
            n = times.sum(axis=1)
            chance = ((times @ left) * (times @ right)).sum(axis=1) / (n * n)
            return np.where(chance < 1, ((times @ same) / n - chance) / np.where(chance < 1, 1 - chance, 1), np.nan)

        low, high = _interval(key, rows["cases"].to_numpy(), kappa, draws, seed)
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "low": [low], "high": [high]})

    ends = kinds.groupBy("a", "b").applyInPandas(run, "a string, b string, low double, high double")
    return agreement.cohen_kappa(labels).withColumn("band", interpret_agreement("kappa")).join(ends, ["a", "b"], "left")


def annotators_full(labels: DataFrame, top: int = 24) -> DataFrame:
    """The report on each annotator with an independent label: values, images, questions, yes share, rulings and the last label; the busiest ``top``."""
    rulings = labels.filter("is_adjudication").groupBy("annotator").agg(F.count("*").alias("adjudications"))
    last = labels.filter("not is_adjudication").groupBy("annotator").agg(F.max("updated_at").alias("last_seen"))
    out = agreement.annotator_report(labels).join(rulings, "annotator", "left").join(last, "annotator").fillna(0, ["adjudications"])
    return out.orderBy(F.desc("labels"), "annotator").limit(top)


#: What the audit says, by severity in the order of a report.
SEVERITY = ("high", "medium", "low")


def audit_report(images: DataFrame, annotations: DataFrame, pairs: DataFrame, hashed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """severity, area, warning and n of everything that is wrong with a set, the severest first.

    ``images`` id, source_group, width, height, split; ``annotations`` image_id,
    question_id, value; ``pairs`` and ``hashed`` (id) from the near-duplicate
    search; ``files`` (path, state) from ``audit.inspect_files``.  All pairs
    count, not a first part of them.
    """
    total = images.agg(F.count("*").alias("images"))
    g, r, b = audit.group_totals(images), audit.resolution(images), audit.balance(images, annotations)
    unhashed = images.join(hashed.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row each
    # one pass over the pairs: the rows below filter its one row, so they share its shuffle
    side = images.select("id", F.when(F.col("split").isin("train", "test"), F.col("split")).alias("split"))
    sided = pairs.join(side.toDF("a", "a_split"), "a", "left").join(side.toDF("b", "b_split"), "b", "left")
    dup = sided.agg(F.count("*").alias("pairs"), F.count_if(~F.col("same_group")).alias("cross"), F.count_if(F.col("a_split") != F.col("b_split")).alias("leaks"))

    def row(df: DataFrame, when: str, severity: str, area: Column | str, text: str, n: str) -> DataFrame:
        a = F.lit(area) if isinstance(area, str) else area
        return df.filter(when).select(F.lit(severity).alias("severity"), a.alias("area"), F.lit(text).alias("warning"), F.col(n).cast("long").alias("n"))

    question = F.concat(F.lit("question "), F.col("question_id").cast("string"))
    rows = [
        row(unhashed, "n > 0 and n >= images", "high", "hashes", "no image has a perceptual hash, so nothing was compared", "n"),
        row(unhashed, "n > 0 and n < images", "high", "hashes", "images without a perceptual hash are not compared", "n"),
        row(dup, "cross > 0", "high", "duplicates", "near pairs in different scenes count as independent", "cross"),
        row(dup, "cross = 0 and pairs > 0", "medium", "duplicates", "near pairs, all within their scene", "pairs"),
        row(dup, "leaks > 0", "high", "split", "near pairs across train and test", "leaks"),
        row(g.crossJoin(F.broadcast(total)), "largest > 0.5 * images", "medium", "scenes", "one scene has over half of the images", "largest"),
        row(g, "ungrouped > 1", "low", "scenes", "images without a scene count as one each", "ungrouped"),
        row(b, "decidable = 0", "medium", question, "no case says yes or no", "decidable"),
        row(b, "skewed", "medium", question, "one answer has over 80 %", "decidable"),
        row(b, "thin", "medium", question, "fewer than 10 cases of an answer", "decidable"),
        row(b, "unannotated > 0", "medium", question, "images without a value", "unannotated"),
        row(r, "downscaled > 0", "low", "resolution", "images are scaled down before the model sees them", "downscaled"),
    ]
    if files is not None:
        states = files.agg(F.count_if(F.col("state").isin("missing", "unreadable")).alias("lost"), F.count_if(F.col("state") == "changed").alias("changed"))
        rows.append(row(states, "lost > 0", "high", "files", "images cannot be read any more", "lost"))
        rows.append(row(states, "changed > 0", "high", "files", "images changed since they were imported", "changed"))
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return out.orderBy(order, "area", "warning")


def admit_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (the columns of labels, and ``withdraw``) with ``refused``, null for those to apply.

    Refused are unknown values, rulings on a case that nobody disputes, and the
    withdrawal of a label that is not there.  Judged against the labels as they
    are, not against other changes of the batch.
    """
    case = ["image_id", "question_id"]
    disputed = agreement.resolve_labels(labels).filter(F.col("agreement").isin("conflict", "majority", "adjudicated")).select(*case, F.lit(True).alias("disputed"))
    have = labels.select(*case, "annotator", "is_adjudication").distinct().withColumn("have", F.lit(True))
    out = changes.join(disputed, case, "left").join(have, [*case, "annotator", "is_adjudication"], "left")
    gone, known = F.coalesce("withdraw", F.lit(False)), F.coalesce(F.col("value").isin(*VALUES), F.lit(False))
    why = F.when(gone & F.col("have").isNull(), "nothing to withdraw").when(~gone & ~known, "unknown value").when(~gone & F.col("is_adjudication") & F.col("disputed").isNull(), "nobody disputes the case")
    return out.withColumn("refused", why).select(*changes.columns, "refused")


def apply_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """The labels after the admitted changes: the last one of each (case, annotator, ruling or not) holds, a withdrawal removes.

    A case whose last label goes has no consensus any more, since
    ``agreement.resolve_labels`` starts from what is left.
    """
    key = ["image_id", "question_id", "annotator", "is_adjudication"]
    rest = [c for c in labels.columns if c not in key]
    fresh = admit_labels(labels, changes).filter("refused is null")
    both = labels.withColumns({"withdraw": F.lit(False), "fresh": F.lit(0)}).unionByName(fresh.drop("refused").withColumn("fresh", F.lit(1)))
    last = both.groupBy(*key).agg(F.max_by(F.struct("withdraw", *rest), F.struct("fresh", "updated_at")).alias("r"))
    return last.filter(~F.coalesce("r.withdraw", F.lit(False))).select(*[c if c in key else F.col(f"r.{c}").alias(c) for c in labels.columns])


def arena_overview(models: DataFrame, overlap: DataFrame) -> DataFrame:
    """One row on a meeting: common and all units, their rate, the runs that alone lead in accuracy, speed and robustness, and the weakest coverage."""
    lead = {
        "accuracy": F.struct(F.col("accuracy"), F.col("scene_balanced")),
        "robustness": F.struct((-F.col("pfs")).alias("x"), (-F.col("drift")).alias("y")),
        "speed": F.struct((-F.when(F.col("median_ms") > 0, F.col("median_ms")).otherwise(float("inf"))).alias("x")),
    }
    # two to twelve rows
    top = models.select("run_id", "coverage", "rank", *[(F.rank().over(W.orderBy(v.desc())) == 1).alias(f"is_{k}") for k, v in lead.items()])
    sole = [F.when(F.count_if(f"is_{k}") == 1, F.min(F.when(F.col(f"is_{k}"), F.col("run_id")))).alias(f"{k}_leader") for k in lead]
    one = top.agg(*sole, F.min_by("run_id", F.struct("coverage", "rank")).alias("weakest_run"), F.min("coverage").alias("weakest_coverage"))
    return overlap.crossJoin(F.broadcast(one))  # one row each
