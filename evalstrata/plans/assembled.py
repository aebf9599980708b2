"""Queries over whole results and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arena, assembled, audit
from ..sources.adapters import view, with_views
from .queries import (
    CORRECT, ELIGIBLE, N_RUNS, ORACLES, PARSED, RANK, RESOLVED, coef, hashed, images, labels, near, register, responses, rounded, sh,
)


@register(
    "run_summary_full",
    f"""WITH i AS (SELECT run_id, count(DISTINCT image_id) AS input_images, count(DISTINCT image_id) FILTER (input_preprocess NOT IN ('', 'original', 'failed')) AS normalised_inputs, count(*) FILTER ({PARSED} AND parser = 'json') AS strict_parsed,
  count(*) FILTER ({CORRECT} AND parser = 'json') AS sc, count(*) FILTER ({PARSED}) AS p, median(latency_ms) AS med, quantile_cont(latency_ms, 0.95) AS p95 FROM v_responses GROUP BY 1)
SELECT f.*, input_images, normalised_inputs, strict_parsed, round({sh('sc', 'strict_parsed')}, 6) AS strict_accuracy, round({sh('strict_parsed', 'p')}, 6) AS strict_share, g.grade, g.passed, round(med, 6) AS median_ms, round(p95, 6) AS p95_ms,
  b.truth AS majority_answer, b.baseline AS majority_baseline, b.cases AS ground_truth_cases, v.cases AS annotated_cases, v.verified AS verified_cases, v.verified_share, v.single AS single_annotator_cases, v.adjudicated AS adjudicated_cases, v.conflict AS conflict_cases
FROM ({ORACLES['flagship_run_summary']}) f JOIN i USING (run_id) JOIN ({ORACLES['evidence_gate']}) g USING (run_id) JOIN ({ORACLES['majority_baseline']}) b USING (run_id) JOIN ({ORACLES['provenance']}) v USING (run_id)""",
    "v_responses",
)
def run_summary_full(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assembled.run_summary_full(responses(spark, d)))


MODELS = f"""{RANK}, de AS (SELECT run_id, count(DISTINCT (image_id, variant_id)) AS decidable_units FROM v_responses WHERE {ELIGIBLE} GROUP BY 1),
kept AS (SELECT run_id, {sh(f'count(*) FILTER ({ELIGIBLE} AND format_valid)', f'count(*) FILTER ({ELIGIBLE})')} AS format_rate, {sh(f"count(*) FILTER ({PARSED} AND parser = 'json')", f'count(*) FILTER ({PARSED})')} AS strict_share,
  quantile_cont(latency_ms, 0.95) AS p95_ms FROM v_responses SEMI JOIN sh USING (run_id, image_id, variant_id) GROUP BY 1),
models AS (SELECT ranked.*, decidable_units, format_rate, strict_share, p95_ms, CAST(own_units AS DOUBLE) / decidable_units AS coverage, CAST(r.runtime_seconds AS DOUBLE) AS elapsed_seconds, {sh('r.completed', 'r.runtime_seconds')} AS responses_per_second
  FROM ranked JOIN de USING (run_id) JOIN kept USING (run_id) LEFT JOIN v_runs r ON r.id = run_id)"""


def _models(spark: SparkSession, d: str) -> DataFrame:
    return assembled.arena_models(responses(spark, d), view(spark, d, "v_runs"), N_RUNS)


@register(
    "arena_models",
    f"WITH {MODELS} SELECT run_id, CAST(rank AS INT) AS rank, units, correct, round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage, decidable_units, round(format_rate, 6) AS format_rate, round(strict_share, 6) AS strict_share, round(p95_ms, 6) AS p95_ms, round(elapsed_seconds, 6) AS elapsed_seconds, round(responses_per_second, 6) AS responses_per_second FROM models",
    "v_responses", "v_runs",
)
def arena_models(spark: SparkSession, d: str) -> DataFrame:
    keep = ["run_id", "rank", "units", "correct", "accuracy", "coverage", "decidable_units", "format_rate", "strict_share", "p95_ms", "elapsed_seconds", "responses_per_second"]
    return rounded(_models(spark, d).select(*keep))


@register(
    "arena_overview",
    f"""WITH {MODELS}, lead AS (SELECT *, rank() OVER (ORDER BY accuracy DESC, scene_balanced DESC) AS ra, rank() OVER (ORDER BY pfs, drift) AS rr, rank() OVER (ORDER BY CASE WHEN median_ms > 0 THEN median_ms ELSE CAST('inf' AS DOUBLE) END) AS rs FROM models)
SELECT o.*, CASE WHEN count(*) FILTER (ra = 1) = 1 THEN min(run_id) FILTER (ra = 1) END AS accuracy_leader, CASE WHEN count(*) FILTER (rr = 1) = 1 THEN min(run_id) FILTER (rr = 1) END AS robustness_leader,
  CASE WHEN count(*) FILTER (rs = 1) = 1 THEN min(run_id) FILTER (rs = 1) END AS speed_leader, arg_min(run_id, {{'c': coverage, 'r': rank}}) AS weakest_run, round(min(coverage), 6) AS weakest_coverage
FROM lead, ({ORACLES['arena_overlap']}) o GROUP BY ALL""",
    "v_responses", "v_runs",
)
def arena_overview(spark: SparkSession, d: str) -> DataFrame:
    meeting = arena.overlap(arena.arena_units(responses(spark, d)), N_RUNS)
    return rounded(assembled.arena_overview(_models(spark, d), meeting))


_CHOSEN = "SELECT concat('a', id % 700) AS arena, id AS run_id FROM v_runs WHERE id % 5 < 2 UNION ALL SELECT concat('p', project_id, questions, variants, repetitions, temperature_percent, seed, max_tokens, split_no, status, id % 40), id FROM v_runs"


@register(
    "arena_refusals",
    f"""WITH c AS ({_CHOSEN}), r AS (SELECT v_runs.id, status, is_demo, [project_id::VARCHAR, questions, variants, repetitions::VARCHAR, temperature_percent::VARCHAR, seed::VARCHAR, max_tokens::VARCHAR, split_no::VARCHAR] AS protocol FROM v_runs JOIN v_providers p ON p.id = provider_id),
g AS (SELECT arena, count(*) AS n, count(*) FILTER (protocol IS NULL) AS unknown, count(DISTINCT protocol) AS kinds, count(DISTINCT is_demo) AS demos, count(*) FILTER (status <> 'completed') AS open FROM c LEFT JOIN r ON r.id = run_id GROUP BY 1)
SELECT arena, 'not 2 to 12 runs' AS reason FROM g WHERE n NOT BETWEEN 2 AND 12 UNION ALL SELECT arena, 'unknown run' FROM g WHERE unknown > 0 UNION ALL SELECT arena, 'protocols differ' FROM g WHERE kinds > 1
UNION ALL SELECT arena, 'demo beside real models' FROM g WHERE demos > 1 UNION ALL SELECT arena, 'a run is not completed' FROM g WHERE open > 0""",
    "v_runs", "v_providers",
)
def arena_refusals(spark: SparkSession, d: str) -> DataFrame:
    runs = view(spark, d, "v_runs")
    chosen = spark.sql(_CHOSEN.replace("v_runs", "{v_runs}"), v_runs=runs)
    kinds = view(spark, d, "v_providers").select(F.col("id").alias("provider_id"), "is_demo")
    return assembled.arena_refusals(runs.join(kinds, "provider_id"), chosen)


@register("question_intervals")
def question_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assembled.question_intervals(labels(spark, d)))


@register("pair_intervals")
def pair_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assembled.pair_intervals(labels(spark, d)))


@register(
    "annotators_full",
    f"""SELECT r.*, coalesce(adjudications, 0) AS adjudications, CAST(last_seen AS BIGINT) AS last_seen FROM ({ORACLES['annotator_report']}) r LEFT JOIN (SELECT annotator, count(*) AS adjudications FROM v_labels WHERE is_adjudication GROUP BY 1) a USING (annotator)
JOIN (SELECT annotator, max(updated_at) AS last_seen FROM v_labels WHERE NOT is_adjudication GROUP BY 1) l USING (annotator) ORDER BY labels DESC, annotator LIMIT 24""",
    "v_labels",
)
def annotators_full(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assembled.annotators_full(labels(spark, d)).withColumn("last_seen", F.col("last_seen").cast("long")))


@register(
    "audit_report",
    f"""WITH {near(audit.SAME_SCENE)}, t AS (SELECT count(*) AS images FROM v_images), g AS ({ORACLES['group_totals']}), r AS ({ORACLES['resolution']}), b AS ({ORACLES['balance']}),
h AS (SELECT count(*) AS n FROM v_images WHERE id NOT IN (SELECT id FROM hv)), dup AS (SELECT count(*) AS pairs, count(*) FILTER (same_group IS NOT TRUE) AS "cross" FROM np),
s AS (SELECT id, split FROM v_images WHERE split IN ('train', 'test')), l AS (SELECT count(*) AS n FROM np JOIN s x ON x.id = np.a JOIN s y ON y.id = np.b WHERE x.split <> y.split)
SELECT 'high' AS severity, 'hashes' AS area, 'no image has a perceptual hash, so nothing was compared' AS warning, n FROM h, t WHERE n > 0 AND n >= images
UNION ALL SELECT 'high', 'hashes', 'images without a perceptual hash are not compared', n FROM h, t WHERE n > 0 AND n < images
UNION ALL SELECT 'high', 'duplicates', 'near pairs in different scenes count as independent', "cross" FROM dup WHERE "cross" > 0
UNION ALL SELECT 'medium', 'duplicates', 'near pairs, all within their scene', pairs FROM dup WHERE "cross" = 0 AND pairs > 0
UNION ALL SELECT 'high', 'split', 'near pairs across train and test', n FROM l WHERE n > 0
UNION ALL SELECT 'medium', 'scenes', 'one scene has over half of the images', largest FROM g, t WHERE largest > 0.5 * images
UNION ALL SELECT 'low', 'scenes', 'images without a scene count as one each', ungrouped FROM g WHERE ungrouped > 1
UNION ALL SELECT 'medium', 'question ' || question_id, 'no case says yes or no', decidable FROM b WHERE decidable = 0
UNION ALL SELECT 'medium', 'question ' || question_id, 'one answer has over 80 %', decidable FROM b WHERE skewed
UNION ALL SELECT 'medium', 'question ' || question_id, 'fewer than 10 cases of an answer', decidable FROM b WHERE thin
UNION ALL SELECT 'medium', 'question ' || question_id, 'images without a value', unannotated FROM b WHERE unannotated > 0
UNION ALL SELECT 'low', 'resolution', 'images are scaled down before the model sees them', downscaled FROM r WHERE downscaled > 0""",
    "v_images", "v_annotations",
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    h = hashed(spark, d)
    return assembled.audit_report(images(spark, d), view(spark, d, "v_annotations"), audit.near_duplicates(h), h)


# A batch of changes made from the labels themselves: new values, withdrawals, rulings, unknown values, labels of a new reviewer.
_CHANGES = """SELECT image_id, question_id, CASE WHEN image_id % 33 = 0 THEN 'newcomer' ELSE annotator END AS annotator, CASE WHEN image_id % 35 = 0 THEN 'maybe' WHEN value = 'exclude' THEN 'yes' ELSE 'exclude' END AS value,
 is_adjudication OR image_id % 14 = 0 AS is_adjudication, updated_at + 1 + CASE WHEN is_adjudication THEN 100000000 ELSE 0 END AS updated_at, note, image_id % 21 = 0 AS withdraw FROM v_labels WHERE image_id % 7 = 0 AND annotator <= 'rev3' OR image_id % 33 = 0 AND annotator = 'rev1' AND NOT is_adjudication"""
_ADMIT = f"""{RESOLVED}, ch AS ({_CHANGES}), adm AS (SELECT ch.*, CASE WHEN withdraw AND h.image_id IS NULL THEN 'nothing to withdraw' WHEN NOT withdraw AND ch.value NOT IN ('yes', 'no', 'uncertain', 'exclude') THEN 'unknown value'
  WHEN NOT withdraw AND ch.is_adjudication AND r.image_id IS NULL THEN 'nobody disputes the case' END AS refused FROM ch LEFT JOIN (SELECT image_id, question_id FROM resolved WHERE agreement IN ('conflict', 'majority', 'adjudicated')) r ON r.image_id = ch.image_id AND r.question_id = ch.question_id
  LEFT JOIN v_labels h ON h.image_id = ch.image_id AND h.question_id = ch.question_id AND h.annotator = ch.annotator AND h.is_adjudication = ch.is_adjudication)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_CHANGES.replace("v_labels", "{v_labels}"), v_labels=labels(spark, d))


@register("label_admission", f"WITH {_ADMIT} SELECT image_id, question_id, annotator, is_adjudication, value, withdraw, refused FROM adm", "v_labels")
def label_admission(spark: SparkSession, d: str) -> DataFrame:
    return assembled.admit_labels(labels(spark, d), _changes(spark, d)).select("image_id", "question_id", "annotator", "is_adjudication", "value", "withdraw", "refused")


@register(
    "labels_after_changes",
    f"""WITH {_ADMIT}, m AS (SELECT image_id, question_id, annotator, is_adjudication, value, updated_at, false AS withdraw, 0 AS fresh FROM v_labels UNION ALL SELECT image_id, question_id, annotator, is_adjudication, value, updated_at, withdraw, 1 FROM adm WHERE refused IS NULL)
SELECT image_id, question_id, annotator, is_adjudication, value, CAST(updated_at AS BIGINT) AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY image_id, question_id, annotator, is_adjudication ORDER BY fresh DESC, updated_at DESC) AS rn FROM m) WHERE rn = 1 AND NOT withdraw""",
    "v_labels",
)
def labels_after_changes(spark: SparkSession, d: str) -> DataFrame:
    out = assembled.apply_labels(labels(spark, d), _changes(spark, d))
    return out.select("image_id", "question_id", "annotator", "is_adjudication", "value", F.col("updated_at").cast("long").alias("updated_at"))


# SQL for queries that had none.
ORACLES["agreement_warnings"] = with_views(
    f"""WITH a AS (SELECT * FROM (WITH {coef('')})), q AS (SELECT * FROM (WITH {coef('question_id')})), n AS ({ORACLES['annotator_report']}), {RESOLVED}, o AS (SELECT count(*) AS n FROM resolved WHERE agreement = 'conflict')
SELECT severity, warning, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM (
SELECT 'high' AS severity, 'one reviewer only' AS warning FROM (SELECT count(*) AS k FROM n) WHERE k = 1 UNION ALL SELECT 'medium', 'fewer than 20 cases with two labels' FROM a WHERE units < 20
UNION ALL SELECT CASE WHEN alpha < 0.4 THEN 'high' ELSE 'medium' END, 'alpha below 0.67' FROM a WHERE alpha < 0.67 UNION ALL SELECT 'medium', n || ' open conflicts' FROM o WHERE n > 0
UNION ALL SELECT 'medium', 'question ' || question_id || ': alpha below 0.4' FROM q WHERE units >= 10 AND alpha < 0.4
UNION ALL SELECT 'low', annotator || ' answers almost always alike' FROM n WHERE labels >= 20 AND (positive_share > 0.9 OR positive_share < 0.1))""",
    "v_labels",
)
ORACLES["audit_warnings"] = with_views(
    f"""WITH b AS ({ORACLES['balance']}), g AS ({ORACLES['group_totals']}), r AS ({ORACLES['resolution']}), t AS (SELECT count(*) AS images FROM v_images)
SELECT 'medium' AS severity, 'question ' || question_id || ': one answer above 80 %' AS warning FROM b WHERE skewed UNION ALL SELECT 'medium', 'question ' || question_id || ': fewer than 10 of an answer' FROM b WHERE thin
UNION ALL SELECT 'medium', 'one scene has over half of the images' FROM g, t WHERE largest > 0.5 * images UNION ALL SELECT 'low', 'images without a scene' FROM g WHERE ungrouped > 1
UNION ALL SELECT 'low', 'images that will be scaled down' FROM r WHERE downscaled > 0""",
    "v_images", "v_annotations",
)
ORACLES["fingerprint"] = with_views(
    """WITH h AS (SELECT sha256('{"answer":"' || answer || '","ground_truth":"' || ground_truth || '","image_id":' || image_id || ',"question_id":' || question_id || ',"variant_id":' || variant_id || '}') AS h FROM v_responses),
p AS (SELECT left(h, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM p""",
    "v_responses",
)


def _difference_hash(width: int, height: int) -> str:
    """The hash of text.difference_hash as SQL, over a list ``px`` of row-major luminances."""

    def cell(r: int, c: int) -> str:
        rows = range(r * height // 8, (r + 1) * height // 8)
        left, right = c * width // 9, (c + 1) * width // 9
        px = [f"px[{y * width + x + 1}]" for y in rows for x in range(left, right)]
        return f"(({' + '.join(px)}) / {len(px)})"

    def nibble(r: int, half: int) -> str:
        bits = [f"CASE WHEN {cell(r, c)} < {cell(r, c + 1)} THEN {8 >> i} ELSE 0 END" for i, c in enumerate(range(4 * half, 4 * half + 4))]
        return f"substr('0123456789abcdef', 1 + {' + '.join(bits)}, 1)"

    return " || ".join(nibble(r, half) for r in range(8) for half in (0, 1))


ORACLES["difference_hash"] = f"SELECT vec_id, {_difference_hash(18, 8)} AS phash FROM (SELECT vec_id, list_transform(list_concat(list_concat(embedding::FLOAT[], embedding::FLOAT[]), embedding::FLOAT[]), lambda x: x::DOUBLE) AS px FROM embeddings)"
