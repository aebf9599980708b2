"""Queries over the evaluation model and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import agreement, arena, audit, diagnostics, metrics, performance, runs
from ..sources.adapters import view, with_views
from .units import unit_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
N_RUNS = 3
Z = stats.Z95


def register(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so engines that add in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def responses(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_responses")


# SQL fragments for the oracles.
ELIGIBLE = "ground_truth IN ('yes', 'no')"
PARSED = f"({ELIGIBLE} AND answer IN ('yes', 'no'))"
CORRECT = f"({PARSED} AND answer = ground_truth)"
SCENE = "CASE WHEN source_group = '' THEN 'image:' || image_id ELSE source_group END"


def sh(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


def wil(s: str, n: str) -> str:
    p, z2 = f"(CAST({s} AS DOUBLE) / {n})", f"{Z * Z}"
    den = f"(1 + {z2} / {n})"
    mid = f"(({p} + {z2} / (2.0 * {n})) / {den})"
    rad = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n})) / {den})"
    return f"round(CASE WHEN {n} > 0 THEN greatest(0.0, {mid} - {rad}) ELSE 0.0 END, 6) AS wilson_low, round(CASE WHEN {n} > 0 THEN least(1.0, {mid} + {rad}) ELSE 0.0 END, 6) AS wilson_high"


def mcnemar(b: str, c: str) -> str:
    n, m = f"({b} + {c})", f"least({b}, {c})"
    total = f"list_sum(list_transform(range(0, CAST({m} AS BIGINT) + 1), lambda k: exp(lgamma(1 + {n}) - lgamma(1 + k) - lgamma(1 + {n} - k) - {n} * ln(2))))"
    return f"round(CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * {total}) END, 6)"


UNITS = f"""u AS (SELECT run_id, question_id, image_id, variant_id, count(*) FILTER (answer = 'yes') AS y, count(*) FILTER (answer = 'no') AS n,
  any_value(ground_truth) AS ground_truth, any_value(canonical) AS canonical, any_value(mutation_type) AS mutation_type, any_value(source_group) AS source_group,
  bool_and(coalesce(format_valid, false)) AS all_valid FROM v_responses GROUP BY 1, 2, 3, 4),
units AS (SELECT *, CASE WHEN y > n THEN 'yes' WHEN n > y THEN 'no' END AS answer FROM u)"""
CASES = "cases AS (SELECT run_id, question_id, image_id, count(*) FILTER (answer = 'yes') AS vy, count(*) FILTER (answer = 'no') AS vn FROM units GROUP BY 1, 2, 3)"
PFS = f"pf AS (SELECT run_id, CAST(sum((vy + vn) * (vy + vn - 1) // 2) AS BIGINT) AS comparable_pairs, CAST(sum(vy * vn) AS BIGINT) AS disagreeing_pairs FROM cases GROUP BY 1)"
DRIFT = "dr AS (SELECT run_id, CAST(sum((y + n) * (y + n - 1) // 2) AS BIGINT) AS comparable_repeats, CAST(sum(y * n) AS BIGINT) AS disagreeing_repeats, count(*) FILTER (y = n AND y > 0) AS tie_units FROM units GROUP BY 1)"
SCENES = f"sc AS (SELECT run_id, avg(a) AS sb, count(*) AS independent_groups FROM (SELECT run_id, {SCENE} AS scene, avg(CAST({CORRECT} AS INT)) AS a FROM v_responses WHERE {PARSED} GROUP BY 1, 2) GROUP BY 1)"
BASE = f"b AS (SELECT run_id, count(*) AS samples, count(*) FILTER ({ELIGIBLE}) AS eligible, count(*) FILTER ({PARSED}) AS parsed, count(*) FILTER ({CORRECT}) AS correct, count(*) FILTER ({ELIGIBLE} AND format_valid) AS valid FROM v_responses GROUP BY 1)"
RATES = f"round({sh('correct', 'parsed')}, 6) AS accuracy, {wil('correct', 'parsed')}, round({sh('parsed', 'eligible')}, 6) AS coverage, round({sh('valid', 'eligible')}, 6) AS format_rate"


@register(
    "flagship_run_summary",
    f"""WITH {UNITS}, {CASES}, {PFS}, {DRIFT}, {SCENES}, {BASE}
SELECT run_id, samples, eligible, parsed, correct, valid, {RATES}, comparable_pairs, disagreeing_pairs, round(100 * {sh('disagreeing_pairs', 'comparable_pairs')}, 6) AS pfs,
  comparable_repeats, disagreeing_repeats, tie_units, round(100 * {sh('disagreeing_repeats', 'comparable_repeats')}, 6) AS drift, round(sb, 6) AS scene_balanced_accuracy, independent_groups
FROM b JOIN pf USING (run_id) JOIN dr USING (run_id) LEFT JOIN sc USING (run_id)""",
    "v_responses",
)
def flagship_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.run_summary(responses(spark, d)))


@register("eval_rows", "SELECT run_id, image_id, question_id, variant_id, repetition, answer, ground_truth, parser, source_group FROM v_responses", "v_responses")
def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("run_id", "image_id", "question_id", "variant_id", F.col("repetition").cast("long"), "answer", "ground_truth", "parser", "source_group")


VARIANT = f"""v AS (SELECT run_id, question_id, variant_id, canonical, mutation_type, count(*) AS samples, count(*) FILTER ({ELIGIBLE}) AS eligible, count(*) FILTER ({PARSED}) AS parsed,
  count(*) FILTER ({CORRECT}) AS correct, count(*) FILTER ({ELIGIBLE} AND format_valid) AS valid, median(latency_ms) AS median_ms, quantile_cont(latency_ms, 0.95) AS p95_ms,
  count(*) FILTER ({PARSED} AND ground_truth = 'yes') AS oy, count(*) FILTER ({PARSED} AND ground_truth = 'no') AS onn, count(*) FILTER ({CORRECT} AND ground_truth = 'yes') AS hy,
  count(*) FILTER ({CORRECT} AND ground_truth = 'no') AS hn FROM v_responses GROUP BY 1, 2, 3, 4, 5)"""


@register(
    "variant_summary",
    f"""WITH {VARIANT} SELECT run_id, question_id, variant_id, canonical, mutation_type, samples, eligible, parsed, correct, valid, {RATES}, round(median_ms, 6) AS median_ms, round(p95_ms, 6) AS p95_ms,
round(CASE WHEN oy > 0 AND onn > 0 THEN (CAST(hy AS DOUBLE) / oy + CAST(hn AS DOUBLE) / onn) / 2 END, 6) AS balanced_accuracy FROM v""",
    "v_responses",
)
def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.variant_summary(responses(spark, d)))


@register(
    "question_summary",
    f"""WITH {VARIANT} SELECT run_id, question_id, count(*) AS variant_count, round(coalesce(min(a), 0), 6) AS min_accuracy, round(coalesce(max(a), 0), 6) AS max_accuracy, round(coalesce(max(a), 0) - coalesce(min(a), 0), 6) AS spread
FROM (SELECT *, CASE WHEN parsed > 0 THEN CAST(correct AS DOUBLE) / parsed END AS a FROM v) GROUP BY 1, 2""",
    "v_responses",
)
def question_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.question_summary(responses(spark, d)))


@register(
    "parser_breakdown",
    f"""WITH p AS (SELECT run_id, parser, count(*) AS parsed, count(*) FILTER ({CORRECT}) AS correct FROM v_responses WHERE {PARSED} GROUP BY 1, 2)
SELECT run_id, parser, parsed, correct, round({sh('correct', 'parsed')}, 6) AS accuracy, {wil('correct', 'parsed')}, round(CAST(parsed AS DOUBLE) / sum(parsed) OVER (PARTITION BY run_id), 6) AS share FROM p""",
    "v_responses",
)
def parser_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.parser_breakdown(responses(spark, d)))


BASELINE = f"""c AS (SELECT run_id, question_id, image_id, any_value(ground_truth) AS truth, min({{'q': question_id, 'v': variant_id, 'i': image_id, 'r': repetition}}) AS pos FROM v_responses WHERE {ELIGIBLE} GROUP BY 1, 2, 3),
s AS (SELECT run_id, truth, count(*) AS n, min(pos) AS pos FROM c GROUP BY 1, 2),
bl AS (SELECT run_id, truth, n, CAST(sum(n) OVER (PARTITION BY run_id) AS BIGINT) AS cases, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, pos) AS rk FROM s)"""


@register("majority_baseline", f"WITH {BASELINE} SELECT run_id, truth, n, cases, round(CAST(n AS DOUBLE) / cases, 6) AS baseline FROM bl WHERE rk = 1", "v_responses")
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.majority_baseline(responses(spark, d)))


@register("prompt_fragility", f"WITH {UNITS}, {CASES}, {PFS} SELECT *, round(100 * {sh('disagreeing_pairs', 'comparable_pairs')}, 6) AS pfs FROM pf", "v_responses")
def prompt_fragility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.prompt_fragility(unit_table(responses(spark, d)), "run_id"))


@register("repeat_drift", f"WITH {UNITS}, {DRIFT} SELECT *, round(100 * {sh('disagreeing_repeats', 'comparable_repeats')}, 6) AS drift FROM dr", "v_responses")
def repeat_drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.repeat_drift(unit_table(responses(spark, d)), "run_id"))


@register(
    "fragile_cases_top100",
    f"""WITH {UNITS}, {CASES}, top AS (SELECT run_id, question_id, image_id, vy, vn, (vy + vn) * (vy + vn - 1) // 2 AS comparable, vy * vn AS disagree FROM cases WHERE vy * vn > 0 ORDER BY vy * vn DESC, run_id, image_id, question_id LIMIT 100)
SELECT t.*, (SELECT string_agg(variant_id || ':' || answer, ',' ORDER BY variant_id || ':' || answer) FROM units u WHERE u.run_id = t.run_id AND u.question_id = t.question_id AND u.image_id = t.image_id AND answer IS NOT NULL) AS answers FROM top t""",
    "v_responses",
)
def fragile_cases_top100(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fragile_cases(unit_table(responses(spark, d)))


PROVENANCE = """pc AS (SELECT run_id, question_id, image_id, max_by(gt_agreement, {'v': variant_id, 'r': repetition}) AS k, max_by(gt_labels, {'v': variant_id, 'r': repetition}) AS l FROM v_responses WHERE ground_truth IS NOT NULL GROUP BY 1, 2, 3),
pv AS (SELECT run_id, count(*) AS cases, count(*) FILTER (l >= 2) AS verified, count(*) FILTER (k = 'single') AS single, count(*) FILTER (k = 'adjudicated') AS adjudicated, count(*) FILTER (k = 'conflict') AS conflict FROM pc GROUP BY 1)"""


@register("provenance", f"WITH {PROVENANCE} SELECT *, round(CAST(verified AS DOUBLE) / cases, 6) AS verified_share FROM pv", "v_responses")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.provenance(responses(spark, d)))


@register(
    "evidence_gate",
    f"""WITH {UNITS}, {CASES}, {PFS}, {SCENES}, {BASE}, {VARIANT}, {BASELINE}, {PROVENANCE},
m AS (SELECT run_id, min(k) >= 2 AS mutation_ready FROM (SELECT run_id, question_id, count(*) AS k FROM v GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT run_id, {sh('b.parsed', 'b.eligible')} AS coverage, {sh('b.valid', 'b.eligible')} AS format_rate, coalesce(independent_groups, 0) AS groups, comparable_pairs AS comparisons,
  coalesce(bl.cases, 0) AS cases, coalesce(CAST(bl.n AS DOUBLE) / bl.cases, 0) AS baseline, mutation_ready, CAST(pv.verified AS DOUBLE) / pv.cases AS verified_share
  FROM b JOIN pf USING (run_id) LEFT JOIN sc USING (run_id) LEFT JOIN (SELECT * FROM bl WHERE rk = 1) bl USING (run_id) JOIN m USING (run_id) LEFT JOIN pv USING (run_id)),
c2 AS (SELECT *, cases >= 30 AS check_cases, groups >= 5 AS check_groups, mutation_ready AS check_mutations, coverage >= 0.95 AS check_coverage, format_rate >= 0.90 AS check_format, comparisons >= 20 AS check_comparisons,
  baseline <= 0.80 AS check_baseline, verified_share >= 0.20 AS check_verified FROM g)
SELECT run_id, round(coverage, 6) AS coverage, round(format_rate, 6) AS format_rate, groups, comparisons, cases, round(baseline, 6) AS baseline, mutation_ready, round(verified_share, 6) AS verified_share,
  CASE WHEN check_mutations AND check_coverage AND check_format AND check_comparisons AND cases >= 100 AND groups >= 15 AND comparisons >= 100 AND check_baseline AND check_verified THEN 'A'
       WHEN check_mutations AND check_coverage AND check_format AND check_comparisons AND check_cases AND check_groups AND baseline <= 0.85 THEN 'B' WHEN cases > 0 AND comparisons > 0 THEN 'C' ELSE 'E' END AS grade,
  CAST(check_cases AS BIGINT) + CAST(check_groups AS BIGINT) + CAST(check_mutations AS BIGINT) + CAST(check_coverage AS BIGINT) + CAST(check_format AS BIGINT) + CAST(check_comparisons AS BIGINT) + CAST(check_baseline AS BIGINT) + CAST(check_verified AS BIGINT) AS passed,
  check_cases, check_groups, check_mutations, check_coverage, check_format, check_comparisons, check_baseline, check_verified FROM c2""",
    "v_responses",
)
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.evidence_gate(responses(spark, d)))


@register("normalised_inputs", "SELECT run_id, count(DISTINCT image_id) FILTER (input_preprocess NOT IN ('', 'original', 'failed')) AS normalised_images FROM v_responses GROUP BY 1", "v_responses")
def normalised_inputs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.normalised_inputs(responses(spark, d))


READY = f"ready AS (SELECT *, answer = ground_truth AS \"right\" FROM units WHERE {ELIGIBLE} AND answer IS NOT NULL)"


@register(
    "paired_mcnemar",
    f"""WITH {UNITS}, {READY}, k AS (SELECT a.run_id, a.question_id, c.variant_id AS canonical_id, a.variant_id, count(*) AS paired, count(*) FILTER (c."right" AND NOT a."right") AS canonical_only, count(*) FILTER (a."right" AND NOT c."right") AS alternative_only
  FROM ready a JOIN ready c ON a.run_id = c.run_id AND a.question_id = c.question_id AND a.image_id = c.image_id AND c.canonical AND NOT a.canonical GROUP BY 1, 2, 3, 4)
SELECT *, {mcnemar('canonical_only', 'alternative_only')} AS p_value FROM k""",
    "v_responses",
)
def paired_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.paired_comparisons(unit_table(responses(spark, d))))


AU = f'au AS (SELECT run_id, question_id, image_id, variant_id, {SCENE} AS scene, "right" FROM ready)'
COMMON = f"common AS (SELECT image_id, variant_id FROM au GROUP BY 1, 2 HAVING count(*) = {N_RUNS})"


@register("arena_common_units", f"WITH {UNITS}, {READY}, {AU}, {COMMON} SELECT * FROM common", "v_responses")
def arena_common_units(spark: SparkSession, d: str) -> DataFrame:
    return arena.common_keys(arena.arena_units(responses(spark, d)), N_RUNS)


@register(
    "arena_overlap",
    f"WITH {UNITS}, {READY}, {AU}, e AS (SELECT count(*) AS r FROM au GROUP BY image_id, variant_id) SELECT count(*) FILTER (r = {N_RUNS}) AS common_units, count(*) AS union_units, round(CAST(count(*) FILTER (r = {N_RUNS}) AS DOUBLE) / count(*), 6) AS overlap_rate FROM e",
    "v_responses",
)
def arena_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arena.overlap(arena.arena_units(responses(spark, d)), N_RUNS))


RANK = f"""{UNITS}, {READY}, {AU}, {COMMON}, sh AS (SELECT au.* FROM au JOIN common USING (image_id, variant_id)),
own AS (SELECT run_id, count(*) AS own_units, count(*) FILTER ("right") AS own_correct FROM au GROUP BY 1),
bs AS (SELECT run_id, scene, count(*) AS u, count(*) FILTER ("right") AS c FROM sh GROUP BY 1, 2),
score AS (SELECT run_id, CAST(sum(u) AS BIGINT) AS units, CAST(sum(c) AS BIGINT) AS correct, avg(CAST(c AS DOUBLE) / u) AS scene_balanced FROM bs GROUP BY 1),
spd AS (SELECT run_id, median(latency_ms) AS median_ms FROM v_responses SEMI JOIN sh USING (run_id, image_id, variant_id) GROUP BY 1),
u2 AS (SELECT units.* FROM units SEMI JOIN sh USING (run_id, image_id, variant_id)),
c3 AS (SELECT run_id, count(*) FILTER (answer = 'yes') AS vy, count(*) FILTER (answer = 'no') AS vn FROM u2 GROUP BY run_id, question_id, image_id),
p3 AS (SELECT run_id, 100 * {sh('sum(vy * vn)', 'sum((vy + vn) * (vy + vn - 1) // 2)')} AS pfs FROM c3 GROUP BY 1),
d3 AS (SELECT run_id, 100 * {sh('sum(y * n)', 'sum((y + n) * (y + n - 1) // 2)')} AS drift FROM u2 GROUP BY 1),
r AS (SELECT *, CAST(correct AS DOUBLE) / units AS accuracy, CAST(own_correct AS DOUBLE) / own_units AS own_accuracy FROM score JOIN own USING (run_id) JOIN spd USING (run_id) JOIN p3 USING (run_id) JOIN d3 USING (run_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, scene_balanced DESC, pfs, drift, median_ms, run_id) AS rank FROM r)"""


@register(
    "arena_rank",
    f"WITH {RANK} SELECT run_id, units, correct, round(scene_balanced, 6) AS scene_balanced, own_units, own_correct, round(median_ms, 6) AS median_ms, round(pfs, 6) AS pfs, round(drift, 6) AS drift, round(accuracy, 6) AS accuracy, {wil('correct', 'units')}, round(own_accuracy, 6) AS own_accuracy, CAST(rank AS INT) AS rank FROM ranked",
    "v_responses",
)
def arena_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arena.arena_rank(responses(spark, d), N_RUNS))


@register(
    "arena_leaders",
    f"""WITH {RANK}, l AS (SELECT run_id, 'accuracy' AS measure, accuracy AS v FROM ranked UNION ALL SELECT run_id, 'scene_balanced', scene_balanced FROM ranked UNION ALL SELECT run_id, 'fragility', -pfs FROM ranked
UNION ALL SELECT run_id, 'drift', -drift FROM ranked UNION ALL SELECT run_id, 'speed', -CASE WHEN median_ms > 0 THEN median_ms ELSE CAST('inf' AS DOUBLE) END FROM ranked),
t AS (SELECT *, max(v) OVER (PARTITION BY measure) AS top FROM l) SELECT measure, CASE WHEN count(*) = 1 THEN min(run_id) END AS leader FROM t WHERE v = top GROUP BY 1""",
    "v_responses",
)
def arena_leaders(spark: SparkSession, d: str) -> DataFrame:
    return arena.sole_leaders(arena.arena_rank(responses(spark, d), N_RUNS))


@register(
    "arena_pairwise",
    f"""WITH {UNITS}, {READY}, {AU}, k AS (SELECT a.run_id AS run_a, b.run_id AS run_b, count(*) AS paired, count(*) FILTER (a."right" AND NOT b."right") AS a_only, count(*) FILTER (b."right" AND NOT a."right") AS b_only,
  count(*) FILTER (a."right" AND b."right") AS both_right, count(*) FILTER (NOT a."right" AND NOT b."right") AS both_wrong FROM au a JOIN au b USING (image_id, variant_id) WHERE a.run_id < b.run_id GROUP BY 1, 2),
e AS (SELECT *, CAST(a_only - b_only AS DOUBLE) / paired AS dl, {Z} * sqrt(greatest(0.0, a_only + b_only - CAST((a_only - b_only) * (a_only - b_only) AS DOUBLE) / paired) + 1) / paired AS er FROM k)
SELECT run_a, run_b, paired, a_only, b_only, both_right, both_wrong, round(dl, 6) AS delta, round(CASE WHEN paired > 1 THEN greatest(-1.0, dl - er) ELSE -1.0 END, 6) AS ci_low, round(CASE WHEN paired > 1 THEN least(1.0, dl + er) ELSE 1.0 END, 6) AS ci_high,
  {mcnemar('a_only', 'b_only')} AS p_value FROM e""",
    "v_responses",
)
def arena_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arena.arena_pairwise(responses(spark, d)))


@register("arena_signature_groups", f"SELECT {', '.join(arena.SIGNATURE)}, count(*) AS runs, min(id) AS first_run FROM v_runs WHERE status = 'completed' GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12", "v_runs")
def arena_signature_groups(spark: SparkSession, d: str) -> DataFrame:
    return arena.signature_groups(view(spark, d, "v_runs"))


@register("grid", "SELECT image_id, variant_id, CAST(repetition AS INT) AS repetition FROM (SELECT DISTINCT image_id FROM v_responses) i, (SELECT DISTINCT variant_id FROM v_responses) v, (SELECT unnest(range(0, 2)) AS repetition) r", "v_responses")
def grid(spark: SparkSession, d: str) -> DataFrame:
    rows = responses(spark, d)
    return runs.grid(rows.select("image_id").distinct(), rows.select("variant_id").distinct(), 2)


@register(
    "pending_units",
    "SELECT image_id, variant_id, CAST(repetition AS INT) AS repetition FROM (SELECT DISTINCT image_id FROM v_responses) i, (SELECT DISTINCT variant_id FROM v_responses) v, (SELECT unnest(range(0, 2)) AS repetition) r WHERE NOT EXISTS (SELECT 1 FROM v_responses x WHERE x.run_id = 1 AND x.image_id = i.image_id AND x.variant_id = v.variant_id AND x.repetition = r.repetition)",
    "v_responses",
)
def pending_units(spark: SparkSession, d: str) -> DataFrame:
    return runs.pending_units(grid(spark, d), responses(spark, d).filter("run_id = 1"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_labels")


RESOLVED = """lc AS (SELECT image_id, question_id, count(*) FILTER (NOT is_adjudication AND value = 'yes') AS cy, count(*) FILTER (NOT is_adjudication AND value = 'no') AS cn, count(*) FILTER (NOT is_adjudication AND value = 'uncertain') AS cu,
  count(*) FILTER (NOT is_adjudication AND value = 'exclude') AS ce, max_by(value, {'u': updated_at, 'a': annotator}) FILTER (is_adjudication) AS ruling, left(coalesce(string_agg(annotator || ': ' || note, ' · ' ORDER BY annotator || ': ' || note) FILTER (note <> ''), ''), 2000) AS notes FROM v_labels GROUP BY 1, 2),
ls AS (SELECT *, cy + cn + cu + ce AS n, CAST(cy > 0 AS BIGINT) + CAST(cn > 0 AS BIGINT) + CAST(cu > 0 AS BIGINT) + CAST(ce > 0 AS BIGINT) AS kinds, greatest(cy, cn, cu, ce) AS top FROM lc),
lt AS (SELECT *, CASE WHEN ruling IS NOT NULL THEN 'adjudicated' WHEN n = 1 THEN 'single' WHEN kinds = 1 THEN 'unanimous' WHEN 2 * top > n THEN 'majority' ELSE 'conflict' END AS agreement FROM ls),
resolved AS (SELECT image_id, question_id, CASE agreement WHEN 'adjudicated' THEN ruling WHEN 'conflict' THEN 'uncertain' ELSE CASE top WHEN cy THEN 'yes' WHEN cn THEN 'no' WHEN cu THEN 'uncertain' ELSE 'exclude' END END AS value, agreement, n AS label_count, kinds AS distinct_values, notes FROM lt)"""


@register("consensus", f"WITH {RESOLVED} SELECT * FROM resolved", "v_labels")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    return agreement.resolve_labels(labels(spark, d))


@register("consensus_summary", f"WITH {RESOLVED} SELECT agreement, count(*) AS cases FROM resolved GROUP BY 1", "v_labels")
def consensus_summary(spark: SparkSession, d: str) -> DataFrame:
    return agreement.consensus_summary(labels(spark, d))


@register("verified_share", f"WITH {RESOLVED} SELECT count(*) AS cases, count(*) FILTER (label_count >= 2) AS verified, round(CAST(count(*) FILTER (label_count >= 2) AS DOUBLE) / count(*), 6) AS verified_share FROM resolved", "v_labels")
def verified_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.verified_share(labels(spark, d)))


@register(
    "contested_cases",
    f"""WITH {RESOLVED}, c AS (SELECT image_id, question_id, value, agreement, label_count, distinct_values, CAST(CASE agreement WHEN 'conflict' THEN 0 WHEN 'majority' THEN 1 ELSE 2 END AS BIGINT) AS state_rank,
count(*) OVER () AS total, count(*) FILTER (agreement = 'conflict') OVER () AS unresolved FROM resolved WHERE agreement IN ('conflict', 'majority', 'adjudicated')) SELECT * FROM c ORDER BY state_rank, distinct_values DESC, image_id, question_id LIMIT 200""",
    "v_labels",
)
def contested_cases(spark: SparkSession, d: str) -> DataFrame:
    return agreement.contested_cases(labels(spark, d))


@register("annotators", "SELECT lower(annotator) AS annotator, count(*) FILTER (NOT is_adjudication) AS labels, count(*) FILTER (is_adjudication) AS adjudications, count(*) FILTER (value = 'yes' AND NOT is_adjudication) AS yes, CAST(max(updated_at) AS BIGINT) AS last_seen FROM v_labels GROUP BY 1", "v_labels")
def annotators(spark: SparkSession, d: str) -> DataFrame:
    return agreement.annotators(labels(spark, d)).withColumn("last_seen", F.col("last_seen").cast("long"))


@register(
    "annotation_board",
    f"""WITH {RESOLVED}, q AS (SELECT image_id, max(value) FILTER (lower(annotator) = 'rev2') AS mine, count(*) FILTER (lower(annotator) <> 'rev2') AS others FROM v_labels WHERE question_id = 1 AND NOT is_adjudication GROUP BY 1)
SELECT o_orderkey AS image_id, mine, coalesce(others, 0) AS others, CASE WHEN mine IS NOT NULL THEN r.value END AS consensus, r.agreement, mine IS NOT NULL AS mine_done
FROM orders LEFT JOIN q ON q.image_id = o_orderkey LEFT JOIN resolved r ON r.image_id = o_orderkey AND r.question_id = 1""",
    "v_labels",
)
def annotation_board(spark: SparkSession, d: str) -> DataFrame:
    images = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("image_id"))
    return agreement.annotation_board(labels(spark, d), images, 1, "Rev2")


def coef(keys: str, source: str = "v_labels") -> str:
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""cu AS (SELECT {k}{'image_id, question_id' if not keys else 'image_id'}, count(*) AS n, count(*) FILTER (value = 'yes') AS y, count(*) FILTER (value = 'no') AS o, count(*) FILTER (value = 'uncertain') AS u, count(*) FILTER (value = 'exclude') AS e
  FROM {source} WHERE NOT is_adjudication GROUP BY ALL HAVING count(*) >= 2),
cg AS (SELECT {k}count(*) AS units, sum(n * (n - 1) // 2) AS pairs, sum((y*y + o*o + u*u + e*e - n) // 2) AS agreed, sum(CAST(n * n - (y*y + o*o + u*u + e*e) AS DOUBLE) / (n - 1)) AS d_o, CAST(sum(n) AS DOUBLE) AS t,
  CAST(sum(y) AS DOUBLE) * sum(y) + CAST(sum(o) AS DOUBLE) * sum(o) + CAST(sum(u) AS DOUBLE) * sum(u) + CAST(sum(e) AS DOUBLE) * sum(e) AS sq, min(n) AS mn, max(n) AS mx, avg(CAST(y*y + o*o + u*u + e*e - n AS DOUBLE) / (n * (n - 1))) AS pb FROM cu {by}),
ca AS (SELECT {k}units, CAST(agreed AS DOUBLE) / nullif(pairs, 0) AS observed, CASE WHEN t >= 2 AND (t * t - sq) / (t - 1) > 0 THEN 1 - d_o / ((t * t - sq) / (t - 1)) END AS alpha,
  CASE WHEN units >= 2 AND mn = mx AND sq / (t * t) < 1 THEN (pb - sq / (t * t)) / (1 - sq / (t * t)) END AS fleiss FROM cg)
SELECT {k}units, round(observed, 6) AS observed, round(alpha, 6) AS alpha, round(fleiss, 6) AS fleiss, CASE WHEN alpha IS NULL THEN NULL WHEN alpha < 0 THEN 'worse than chance' WHEN alpha < 0.21 THEN 'slight' WHEN alpha < 0.41 THEN 'fair' WHEN alpha < 0.61 THEN 'moderate' WHEN alpha < 0.81 THEN 'substantial' ELSE 'almost perfect' END AS band FROM ca"""


@register("agreement_coefficients", f"WITH {coef('')}", "v_labels")
def agreement_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.coefficients(labels(spark, d)))


@register("agreement_by_question", f"WITH {coef('question_id')}", "v_labels")
def agreement_by_question(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.coefficients(labels(spark, d), "question_id"))


@register("fleiss_kappa_panel3", f"WITH panel AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY image_id, question_id) AS k FROM v_labels WHERE NOT is_adjudication) WHERE k = 3), {coef('', 'panel')}", "v_labels")
def fleiss_kappa_panel3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.coefficients(agreement.fixed_panel(labels(spark, d), 3)))


#: Draws of the interval of alpha over all questions.
DRAWS = 800


LABEL_PAIRS = "lp AS (SELECT x.annotator AS a, y.annotator AS b, x.value AS av, y.value AS bv FROM v_labels x JOIN v_labels y USING (image_id, question_id) WHERE x.annotator < y.annotator AND NOT x.is_adjudication AND NOT y.is_adjudication)"


@register(
    "cohen_kappa_pairs",
    f"""WITH {LABEL_PAIRS}, k AS (SELECT a, b, count(*) AS shared, count(*) FILTER (av = bv) AS agreed, CAST(count(*) FILTER (av = 'yes') * count(*) FILTER (bv = 'yes') + count(*) FILTER (av = 'no') * count(*) FILTER (bv = 'no')
  + count(*) FILTER (av = 'uncertain') * count(*) FILTER (bv = 'uncertain') + count(*) FILTER (av = 'exclude') * count(*) FILTER (bv = 'exclude') AS DOUBLE) / (count(*) * count(*)) AS pe FROM lp GROUP BY 1, 2)
SELECT a, b, shared, agreed, round(CASE WHEN shared >= 2 AND pe < 1 THEN (CAST(agreed AS DOUBLE) / shared - pe) / (1 - pe) END, 6) AS kappa FROM k""",
    "v_labels",
)
def cohen_kappa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.cohen_kappa(labels(spark, d)))


@register("confusions_top8", f"WITH {LABEL_PAIRS}, c AS (SELECT a, b, av AS a_value, bv AS b_value, count(*) AS cases FROM lp WHERE av <> bv GROUP BY 1, 2, 3, 4) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a, b ORDER BY cases DESC, a_value, b_value) AS INT) AS rank FROM c) WHERE rank <= 8", "v_labels")
def confusions_top8(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusions(labels(spark, d))


@register(
    "annotator_report",
    "SELECT annotator, count(*) AS labels, count(DISTINCT image_id) AS images, count(DISTINCT question_id) AS questions, count(*) FILTER (value = 'yes') AS n_yes, count(*) FILTER (value = 'no') AS n_no, count(*) FILTER (value = 'uncertain') AS n_uncertain, count(*) FILTER (value = 'exclude') AS n_exclude, round(CAST(count(*) FILTER (value = 'yes') AS DOUBLE) / nullif(count(*) FILTER (value IN ('yes', 'no')), 0), 6) AS positive_share FROM v_labels WHERE NOT is_adjudication GROUP BY 1",
    "v_labels",
)
def annotator_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.annotator_report(labels(spark, d)))


@register(
    "alpha_bootstrap_hash",
    """WITH cu AS (SELECT image_id, question_id, count(*) AS n, count(*) FILTER (value = 'yes') AS y, count(*) FILTER (value = 'no') AS o, count(*) FILTER (value = 'uncertain') AS u, count(*) FILTER (value = 'exclude') AS e FROM v_labels WHERE NOT is_adjudication GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT *, row_number() OVER (ORDER BY question_id, image_id) - 1 AS pos, count(*) OVER () AS total FROM cu),
t AS (SELECT rep, CAST('0x' || substr(md5('20260825|' || rep || '|' || pos), 1, 15) AS BIGINT) % total AS pos FROM p, (SELECT unnest(range(0, 800)) AS rep) r),
g AS (SELECT rep, sum(CAST(n * n - (y*y + o*o + u*u + e*e) AS DOUBLE) / (n - 1)) AS d_o, CAST(sum(n) AS DOUBLE) AS tt, CAST(sum(y) AS DOUBLE) * sum(y) + CAST(sum(o) AS DOUBLE) * sum(o) + CAST(sum(u) AS DOUBLE) * sum(u) + CAST(sum(e) AS DOUBLE) * sum(e) AS sq FROM t JOIN p USING (pos) GROUP BY 1),
a AS (SELECT CASE WHEN tt * tt - sq > 0 THEN 1 - d_o / ((tt * tt - sq) / (tt - 1)) END AS alpha FROM g)
SELECT (SELECT count(*) FROM cu) AS units, count(alpha) AS defined, round(quantile_cont(alpha, 0.025), 6) AS low, round(quantile_cont(alpha, 0.975), 6) AS high FROM a""",
    "v_labels",
)
def alpha_bootstrap_hash(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.alpha_bootstrap(labels(spark, d), draws=DRAWS))


@register("agreement_warnings")
def agreement_warnings(spark: SparkSession, d: str) -> DataFrame:
    return agreement.agreement_warnings(labels(spark, d))


PROV = """ps AS (SELECT provider_id, count(*) AS total, count(*) FILTER (parser = 'error') AS errors, CAST(count(*) FILTER (parser = 'error') AS DOUBLE) / count(*) AS error_rate,
  CAST(count(*) FILTER (parser <> 'error' AND format_valid) AS DOUBLE) / nullif(count(*) FILTER (parser <> 'error'), 0) AS format_rate, median(latency_ms) FILTER (parser <> 'error') AS median_ms,
  quantile_cont(latency_ms, 0.95) FILTER (parser <> 'error') AS p95_ms, min(latency_ms) FILTER (parser <> 'error') AS min_ms, max(latency_ms) FILTER (parser <> 'error') AS max_ms, avg(completion_tokens) FILTER (parser <> 'error') AS avg_tokens,
  CAST(sum(completion_tokens) FILTER (parser <> 'error' AND latency_ms <> 0) AS DOUBLE) / (sum(latency_ms) FILTER (parser <> 'error' AND latency_ms <> 0 AND completion_tokens IS NOT NULL) / 1000) AS tokens_per_second, max(created_at) AS last_used FROM v_calls GROUP BY 1),
pr AS (SELECT provider_id, CAST(sum(completed) AS DOUBLE) / sum(runtime_seconds) AS responses_per_second FROM v_runs WHERE runtime_seconds > 0 GROUP BY 1),
pm AS (SELECT provider_id, max_by(memory_bytes, created_at) AS memory_bytes FROM v_runs WHERE memory_bytes IS NOT NULL GROUP BY 1)"""
PERF = f"""{PROV}, perf AS (SELECT p.id AS provider_id, p.name, p.kind, p.is_demo, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, error_rate, format_rate, median_ms, p95_ms, min_ms, max_ms, avg_tokens, tokens_per_second, last_used, responses_per_second,
  CASE WHEN kind = 'ollama' AND NOT is_demo THEN memory_bytes END AS memory_bytes, kind = 'ollama' AND NOT is_demo AS memory_observable FROM v_providers p LEFT JOIN ps ON p.id = ps.provider_id LEFT JOIN pr ON p.id = pr.provider_id LEFT JOIN pm ON p.id = pm.provider_id)"""
PERF_VIEWS = ("v_providers", "v_calls", "v_runs")


def _performance(spark: SparkSession, d: str) -> DataFrame:
    return performance.provider_performance(view(spark, d, "v_providers"), view(spark, d, "v_calls"), view(spark, d, "v_runs"))


@register(
    "provider_performance",
    f"WITH {PERF} SELECT * REPLACE (round(error_rate, 6) AS error_rate, round(format_rate, 6) AS format_rate, round(median_ms, 6) AS median_ms, round(p95_ms, 6) AS p95_ms, round(min_ms, 6) AS min_ms, round(max_ms, 6) AS max_ms, round(avg_tokens, 6) AS avg_tokens, round(tokens_per_second, 6) AS tokens_per_second, round(responses_per_second, 6) AS responses_per_second) FROM perf",
    *PERF_VIEWS,
)
def provider_performance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_performance(spark, d))


@register(
    "performance_warnings",
    f"WITH {PERF} SELECT provider_id, 'fewer than 5 settled calls' AS warning FROM perf WHERE total - errors < 5 UNION ALL SELECT provider_id, 'over 10 % errors' FROM perf WHERE total >= 5 AND error_rate > 0.1 UNION ALL SELECT provider_id, 'memory cannot be observed' FROM perf WHERE NOT memory_observable",
    *PERF_VIEWS,
)
def performance_warnings(spark: SparkSession, d: str) -> DataFrame:
    return performance.performance_warnings(_performance(spark, d))


@register(
    "provider_eta",
    """WITH r AS (SELECT provider_id, latency_ms, row_number() OVER (PARTITION BY provider_id ORDER BY id DESC) AS rn FROM v_calls WHERE parser <> 'error' AND latency_ms IS NOT NULL),
s AS (SELECT provider_id, median(latency_ms) AS median_ms FROM r WHERE rn <= 200 GROUP BY 1),
p AS (SELECT provider_id, CAST(sum(greatest(total - completed, 0)) AS BIGINT) AS pending FROM v_runs WHERE status = 'running' GROUP BY 1)
SELECT provider_id, pending, round(median_ms, 6) AS median_ms, round(CASE WHEN pending = 0 THEN 0.0 ELSE median_ms * pending / 1000 END, 6) AS eta_seconds FROM p LEFT JOIN s USING (provider_id)""",
    "v_calls", "v_runs",
)
def provider_eta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(performance.eta(view(spark, d, "v_calls"), view(spark, d, "v_runs")))


@register("latest_memory", f"WITH {PROV} SELECT * FROM pm", "v_calls", "v_runs")
def latest_memory(spark: SparkSession, d: str) -> DataFrame:
    return performance.latest_memory(view(spark, d, "v_runs"))


TAGS = """vt AS (SELECT image_id, list_filter([CASE WHEN brightness < 0.30 THEN 'dark' END, CASE WHEN brightness > 0.76 THEN 'bright' END, CASE WHEN contrast < 0.13 THEN 'low_contrast' END, CASE WHEN edge_density > 0.12 THEN 'fine_detail' END,
  CASE WHEN width > 0 AND height > 0 AND least(width, height) < 512 THEN 'small_image' END, CASE WHEN width > 0 AND height > 0 AND height > 1.2 * width THEN 'portrait' END, CASE WHEN width > 0 AND height > 0 AND width > 1.2 * height THEN 'landscape' END], lambda x: x IS NOT NULL) AS visual FROM v_features)"""
DU = f"""{UNITS}, {TAGS}, du AS (SELECT run_id, question_id, image_id, variant_id, mutation_type, coalesce(visual, []) AS visual, answer <> ground_truth AS error, NOT all_valid AS format_failure,
  [mutation_type] || coalesce(visual, []) || CASE WHEN source_group <> '' THEN ['source:' || source_group] ELSE [] END AS tags FROM units LEFT JOIN vt USING (image_id) WHERE {ELIGIBLE} AND answer IS NOT NULL)"""


def _diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.diagnostic_units(responses(spark, d), view(spark, d, "v_features"))


@register("visual_tags", f"WITH {TAGS} SELECT image_id, array_to_string(visual, ',') AS tags FROM vt", "v_features")
def visual_tags(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_features").select("image_id", F.array_join(diagnostics.visual_tags(), ",").alias("tags"))


@register(
    "risk_patterns",
    f"""WITH {DU}, i AS (SELECT run_id, tag, count(*) AS units, count(*) FILTER (error) AS failures, array_to_string(list_sort(list_distinct(list(image_id) FILTER (error)))[1:6], ',') AS examples FROM (SELECT run_id, image_id, error, unnest(list_distinct(tags)) AS tag FROM du) GROUP BY 1, 2),
a AS (SELECT run_id, count(*) AS all_units, count(*) FILTER (error) AS all_failures FROM du GROUP BY 1),
o AS (SELECT *, CAST(failures AS DOUBLE) / units AS fr, CASE WHEN all_units > units THEN CAST(all_failures - failures AS DOUBLE) / (all_units - units) ELSE CAST(all_failures AS DOUBLE) / all_units END AS orr FROM i JOIN a USING (run_id) WHERE units >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fr - orr DESC, failures DESC, units DESC, tag) AS rank FROM o)
SELECT run_id, tag, units, failures, coalesce(examples, '') AS examples, all_units, all_failures, round(fr, 6) AS failure_rate, round(orr, 6) AS outside_rate, {wil('failures', 'units')}, round(fr - orr, 6) AS delta, CAST(rank AS INT) AS rank FROM r WHERE rank <= 30""",
    "v_responses", "v_features",
)
def risk_patterns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.risk_patterns(_diagnostic(spark, d)))


@register(
    "failure_clusters",
    f"""WITH {DU}, c AS (SELECT run_id, mutation_type, coalesce(visual[1], 'other_visual') AS tag, count(*) AS failures, count(*) FILTER (format_failure) AS format_failures FROM du WHERE error GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY failures DESC, mutation_type, tag) AS INT) AS rank FROM c) WHERE rank <= 12""",
    "v_responses", "v_features",
)
def failure_clusters(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.failure_clusters(_diagnostic(spark, d))


def images(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_images")


IMG_SCENE = "coalesce(nullif(trim(source_group), ''), 'image:' || id)"


@register(
    "balance",
    f"""WITH c AS (SELECT question_id, count(*) FILTER (value = 'yes') AS n_yes, count(*) FILTER (value = 'no') AS n_no, count(*) FILTER (value = 'uncertain') AS n_uncertain, count(*) FILTER (value = 'exclude') AS n_exclude FROM v_annotations WHERE value IS NOT NULL GROUP BY 1)
SELECT *, n_yes + n_no AS decidable, (SELECT count(*) FROM v_images) - (n_yes + n_no + n_uncertain + n_exclude) AS unannotated, round({sh('greatest(n_yes, n_no)', '(n_yes + n_no)')}, 6) AS majority_share, {sh('greatest(n_yes, n_no)', '(n_yes + n_no)')} > 0.8 AS skewed, n_yes + n_no > 0 AND least(n_yes, n_no) < 10 AS thin FROM c""",
    "v_images", "v_annotations",
)
def balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.balance(images(spark, d), view(spark, d, "v_annotations")))


@register("groups_top24", f"WITH g AS (SELECT {IMG_SCENE} AS scene, count(*) AS n, min(id) AS first FROM v_images GROUP BY 1) SELECT scene, n, round(CAST(n AS DOUBLE) / (SELECT count(*) FROM v_images), 6) AS share FROM g ORDER BY n DESC, first LIMIT 24", "v_images")
def groups_top24(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.groups(images(spark, d)))


@register("group_totals", f"WITH g AS (SELECT {IMG_SCENE} AS scene, count(*) AS n, bool_or(nullif(trim(source_group), '') IS NOT NULL) AS named FROM v_images GROUP BY 1) SELECT count(*) AS scenes, count(*) FILTER (named) AS named_scenes, CAST(coalesce(sum(n) FILTER (NOT named), 0) AS BIGINT) AS ungrouped, max(n) AS largest FROM g", "v_images")
def group_totals(spark: SparkSession, d: str) -> DataFrame:
    return audit.group_totals(images(spark, d))


@register(
    "resolution",
    """WITH e AS (SELECT *, CAST(greatest(width, height) AS DOUBLE) AS edge FROM v_images WHERE width > 0 AND height > 0), m AS (SELECT median(edge) AS median_edge FROM e)
SELECT min(edge) AS min_edge, max(median_edge) AS median_edge, max(edge) AS max_edge, count(*) FILTER (edge / median_edge >= 2 OR edge / median_edge <= 0.5) AS outliers, count(*) FILTER (edge > 2048) AS downscaled,
count(*) FILTER (width > 1.05 * height) AS landscape, count(*) FILTER (height > 1.05 * width) AS portrait, count(*) AS images FROM e, m""",
    "v_images",
)
def resolution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.resolution(images(spark, d)))


@register("exact_duplicates", "SELECT sha256(content) AS sha256, count(*) AS copies, min(id) AS first_id FROM v_images GROUP BY 1 HAVING count(*) > 1", "v_images")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return audit.exact_duplicates(images(spark, d))


@register("import_statuses", "WITH f AS (SELECT id, min(id) OVER (PARTITION BY sha256(content)) AS first_id FROM v_images) SELECT id, CASE WHEN id = first_id THEN 'imported' ELSE 'duplicate' END AS status, first_id FROM f", "v_images")
def import_statuses(spark: SparkSession, d: str) -> DataFrame:
    return audit.import_statuses(images(spark, d))


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return audit.vector_hashes(spark.read.parquet(f"{d}/embeddings.parquet"))


HASHED = """hv AS (SELECT vec_id AS id, label AS scene, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] < embedding[(i + 1) % 64 + 1] THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END))::BIGINT AS high,
  list_sum(list_transform(range(32, 64), lambda i: CASE WHEN embedding[i + 1] < embedding[(i + 1) % 64 + 1] THEN CAST(1 AS BIGINT) << (63 - i) ELSE 0 END))::BIGINT AS low FROM embeddings)"""


def near(limit: int) -> str:
    return f"""{HASHED}, np AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) AS BIGINT) AS distance, a.scene = b.scene AS same_group FROM hv a JOIN hv b ON a.id < b.id
WHERE bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= {limit})"""


@register("near_duplicates", f"WITH {near(12)} SELECT a, b, distance, CASE WHEN distance <= 4 THEN 'identical' ELSE 'same scene' END AS kind, same_group FROM np")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return audit.near_duplicates(hashed(spark, d))


@register("near_duplicates_20", f"WITH {near(20)} SELECT a, b, distance, CASE WHEN distance <= 4 THEN 'identical' ELSE 'same scene' END AS kind, same_group FROM np")
def near_duplicates_20(spark: SparkSession, d: str) -> DataFrame:
    return audit.near_duplicates(hashed(spark, d), 20)


CLUSTERS = f"""WITH RECURSIVE {near(audit.SAME_SCENE)}, star AS (SELECT min(id) OVER (PARTITION BY scene) AS a, id AS b FROM hv WHERE scene IS NOT NULL), e AS (SELECT a, b FROM np UNION ALL SELECT b, a FROM np UNION ALL SELECT a, b FROM star UNION ALL SELECT b, a FROM star), reach AS (SELECT id AS a, id AS b FROM hv UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), cl AS (SELECT a AS node, min(b) AS cluster FROM reach GROUP BY 1)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    h = hashed(spark, d)
    links = audit.near_duplicates(h).select("a", "b").union(audit.scene_links(h))
    return audit.clusters(h.select("id"), links)


@register("independence_clusters", f"{CLUSTERS} SELECT * FROM cl")
def independence_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)


@register("split_hash", f"{CLUSTERS} SELECT node, cluster, CASE WHEN CAST('0x' || substr(md5('42|' || cluster), 1, 7) AS BIGINT) % 10000 < 2000 THEN 'test' ELSE 'train' END AS side FROM cl")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_hash(_clusters(spark, d))


@register("split_python")
def split_python(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_python(_clusters(spark, d))


@register("split_leaks", f"WITH {near(18)}, s AS (SELECT id, split FROM v_images WHERE split IN ('train', 'test')) SELECT np.a, np.b, x.split AS a_split, y.split AS b_split FROM np JOIN s x ON x.id = np.a JOIN s y ON y.id = np.b WHERE x.split <> y.split", "v_images")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_leaks(images(spark, d), audit.near_duplicates(hashed(spark, d), 18).select("a", "b"))


@register("split_counts", "SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split NOT IN ('train', 'test')) AS unassigned FROM v_images", "v_images")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_counts(images(spark, d))


@register("audit_warnings")
def audit_warnings(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_warnings(images(spark, d), view(spark, d, "v_annotations"))


@register("ledger_newest", "SELECT id, name, status, created_at FROM v_runs WHERE archived_at IS NULL AND status = 'completed' AND contains(lower(name), 'high') ORDER BY created_at DESC, id DESC LIMIT 300", "v_runs")
def ledger_newest(spark: SparkSession, d: str) -> DataFrame:
    return runs.ledger(view(spark, d, "v_runs"), status="completed", search="HIGH").select("id", "name", "status", "created_at")


@register("project_counts", "SELECT project_id, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'paused') AS paused, max(created_at) AS newest FROM v_runs WHERE archived_at IS NULL GROUP BY 1", "v_runs")
def project_counts(spark: SparkSession, d: str) -> DataFrame:
    return runs.project_counts(view(spark, d, "v_runs"))


@register("fingerprint")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return runs.fingerprint(responses(spark, d), ["image_id", "question_id", "variant_id", "answer", "ground_truth"])


@register("wilson", f"WITH x AS (SELECT l_linenumber, l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS s FROM lineitem GROUP BY 1, 2) SELECT l_linenumber, l_returnflag, n, s, {wil('s', 'n')} FROM x")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    low, high = stats.wilson("s", "n")
    x = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("s"))
    return rounded(x.withColumns({"wilson_low": low, "wilson_high": high}))


@register("slugify", "SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'evaluation') AS slug FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", text.slugify(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"))


_PROMPT = [p.replace("'", "''") for p in text.PROMPT]


@register("build_prompt", f"SELECT p_partkey, '{_PROMPT[0]}' || trim(p_name) || '{_PROMPT[1]}' AS prompt FROM part")
def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.build_prompt(F.col("p_name")).alias("prompt"))


def _byte(x: str) -> str:
    return f"CAST('0x' || substr(sha256({x}), 1, 2) AS BIGINT)"


@register(
    "synthetic_answers",
    f"""SELECT p_partkey, CASE WHEN ({_byte('CAST(p_name AS BLOB)')} % 2 + CAST({_byte('unhex(sha256(CAST(p_name AS BLOB))) || unhex(sha256(CAST(p_type AS BLOB)))')} < 54 AS BIGINT)
+ CAST({_byte("unhex(sha256(CAST(p_name AS BLOB))) || unhex(lpad(to_hex(p_partkey), 16, '0'))")} < 12 AS BIGINT)) % 2 = 1 THEN 'yes' ELSE 'no' END AS answer FROM part""",
)
def synthetic_answers(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", text.synthetic_answer(F.col("p_name").cast("binary"), F.col("p_type").cast("binary"), F.col("p_partkey")).alias("answer"))


RAW = """SELECT item_id * 6 + k AS id, CASE k WHEN 0 THEN text WHEN 1 THEN '{"answer":"yes"}' WHEN 2 THEN '<think>' || left(text, 20) || '</think> the answer is no' WHEN 3 THEN '<think>' || left(text, 20) || ' yes'
 WHEN 4 THEN 'no' ELSE 'x {"answer":"true","why":"' || item_id || '"} no' END AS raw FROM benchmark CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) AS t"""


@register(
    "parse_verdict",
    f"""WITH r AS ({RAW}), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(raw), '[^a-z0-9_À-ÿ]+'), lambda x: x IN ('yes', 'no', 'uncertain', 'incerto'))) AS f FROM r)
SELECT id, CASE id % 6 WHEN 1 THEN 'yes' WHEN 3 THEN 'invalid' WHEN 5 THEN 'yes' WHEN 2 THEN 'no' WHEN 4 THEN 'no' ELSE CASE WHEN len(f) = 1 THEN CASE f[1] WHEN 'incerto' THEN 'uncertain' ELSE f[1] END ELSE 'invalid' END END AS answer,
id % 6 IN (1, 4) AS format_valid, CASE id % 6 WHEN 1 THEN 'json' WHEN 3 THEN 'truncated' WHEN 5 THEN 'json' WHEN 2 THEN 'word' WHEN 4 THEN 'word' ELSE CASE WHEN len(f) = 0 THEN 'none' WHEN len(f) = 1 THEN 'word' ELSE 'ambiguous' END END AS parser FROM w""",
)
def parse_verdict(spark: SparkSession, d: str) -> DataFrame:
    sql = RAW.replace("FROM benchmark CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) AS t", "FROM {benchmark} LATERAL VIEW explode(array(0, 1, 2, 3, 4, 5)) t AS k")
    sql = sql.replace("'{\"answer\":\"yes\"}'", "concat('{{\"answer\":\"yes\"', '}}')").replace("'x {\"answer\":\"true\",\"why\":\"' || item_id || '\"} no'", "concat('x {{\"answer\":\"true\",\"why\":\"', item_id, '\"}} no')")
    return text.parse_verdict(spark.sql(sql, benchmark=spark.read.parquet(f"{d}/benchmark.parquet")))


@register("format_bytes", "SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(b AS BIGINT) || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.1f GB', b / 1073741824.0) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 37 + 3 AS b FROM orders)")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", stats.format_bytes(F.col("o_orderkey") * 37 + 3).alias("size"))


@register("difference_hash")
def difference_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each vector read as an 18 by 8 picture (its values repeated)."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    pixels = F.slice(F.concat("embedding", "embedding", "embedding"), 1, 144)
    return e.select("vec_id", text.difference_hash(F.transform(pixels, lambda x: x.cast("double")), 18, 8).alias("phash"))


@register("unique_slugs", "WITH b AS (SELECT p_partkey AS id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'evaluation') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b) SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM n")
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    return text.unique_slugs(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_type")


@register(
    "reviewer_queue",
    "WITH c AS (SELECT DISTINCT image_id, question_id FROM v_labels) SELECT question_id, min(image_id) AS next_image, count(*) AS remaining FROM c WHERE NOT EXISTS (SELECT 1 FROM v_labels l WHERE l.image_id = c.image_id AND l.question_id = c.question_id AND lower(annotator) = 'rev2' AND NOT is_adjudication) GROUP BY 1",
    "v_labels",
)
def reviewer_queue(spark: SparkSession, d: str) -> DataFrame:
    return runs.reviewer_queue(labels(spark, d).select("image_id", "question_id").distinct(), labels(spark, d), "Rev2")


@register("run_progress", "SELECT r.id, r.total, coalesce(n, 0) AS done FROM v_runs r LEFT JOIN (SELECT run_id, count(*) FILTER (parser <> 'error') AS n FROM v_responses GROUP BY 1) x ON x.run_id = r.id", "v_runs", "v_responses")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    return runs.progress(view(spark, d, "v_runs"), responses(spark, d))


@register("alpha_bootstrap_python")
def alpha_bootstrap_python(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.alpha_bootstrap_python(labels(spark, d), draws=DRAWS))
