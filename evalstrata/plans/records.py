"""Queries over stored records and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..sources.adapters import view
from .queries import images, labels, register, responses, rounded


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@register(
    "wide_rows",
    """SELECT r.run_id, r.image_id, v.question_id, r.variant_id, r.repetition, v.canonical, v.mutation_type, c.source_group, r.answer, t.value AS ground_truth
FROM v_responses r JOIN v_variants v ON v.id = r.variant_id JOIN v_cards c ON c.id = r.image_id LEFT JOIN v_truths t ON t.image_id = r.image_id AND t.question_id = v.question_id""",
    "v_responses", "v_variants", "v_cards", "v_truths",
)
def wide_rows(spark: SparkSession, d: str) -> DataFrame:
    r = responses(spark, d).select("run_id", "image_id", "variant_id", "repetition", "answer")
    return records.wide_rows(r, *(view(spark, d, n) for n in ("v_variants", "v_cards", "v_truths")))


@register(
    "variant_labels",
    "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY NOT canonical, lower(name), id)::INT AS position FROM (SELECT id, question_id, canonical, coalesce(nullif(name, ''), 'Variant ' || id) AS name, coalesce(nullif(language, ''), 'und') AS language, coalesce(nullif(mutation_type, ''), 'manual') AS mutation_type FROM v_variants)",
    "v_variants",
)
def variant_labels(spark: SparkSession, d: str) -> DataFrame:
    return records.variant_labels(view(spark, d, "v_variants"))


@register("split_filter", "SELECT image_id, question_id, value FROM v_annotations JOIN v_images i ON i.id = image_id WHERE i.split = 'test'", "v_annotations", "v_images")
def split_filter(spark: SparkSession, d: str) -> DataFrame:
    return records.split_filter(view(spark, d, "v_annotations"), images(spark, d), "test").select("image_id", "question_id", "value")


@register(
    "ledger_joined",
    "SELECT r.id, r.name, r.status, r.created_at, p.name AS provider, p.kind AS provider_kind, count(*) OVER () > 300 AS truncated FROM v_runs r JOIN v_providers p ON p.id = r.provider_id WHERE archived_at IS NULL AND project_id = 2 ORDER BY r.created_at DESC, r.id DESC LIMIT 300",
    "v_runs", "v_providers",
)
def ledger_joined(spark: SparkSession, d: str) -> DataFrame:
    return records.ledger_joined(view(spark, d, "v_runs"), view(spark, d, "v_providers"), project=2).select("id", "name", "status", "created_at", "provider", "provider_kind", "truncated")


@register("owned_cases", "SELECT DISTINCT image_id, question_id, image_id % 2 AS project_id FROM v_labels WHERE image_id % 2 = question_id % 2", "v_labels")
def owned_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = labels(spark, d).select("image_id", "question_id").distinct()
    return records.owned_cases(cases, cases.selectExpr("image_id as id", "image_id % 2 as project_id").distinct(), cases.selectExpr("question_id as id", "question_id % 2 as project_id").distinct())


@register("backfill", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    new = _table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return records.backfill(_table(spark, d, "part").select("p_partkey", "p_name"), new, ["p_partkey"])


@register("missing_features", "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM v_features f WHERE f.image_id = p_partkey AND f.image_id % 3 = 1)", "v_features")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    cache = view(spark, d, "v_features").withColumn("extractor_version", F.col("image_id") % 3)
    return records.missing_features(_table(spark, d, "part").select(F.col("p_partkey").alias("id")), cache, 1)


@register(
    "resolution_outliers",
    "WITH e AS (SELECT id, greatest(width, height) AS long_edge FROM v_images WHERE width > 0 AND height > 0), m AS (SELECT quantile_cont(long_edge, 0.5) AS median FROM e) SELECT id, long_edge, round(long_edge / median, 6) AS ratio FROM e, m WHERE long_edge / median >= 2 OR long_edge / median <= 0.5 ORDER BY long_edge / median DESC, id LIMIT 24",
    "v_images",
)
def resolution_outliers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(records.resolution_outliers(images(spark, d)))


@register(
    "annotator_pairs",
    """WITH own AS (SELECT image_id, question_id, annotator, value FROM v_labels WHERE NOT is_adjudication), n AS (SELECT DISTINCT annotator FROM own),
p AS (SELECT x.annotator AS a, y.annotator AS b FROM n x JOIN n y ON x.annotator < y.annotator),
s AS (SELECT x.annotator AS a, y.annotator AS b, count(*) AS shared, count(*) FILTER (x.value = y.value) AS agreed FROM own x JOIN own y USING (image_id, question_id) WHERE x.annotator < y.annotator GROUP BY ALL)
SELECT a, b, coalesce(shared, 0) AS shared, coalesce(agreed, 0) AS agreed, round(agreed / shared, 6) AS observed FROM p LEFT JOIN s USING (a, b)""",
    "v_labels",
)
def annotator_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(records.annotator_pairs(labels(spark, d)))


@register("kept_text", "SELECT doc_id, left(text, 500) AS message, length(left(text, 2000)) AS error_size FROM documents")
def kept_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", records.kept_text(t, "message").alias("message"), F.length(records.kept_text(t, "error")).cast("long").alias("error_size"))


@register("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped, replace(html, '</', '<\\/') AS in_script FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return _table(spark, d, "pages").select("page_id", records.html_escape(h).alias("escaped"), records.script_safe(h).alias("in_script"))


@register(
    "memory_of_tag",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 2 THEN n_nationkey * 100 END::BIGINT AS size, CASE WHEN n_nationkey % 3 <> 2 THEN n_nationkey * 10 END::BIGINT AS in_graphics_memory FROM nation",
)
def memory_of_tag(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda name, n: F.struct(name.alias("name"), n.cast("bigint").alias("size"), (n / 10).cast("bigint").alias("size_vram"))
    key, name = F.col("n_nationkey"), F.col("n_name")
    loaded = F.array(entry(F.concat(name, F.lit(":latest")), F.lit(7)), entry(F.when(key % 3 != 2, name).otherwise(F.lower(name)), key * 100), entry(name.substr(F.lit(1), F.length(name) - 1), F.lit(9)))
    return _table(spark, d, "nation").select("n_nationkey", records.memory_of_tag(loaded, name).alias("m")).select("n_nationkey", "m.*")


@register(
    "image_features",
    """WITH p AS (SELECT l_orderkey AS id, l_linenumber % 3 AS x, floor(l_linenumber / 3.0) AS y, min(l_suppkey % 256) AS r, min(l_partkey % 256) AS g, min(CAST(l_quantity AS BIGINT) % 256) AS b FROM lineitem GROUP BY ALL),
l AS (SELECT id, x, y, (r * 0.2126 + g * 0.7152 + b * 0.0722) / 255.0 AS l, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s FROM p),
w AS (SELECT *, abs(lead(l) OVER (PARTITION BY id, y ORDER BY x) - l) AS rt, abs(lead(l) OVER (PARTITION BY id, x ORDER BY y) - l) AS dn FROM l)
SELECT id, round(avg(l), 6) AS brightness, round(stddev_pop(l), 6) AS contrast, round(avg(s), 6) AS saturation, round(CASE WHEN count(rt) + count(dn) > 0 THEN (coalesce(sum(rt), 0) + coalesce(sum(dn), 0)) / (count(rt) + count(dn)) ELSE 0 END, 6) AS edge_density FROM w GROUP BY id""",
)
def image_features(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "lineitem").selectExpr("l_orderkey as id", "l_linenumber % 3 as x", "floor(l_linenumber / 3) as y", "l_suppkey % 256 as r", "l_partkey % 256 as g", "cast(l_quantity as bigint) % 256 as b")
    return rounded(records.image_features(p.groupBy("id", "x", "y").agg(F.min("r").alias("r"), F.min("g").alias("g"), F.min("b").alias("b"))))
