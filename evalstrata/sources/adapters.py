"""The evaluation model over the driver's tables.

Each view is one SELECT that Spark and DuckDB both read, so queries and their
oracles start from the same rows.  ``view`` gives it as a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view -> (tables it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_responses": (
        ("lineitem", "part"),
        """
SELECT run_id, image_id, question_id, variant_id, canonical, mutation_type, answer, ground_truth, format_valid, parser, latency_ms, source_group,
       gt_agreement, gt_labels, input_preprocess, completion_tokens,
       row_number() OVER (PARTITION BY run_id, image_id, variant_id ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, answer) - 1 AS repetition
FROM (SELECT 1 + l_suppkey % 3 AS run_id, l_partkey AS image_id, 1 + l_orderkey % 2 AS question_id,
             10 * (1 + l_orderkey % 2) + l_linenumber % 3 AS variant_id, l_linenumber % 3 = 0 AS canonical,
             CASE l_linenumber % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'negation' ELSE 'paraphrase' END AS mutation_type,
             CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'uncertain' END AS answer,
             CASE WHEN p_size % 10 = 0 THEN 'uncertain' WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS ground_truth,
             l_linestatus = 'F' AS format_valid,
             CASE WHEN l_returnflag = 'N' THEN 'none' WHEN l_linestatus = 'F' THEN 'json' ELSE 'word' END AS parser,
             l_quantity * 20 AS latency_ms, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand END AS source_group,
             CASE p_partkey % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'unanimous' WHEN 2 THEN 'majority' WHEN 3 THEN 'adjudicated' ELSE 'conflict' END AS gt_agreement,
             1 + p_partkey % 3 AS gt_labels,
             CASE p_size % 5 WHEN 0 THEN 'proxy-1024' WHEN 1 THEN 'original' WHEN 2 THEN 'failed' ELSE '' END AS input_preprocess,
             l_linenumber + 3 AS completion_tokens,
             l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity
      FROM lineitem JOIN part ON l_partkey = p_partkey) AS r""",
    ),
    "v_labels": (
        ("lineitem",),
        """
SELECT image_id, question_id, annotator, value, is_adjudication, updated_at, note FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, question_id, annotator, is_adjudication ORDER BY updated_at DESC, value, l_partkey, l_suppkey) AS rn
  FROM (SELECT l_orderkey AS image_id, 1 + l_orderkey % 3 AS question_id, concat('rev', l_linenumber) AS annotator,
               CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE CASE WHEN l_linestatus = 'O' THEN 'uncertain' ELSE 'exclude' END END AS value,
               l_quantity >= 49 AS is_adjudication, year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS updated_at,
               CASE WHEN l_partkey % 3 = 0 THEN concat('p', l_partkey) ELSE '' END AS note, l_partkey, l_suppkey FROM lineitem) AS x) AS y
WHERE rn = 1""",
    ),
    "v_calls": (
        ("events",),
        """
SELECT event_id AS id, user_id % 5 AS provider_id, CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN 'error' WHEN event_id % 4 = 0 THEN 'word' ELSE 'json' END AS parser,
       CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN NULL ELSE value * 10 END AS latency_ms, event_id % 3 <> 0 AS format_valid,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 40 END AS completion_tokens, event_id AS created_at
FROM events""",
    ),
    "v_runs": (
        ("orders",),
        """
SELECT o_orderkey AS id, 1 + o_custkey % 4 AS project_id, o_custkey % 6 AS provider_id, concat('Run ', o_orderpriority, ' ', o_orderkey % 97) AS name,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'paused' END AS status,
       1 + o_orderkey % 20 AS total, CASE o_orderstatus WHEN 'F' THEN 1 + o_orderkey % 20 ELSE o_orderkey % 20 END AS completed,
       CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice / 1000 END AS runtime_seconds,
       CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE NULL END AS archived_at,
       CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 1000 ELSE NULL END AS memory_bytes, o_orderkey AS created_at,
       1 + o_orderkey % 3 AS repetitions, o_orderkey % 2 AS seed, o_custkey % 3 AS split_no,
       concat('q', o_custkey % 2) AS questions, concat('v', o_orderkey % 2) AS variants, CASE WHEN o_orderkey % 4 = 0 THEN 20 ELSE 0 END AS temperature_percent,
       CASE WHEN o_custkey % 5 = 0 THEN 64 ELSE 128 END AS max_tokens
FROM orders""",
    ),
    "v_providers": (("nation",), "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'ollama' ELSE 'openai' END AS kind, n_nationkey % 3 = 0 AS is_demo FROM nation WHERE n_nationkey < 7"),
    "v_images": (
        ("documents",),
        """
SELECT doc_id AS id, text AS content, source AS source_group, n_chars AS width, n_chars % 1500 + 1 AS height,
       CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE '' END AS split FROM documents""",
    ),
    "v_annotations": (
        ("labels",),
        """
SELECT doc_id AS image_id, 1 AS question_id, CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS value FROM labels
UNION ALL SELECT doc_id, 2, CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END FROM labels""",
    ),
    "v_variants": (
        ("nation",),
        """
SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 20 THEN 2 ELSE 1 END AS question_id, n_nationkey % 10 = 0 AS canonical,
       CASE WHEN n_nationkey % 10 = 1 THEN '' ELSE n_name END AS name, CASE WHEN n_nationkey % 10 = 2 THEN NULL ELSE 'en' END AS language,
       CASE WHEN n_nationkey % 10 = 0 THEN 'canonical' WHEN n_nationkey = 11 THEN '' ELSE 'paraphrase' END AS mutation_type
FROM nation WHERE n_nationkey BETWEEN 10 AND 22 AND n_nationkey % 10 < 3""",
    ),
    "v_cards": (("part",), "SELECT p_partkey AS id, p_brand AS source_group FROM part WHERE p_partkey % 50 <> 0"),
    "v_truths": (
        ("part",),
        """
SELECT p_partkey AS image_id, 1 AS question_id, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS value FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT p_partkey, 2, 'no' FROM part WHERE p_partkey % 3 <> 0""",
    ),
    "v_features": (
        ("part",),
        """
SELECT p_partkey AS image_id, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size / 50.0 END AS brightness, p_size % 20 / 40.0 AS contrast,
       p_size % 9 / 40.0 AS edge_density, p_partkey % 1200 AS width, p_partkey % 900 AS height FROM part""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the columns that are used are read."""
    tables, sql = VIEWS[name]
    for t in tables:
        sql = _named(sql, t)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _named(sql: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {table}", f"{word} {{{table}}}")
    return sql


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front of it."""
    head = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[4:]}"
    return f"WITH {head}\n{body}"
