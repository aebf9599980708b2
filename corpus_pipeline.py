"""The corpus pipeline: five stages, each calling one operator of ``evalstrata.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it again as the next one's docs.
The near-duplicate stage drops all rows of an id, the benchmark stage only those
rows whose text is contaminated; equal rows stay or go together.  Stages that drop
documents keep the columns of documents; extra columns of docs are not passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalstrata.llm import decontaminate, frames, jaccard_join, pii, quality_classifier, sentencepiece_codec
from evalstrata.llm.registry import MODEL_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame, by_row: bool = False) -> DataFrame:
    """``docs`` without the rows whose id (null meets null) is in ``ids`` (doc_id), or whose id and text are (doc_id, row).

    The ids are written and counted: up to ``frames.BROADCAST_ROWS`` of them are
    broadcast, so texts stay where they are; beyond, the join shuffles.
    """
    keys = [F.col("doc_id").alias("_id")] + ([F.col("row").alias("_row")] if by_row else [])
    gone = frames.written(ids.select(*keys).distinct(), "gone")
    right = F.broadcast(gone) if gone.count() <= frames.BROADCAST_ROWS else gone
    left = docs.select(*COLUMNS)
    same = left["doc_id"].eqNullSafe(right["_id"])
    if by_row:
        same = same & (decontaminate.row_key(left["text"]) == right["_row"])
    return left.join(right, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely above the lowest (a tail probability of 0.5)."""
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"))
    return quality_classifier.select(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: that with the smallest id."""
    return _without(docs, jaccard_join.jaccard_components(docs).filter("component_id != doc_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated"), by_row=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact_column(docs.select(*COLUMNS), "text").withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load(MODEL_FILE)).drop("row")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("pii", personal_data),
    ("sentencepiece", tokens),
]

#: A fitted classifier and merge-based ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = frames.written(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
