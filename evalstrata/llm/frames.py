"""What the operators share: Arrow batches, packed texts and tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset and everything runs on this machine, as in tests, a
    folder of our own is made and set for the session; on a cluster it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="evalstrata-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
        path = spark.conf.get("spark.checkpoint.dir")
    return path.rstrip("/")


def forget_later(spark: SparkSession, path: str) -> None:
    """``path`` goes when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage so that a lost executor repeats one step and not the whole
    chain.  The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_later(spark, path)
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of what was written
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the folder of a table that ``written`` gave and that nothing reads any more."""
    spark = table.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def hand_back() -> None:
    """Gives memory that this worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df`` mapped partition by partition; the worker's memory goes back when a partition is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            hand_back()

    return df.mapInArrow(run, schema)


def columns(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``df`` mapped batch by batch: ``step`` gives the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step(batch))

    return mapped(df, run, schema)


def blobs(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (a hash of the text, telling rows of one id apart) and the UTF-8 text as data.

    Ids are whole numbers, read as 64 bits; other kinds are refused by the cast.  Other columns of ``docs`` are left behind, so their names can't clash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("row"), text.cast("binary").alias("data"))


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, for steps that send them through a shuffle: doc_id, row, packed."""

    def step(batch: pa.RecordBatch) -> dict:
        small = zstandard.ZstdCompressor(level=1)
        return {"doc_id": batch["doc_id"], "row": batch["row"], "packed": pa.array([small.compress(x) for x in blobs(batch["data"])], pa.binary())}

    return columns(docs, "doc_id long, row int, packed binary", step)


def unpack(column: pa.Array) -> list[bytes]:
    large = zstandard.ZstdDecompressor()
    return [large.decompress(x) for x in column.to_pylist()]


#: Rows of a table that may be broadcast (24 MB or so in a hash table).
BROADCAST_ROWS = 500_000


def with_texts(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """``docs`` (doc_id, row, data) joined with ``picked`` (doc_id and more).

    ``picked`` is counted: up to BROADCAST_ROWS rows it is broadcast, beyond that
    the texts go through a shuffle, compressed.
    """
    if picked.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(picked), "doc_id")
    wide = packed(docs).join(picked, "doc_id")
    names = [c for c in wide.columns if c != "packed"]

    def step(batch: pa.RecordBatch) -> dict:
        return {c: batch[c] for c in names} | {"data": pa.array(unpack(batch["packed"]), pa.binary())}

    return columns(wide, ", ".join(f"{c} {t}" for c, t in wide.dtypes if c != "packed") + ", data binary", step)
