"""Reading the evaluation's files: tables, image folders, ground truth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SCHEMAS

# What an import takes.
EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp")
MOST_BYTES, MOST_PIXELS, MOST_FILES = 80 * 1024 * 1024, 100_000_000, 20_000


def table(spark: SparkSession, path: str, name: str, format: str = "parquet") -> DataFrame:
    """An evaluation table with its declared types; additive columns of other files are left out."""
    return spark.read.format(format).schema(SCHEMAS[name]).load(path)


def live(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(column).isNull())


def image_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, extension, length, content of the image files of a folder; other files are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join([*EXTENSIONS, *(e.upper() for e in EXTENSIONS)]) + "}").load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "length", "content")


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header of a JPEG, following its segment lengths."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        elif kind in (0x01, *range(0xD0, 0xD9)):
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, WEBP or JPEG from its header, None for anything else."""
    big, little = (lambda a, b: int.from_bytes(data[a:b], "big")), (lambda a, b: int.from_bytes(data[a:b], "little"))
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return big(16, 20), big(20, 24)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return little(6, 8), little(8, 10)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return little(24, 27) + 1, little(27, 30) + 1
        if data[12:16] == b"VP8L":
            bits = little(21, 25)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if data[12:16] == b"VP8 ":
            return little(26, 28) & 0x3FFF, little(28, 30) & 0x3FFF
    return jpeg_size(data) if data[:2] == b"\xff\xd8" else None


def with_dimensions(files: DataFrame) -> DataFrame:
    """``files`` with width and height (null where the content is no image) and without the content, hashed first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = [size_of(bytes(x)) or (None, None) for x in b["content"]]
            yield b.drop(columns="content").assign(width=pd.array([s[0] for s in sizes], "Int64"), height=pd.array([s[1] for s in sizes], "Int64"))

    rows = files.withColumn("sha256", F.sha2("content", 256))
    return rows.mapInPandas(run, "path string, extension string, length long, sha256 string, width long, height long")


def import_report(files: DataFrame, known: DataFrame, most: int | None = None) -> DataFrame:
    """path, sha256 and status of each file against the known images (sha256, deleted_at): rejected, duplicate, restored or imported.

    Of new files with one content the first by path is imported.  ``most``
    refuses larger imports (MOST_FILES for one made by hand); none by default.
    """
    if most is not None and files.select("path").limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files in one import")
    sized = with_dimensions(files)
    fits = (F.col("length") > 0) & (F.col("length") <= MOST_BYTES) & F.col("width").isNotNull() & (F.col("width") * F.col("height") <= MOST_PIXELS)
    first = sized.filter(fits).groupBy("sha256").agg(F.min("path").alias("first"))
    old = known.groupBy("sha256").agg(F.max(F.col("deleted_at").isNull()).alias("is_live"))
    out = sized.join(first, "sha256", "left").join(old, "sha256", "left")
    status = F.when(~F.coalesce(fits, F.lit(False)), "rejected").when(F.col("path") != F.col("first"), "duplicate").when(F.col("is_live"), "duplicate").when(F.col("is_live").isNotNull(), "restored").otherwise("imported")
    return out.select("path", "sha256", "width", "height", status.alias("status"))


def import_counts(report: DataFrame) -> DataFrame:
    """How many files of an ``import_report`` were imported, restored, duplicate or rejected, in one row."""
    return report.agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(s) for s in ("imported", "restored", "duplicate", "rejected")])


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """file, question and value of a ground-truth JSON ({"cases": [{"file", one field a question}]})."""
    cases = spark.read.option("multiLine", "true").schema("cases array<map<string,string>>").json(path).select(F.explode("cases").alias("c"))
    long = cases.select(F.col("c")["file"].alias("file"), F.explode("c").alias("question", "value"))
    return long.filter("question != 'file'")
