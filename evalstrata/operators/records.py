"""Joins and filters over the stored records: wide rows, ledger, cases, splits, features and texts as they are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .quantiles import quantiles

# How many characters of a text are kept.
KEPT = {"raw": 50_000, "error": 2000, "call_error": 1000, "message": 500}
#: Long edges this many times the median, or this part of it, stand out; so many are listed.
OUTLIER, MOST_OUTLIERS = 2.0, 24


def wide_rows(responses: DataFrame, variants: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row a response with its variant, image and, where there is one, the case's annotation.

    Annotations are matched by (image_id, question_id) and may be missing, so
    they are an outer side; a response of an unknown variant or image is left
    out.  Variants are few, so Spark may broadcast them by size; nothing forces it.
    """
    v = variants.select(F.col("id").alias("variant_id"), "question_id", "canonical", "mutation_type")
    i = images.select(F.col("id").alias("image_id"), "source_group")
    a = annotations.select("image_id", "question_id", F.col("value").alias("ground_truth"))
    out = responses.join(v, "variant_id").join(i, "image_id").join(a, ["image_id", "question_id"], "left")
    return out.select("run_id", "image_id", "question_id", "variant_id", "repetition", "canonical", "mutation_type", "source_group", "answer", "ground_truth")


def variant_labels(variants: DataFrame) -> DataFrame:
    """Variants in the order of a report, with what stands in for a missing name, language or mutation."""
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    out = variants.select("id", "question_id", "canonical", filled("name", F.concat(F.lit("Variant "), F.col("id").cast("string"))).alias("name"), filled("language", F.lit("und")).alias("language"), filled("mutation_type", F.lit("manual")).alias("mutation_type"))
    return out.withColumn("position", F.row_number().over(W.partitionBy("question_id").orderBy(~F.col("canonical"), F.lower("name"), "id"))).orderBy("question_id", "position")


def split_filter(grid: DataFrame, images: DataFrame, split: str = "") -> DataFrame:
    """The grid of one side of the split, all of it for no side; refuses a side without images."""
    if not split:
        return grid
    side = images.filter(F.col("split") == split).select(F.col("id").alias("image_id"))
    if side.isEmpty():
        raise ValueError(f"no image is assigned to {split}")
    return grid.join(side, "image_id", "left_semi")


def ledger_joined(runs: DataFrame, providers: DataFrame, project: int | None = None, limit: int = 300) -> DataFrame:
    """Live runs with their provider's name and kind, newest first, and whether more than ``limit`` were there."""
    out = runs.filter("archived_at is null")
    if project is not None:
        out = out.filter(F.col("project_id") == project)
    out = out.join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider"), F.col("kind").alias("provider_kind")), "provider_id")
    top = out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)  # one more than is shown
    rank = F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("id")))  # of limit + 1 rows
    return top.withColumn("rank", rank).withColumn("truncated", F.max("rank").over(W.partitionBy()) > limit).filter(F.col("rank") <= limit).drop("rank")


def owned_cases(cases: DataFrame, images: DataFrame, questions: DataFrame) -> DataFrame:
    """Cases (image_id, question_id) whose image and question are of one project."""
    of_image = images.select(F.col("id").alias("image_id"), F.col("project_id").alias("image_project"))
    of_question = questions.select(F.col("id").alias("question_id"), F.col("project_id").alias("question_project"))
    return cases.join(of_image, "image_id").join(of_question, "question_id").filter("image_project = question_project").select("image_id", "question_id", F.col("image_project").alias("project_id"))


def backfill(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` whose key ``new`` does not have yet."""
    return old.join(new.select(*key).distinct(), key, "left_anti")


def missing_features(images: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Images to extract: those without a stored row of this extractor version."""
    have = cache.filter(F.col("extractor_version") == version).select(F.col("image_id").alias("id")).distinct()
    return images.join(have, "id", "left_anti")


def assign_split(images: DataFrame, sides: DataFrame) -> DataFrame:
    """Images with the side of ``sides`` (node, side); one that it does not name loses its side."""
    return images.drop("split").join(sides.select(F.col("node").alias("id"), F.col("side").alias("split")), "id", "left").withColumn("split", F.coalesce("split", F.lit("")))


def clear_split(images: DataFrame) -> DataFrame:
    return images.withColumn("split", F.lit(""))


def resolution_outliers(images: DataFrame) -> DataFrame:
    """id, long_edge and ratio of images whose long edge is far from the median, the farthest above first.

    The median comes from counts by edge, so no task holds an edge twice.
    """
    edges = images.filter("width > 0 and height > 0").select("id", F.greatest("width", "height").alias("long_edge"))
    counts = edges.groupBy("long_edge").agg(F.count("*").alias("n"))
    mid = quantiles(counts, "long_edge", {"median": 0.5})
    ratio = F.col("long_edge") / F.col("median")
    out = edges.join(F.broadcast(mid)).withColumn("ratio", ratio).filter((F.col("ratio") >= OUTLIER) | (F.col("ratio") <= 1 / OUTLIER))  # mid is one row
    return out.select("id", "long_edge", "ratio").orderBy(F.desc("ratio"), "id").limit(MOST_OUTLIERS)


def annotator_pairs(labels: DataFrame) -> DataFrame:
    """Every pair of annotators with the cases that both labelled (0 too) and those they agree on.

    Annotators are few against labels: the frame of pairs comes from the
    distinct names, the counts from one join on the case.
    """
    own = labels.filter(~F.col("is_adjudication")).select("image_id", "question_id", "annotator", "value")
    names = own.select("annotator").distinct()
    frame = names.select(F.col("annotator").alias("a")).join(names.select(F.col("annotator").alias("b")), F.col("a") < F.col("b"))
    left, right = own.withColumnsRenamed({"annotator": "a", "value": "av"}), own.withColumnsRenamed({"annotator": "b", "value": "bv"})
    both = left.join(right, ["image_id", "question_id"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("av") == F.col("bv")).alias("agreed"))
    out = frame.join(both, ["a", "b"], "left").fillna(0, ["shared", "agreed"])
    return out.withColumn("observed", F.when(F.col("shared") > 0, F.col("agreed") / F.col("shared"))).orderBy(F.desc("shared"), "a", "b")


def memory_of_tag(reading: Column, tag: Column) -> Column:
    """size and in_graphics_memory of the first loaded model (an array of name, size, size_vram) whose name is exactly the tag."""
    hit = F.get(F.filter(F.coalesce(reading, F.array().cast("array<struct<name:string,size:bigint,size_vram:bigint>>")), lambda m: m["name"] == tag), F.lit(0))
    return F.struct(hit["size"].alias("size"), hit["size_vram"].alias("in_graphics_memory"))


def kept_text(x: Column, kind: str) -> Column:
    """A text as it is stored: its first characters."""
    return F.left(x, F.lit(KEPT[kind]))


def html_escape(x: Column) -> Column:
    """Text inside HTML: the five characters that have a meaning there, the ampersand first."""
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(c), F.lit(entity))
    return x


def script_safe(x: Column) -> Column:
    """JSON inside a script element: no closing tag can begin in it."""
    return F.replace(x, F.lit("</"), F.lit("<\\/"))


def percent(x: Column, digits: int = 1) -> Column:
    """A share as text, a dash for null."""
    return F.when(x.isNull(), "—").otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def coefficient(x: Column) -> Column:
    """A chance-corrected coefficient as text, a dash for null."""
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.3f", x))


def image_features(pixels: DataFrame) -> DataFrame:
    """id, brightness, contrast, saturation and edge_density of pictures given as rows (id, x, y, r, g, b; 0 to 255).

    Luminance is Rec. 709; contrast its population deviation; saturation the mean
    of (max - min) / max; edge density the mean absolute difference to the right
    and to the lower neighbour.  Long form, so sizes may vary by picture and a
    large one is spread over tasks by its rows.
    """
    luma = (F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722) / 255.0
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    p = pixels.select("id", "x", "y", luma.alias("l"), F.when(top > 0, (top - low) / top).otherwise(0.0).alias("s"))
    right = F.abs(F.lead("l").over(W.partitionBy("id", "y").orderBy("x")) - F.col("l"))
    down = F.abs(F.lead("l").over(W.partitionBy("id", "x").orderBy("y")) - F.col("l"))
    p = p.withColumn("right", right).withColumn("down", down)
    steps = F.count("right") + F.count("down")
    edge = F.when(steps > 0, (F.coalesce(F.sum("right"), F.lit(0.0)) + F.coalesce(F.sum("down"), F.lit(0.0))) / steps).otherwise(0.0)
    return p.groupBy("id").agg(F.avg("l").alias("brightness"), F.stddev_pop("l").alias("contrast"), F.avg("s").alias("saturation"), edge.alias("edge_density"))
