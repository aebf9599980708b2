"""Removal of passages that an earlier document has (substring dedup).

Relative Lempel-Ziv parsing at the scale of a corpus.  Every document is cut
into reference blocks: a block is the stretch of words whose windows (50 words)
share one anchor, the smallest hash of the 8-word runs inside the window.  The
cut depends on content alone, so equal stretches are cut alike wherever they
stand.  All blocks of all documents are indexed by (anchor, content) with the
earliest document that has them.  Each document is then parsed greedily, left to
right, against that index: a factor begins at a block that an earlier document
has and takes every next block of that kind; factors of 50 words or more become
duplicate spans.  What is left to check lies at factor boundaries, where a block
as a whole is new but its anchor is known: there each single window is looked up.

The index holds about one entry per 20 words, and each (anchor, content) pair
keeps one minimum, combined before the shuffle, so a passage that a third of
all documents share costs one row per task.  Keys are 128 bits wide for blocks
and 96 for windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .text import Sequences, mix, word_bounds, word_hashes

WINDOW, GRAM = 50, 8


def blocks_of(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchor, content, first window and number of windows of each reference block."""
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    seq, width = Sequences(hashes), window - gram + 1
    grams = seq.windows(gram)
    anchor = sliding_window_view(grams, width).argmin(1) + np.arange(len(hashes) - window + 1)
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    end = np.r_[start[1:], len(anchor)]
    place = ((anchor[start] - start) * (window + 1) + (end - start)).astype(np.uint64)
    return grams[anchor[start]], seq.of(start, end + window - 1) ^ mix(place), start, end - start


def reference_blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        found = [blocks_of(word_hashes(x), window, gram) for x in frames.blobs(batch["data"])]
        size = [len(x[0]) for x in found]
        pick = np.repeat(np.arange(len(size)), size)
        anchor, content, start, count = (np.concatenate([x[i] for x in found]) for i in range(4))
        return {"doc_id": batch["doc_id"].take(pa.array(pick)), "row": batch["row"].take(pa.array(pick)), "anchor": anchor.view(np.int64), "content": content.view(np.int64), "start": start.astype(np.int32), "count": count.astype(np.int16)}

    return frames.columns(docs, "doc_id long, row int, anchor long, content long, start int, count short", step)


def factors_of(blocks: list[dict], window: int = WINDOW) -> tuple[list[tuple[int, int]], list[dict]]:
    """Word ranges of the greedy factors of a document, and the new blocks at their boundaries.

    ``blocks`` are those that an earlier document has (known) and new ones whose
    anchor is known, each with its first window and number of windows.
    """
    factors, edges, begun, end = [], [], None, -1  # the windows of the factor so far: [begun, end)

    def close() -> None:
        if begun is not None and end - begun + window - 1 >= window:
            factors.append((begun, end + window - 1))

    for b in sorted(blocks, key=lambda x: x["start"]):
        if not b["known"]:
            edges.append(b)
        elif begun is not None and b["start"] == end:
            end += b["count"]
        else:
            close()
            begun, end = b["start"], b["start"] + b["count"]
    close()
    return factors, edges


def parse(blocks: DataFrame, window: int) -> DataFrame:
    """doc_id, row, factors (word ranges [start, end)) and edges (start, count, anchor) of each document's blocks."""

    def step(batch: pa.RecordBatch) -> dict:
        factors, edges = [], []
        for found in batch["blocks"].to_pylist():
            f, e = factors_of(found, window)
            factors.append([{"start": a, "end": b} for a, b in f])
            edges.append([{k: x[k] for k in ("start", "count", "anchor")} for x in e])
        kinds = [pa.list_(pa.struct(x)) for x in ([("start", pa.int32()), ("end", pa.int32())], [("start", pa.int32()), ("count", pa.int16()), ("anchor", pa.int64())])]
        return {"doc_id": batch["doc_id"], "row": batch["row"], "factors": pa.array(factors, kinds[0]), "edges": pa.array(edges, kinds[1])}

    return frames.columns(blocks, "doc_id long, row int, factors array<struct<start:int,end:int>>, edges array<struct<start:int,count:short,anchor:long>>", step)


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, row, spans: word ranges [start, end) of ``docs`` (doc_id, row, data) to remove."""
    blocks = frames.written(reference_blocks(docs.filter("doc_id is not null"), window, gram), "blocks")
    index = blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    split = blocks.groupBy("anchor").agg((F.min("content") != F.max("content")).alias("split")).filter("split")
    index = index.join(split, "anchor", "left").filter("split or first < last")
    factors = frames.written(
        blocks.join(index, ["anchor", "content"])
        .select("doc_id", "row", "anchor", "start", "count", (F.col("first") < F.col("doc_id")).alias("known"), "split")
        .filter("known or split")
        .drop("split"),
        "factors",
    )
    blocks_by_document = factors.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "count", "anchor", "known")).alias("blocks"))
    parsed = frames.written(parse(blocks_by_document, window), "parsed")
    edges = parsed.filter(F.size("edges") > 0).select("doc_id", "row", "edges")

    def step(batch: pa.RecordBatch) -> dict:
        out = [[], [], [], [], []]
        for doc, row, text, edges in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), frames.unpack(batch["packed"]), batch["edges"].to_pylist(), strict=True):
            whole = Sequences(word_hashes(text)).windows(window)
            for e in edges:
                some = np.arange(e["start"], e["start"] + e["count"])
                for part, x in zip(out, (np.full(len(some), doc), np.full(len(some), row, np.int32), whole[some].view(np.int64), np.full(len(some), e["anchor"] >> 32, np.int32), some.astype(np.int32)), strict=True):
                    part.append(x)
        return dict(zip(("doc_id", "row", "content", "tag", "start"), map(np.concatenate, out), strict=True))

    windows = frames.columns(frames.packed(docs).join(edges, ["doc_id", "row"]), "doc_id long, row int, content long, tag int, start int", step)
    windows = frames.written(windows, "windows")
    earliest = windows.groupBy("content", "tag").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    boundary = windows.join(earliest, ["content", "tag"]).filter("first < doc_id").select("doc_id", "row", "start", (F.col("start") + F.lit(window)).alias("end"))
    boundary = boundary.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    spans = F.concat("factors", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,end:int>>)")))
    return parsed.join(boundary, ["doc_id", "row"], "left").select("doc_id", "row", spans.alias("spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Each document without the words that a window of an earlier document covers.

    Returns doc_id, kept (the words left, joined by one space), n_words,
    n_removed and spans (the removed word ranges, merged, in order).  "Earlier"
    means a smaller id.  A null or empty text has no words; a document with
    fewer than ``window`` words keeps them all; rows that repeat an id never
    remove each other and each come back; a row without an id is kept whole and
    removes nothing; other columns are ignored; an empty table gives no rows.  Windows are judged on the
    input, never on what is left of it.
    """
    rows = frames.documents(docs, id_col, text_col)
    spans = duplicate_spans(rows, window, gram)

    def step(batch: pa.RecordBatch) -> dict:
        kept, words, removed, merged = [], [], [], []
        for text, spans in zip(frames.unpack(batch["packed"]), batch["spans"].to_pylist(), strict=True):
            start, end = word_bounds(text)
            n = len(start)
            depth = np.zeros(n + 1, np.int32)
            for s in spans or ():
                depth[s["start"]] += 1
                depth[s["end"]] -= 1
            gone = np.cumsum(depth[:n]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            merged.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(b" ".join(w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g).decode())
            words.append(n)
            removed.append(int(gone.sum()))
        return {"doc_id": batch["doc_id"], "kept": pa.array(kept, pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}

    return frames.columns(frames.packed(rows).join(spans, ["doc_id", "row"], "left"), "doc_id long, kept string, n_words long, n_removed long, spans array<struct<start:long,end:long>>", step)
