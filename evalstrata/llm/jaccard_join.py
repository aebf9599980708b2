"""Documents that share most of their word shingles (n-gram Jaccard join by PartEnum).

A document's set is its distinct 5-word shingles, as 64-bit hashes.  Sets fall
into size bands [8**(b-1), 8**b); a set that may have a partner in the next band
signs there too.  Inside a band the shingle domain is partitioned, by hash, into
as many parts as the band's largest set has shingles (sets under 64 shingles:
one part a shingle).  Jaccard >= t means a symmetric difference of at most
d = (1-t)/(1+t) (|r|+|s|) shingles, which touches at most d parts; so two such
sets project equally on all but d of their non-empty parts.  The signatures of a
set are subsets of its part projections: any d+1 of them under one order that
all sets share must meet the partner's d+1.  That order puts projections on
common shingles last, so passages that many documents quote sign nothing.
(64 shingles or more in at least as many parts occupy over d parts but for a
chance below 1e-15.)

Verification never emits a group's pairs.  Each group that shares a signature
is first held against its best-connected member; what links there is one
component.  In groups that still hold several components, the pairs across
components are candidates.  Of both kinds a pair goes on only if parity sketches
(1024 bits, or more for larger sets) of its sets differ in at most d bits, which no linking pair exceeds.
What is left is checked exactly on the documents' sets; only texts of such pairs
travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .components import components
from .text import Sequences, mix, word_hashes

SHINGLE, PERCENT = 5, 75
#: Shingles whose counts order the signatures: at most so many (4 MB), each in so many documents at least.  They steer cost, never results.
COMMON, COMMON_FROM = 1 << 18, 4
#: Shingles counted together in one task; those seen once there are left out of the order.
COUNTED = 1 << 22
#: Bits of the parity sketch of a set, at least.
SKETCH = 1024
#: Exact copies within a task sign once; so many sets are remembered for that.
SEEN = 100_000
SMALL = 64
#: Slots of the bitmap that tells which texts verification needs: at most 2**18 rows of 64 slots are broadcast, whatever the input.
SLOTS = 1 << 24


def shingles_of(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    words = word_hashes(text, fold=True)
    if not len(words):
        return words
    return np.unique(Sequences(words).windows(min(size, len(words))))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and their counts over all documents."""

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"shingle": value[n >= 2].view(np.int64), "n": n[n >= 2]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        for batch in batches:
            for text in frames.blobs(batch["data"]):
                words = word_hashes(text, fold=True)
                name = xxhash.xxh3_64_intdigest(words.tobytes())
                if name in seen:  # copies would crowd out what other documents quote
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                held.append(Sequences(words).windows(size))
                total += len(words)
                if total >= COUNTED:
                    yield count(held)
                    held, total = [], 0
        if held:
            yield count(held)

    top = frames.mapped(docs, run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_FROM)
    got = top.orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    shingle, n = got["shingle"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return shingle[order], n[order]


def signatures(members: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one set; ``count`` is how common each member is, 0 for rare."""
    n = len(members)
    band = 1
    while 8**band <= n:
        band += 1
    most = n * 100 // percent  # the largest partner
    out = []
    for b in (band, band + 1) if most >= 8**band else (band,):
        part = members if 8**b <= SMALL else members % np.uint64(8**b)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
        salt = mix(part[order][first] * np.uint64(64) + np.uint64(b))
        projection = mix(np.add.reduceat(members[order], first) ^ salt)
        common = np.minimum.reduceat(count[order], first)
        differ = (100 - percent) * (n + (min(most, 8**band - 1) if b == band else most)) // (100 + percent)
        out.append(projection[np.lexsort((projection, common))[: differ + 1]])
    return np.concatenate(out)


def sketch_of(members: np.ndarray) -> bytes:
    """The parity of the number of members in each slot; two sketches differ in no more bits than their sets in members.

    There are SKETCH slots, or the power of two from the set's size on: with
    fewer slots than members strangers would not differ enough to be told apart.
    """
    slots = max(SKETCH, 1 << (len(members) - 1).bit_length()) if len(members) else SKETCH
    slot = (mix(members) >> np.uint64(33)).astype(np.int64) % slots
    return np.packbits(np.bincount(slot, minlength=slots).astype(np.uint8) & 1).tobytes()


def folded(sketch: bytes, size: int = SKETCH // 8) -> bytes:
    """The sketch of the same set with fewer slots, in ``size`` bytes."""
    return sketch if len(sketch) == size else np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, with the slots of the smaller one."""
    size = min(len(x), len(y))
    a, b = (np.frombuffer(folded(s, size), np.uint64) for s in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def signed_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (set size), a, b (128 bits naming the set), sketch and signatures; a task signs each set once, at its first row with an id."""
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = held.value
        seen: set[int] = set()
        for batch in batches:
            n, a, b, sketches, signs = [], [], [], [], []
            for known, text in zip(batch["doc_id"].is_valid().to_pylist(), frames.blobs(batch["data"]), strict=True):
                members = shingles_of(text, size)
                name = xxhash.xxh3_128_intdigest(members.tobytes())
                n.append(len(members))
                a.append((name >> 64) - (1 << 63))
                b.append((name & ((1 << 64) - 1)) - (1 << 63))
                sketches.append(sketch_of(members))
                if name in seen or not len(members) or not known:
                    signs.append(np.zeros(0, np.uint64))
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                at = np.minimum(np.searchsorted(common, members), max(0, len(common) - 1))
                count = np.where(common[at] == members, counts[at], 0) if len(common) else np.zeros(len(members), np.int64)
                signs.append(signatures(members, count, percent))
            if n:
                ends = np.cumsum([0, *map(len, signs)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(signs).view(np.int64)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n": pa.array(n, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sketch": pa.array(sketches, pa.binary()), "signatures": lists})

    return frames.mapped(docs, run, "doc_id long, n long, a long, b long, sketch binary, signatures array<long>")


def _grouped(df: DataFrame, key: str, schema: str, step) -> DataFrame:
    """``step`` on the columns of each partition, as arrays sorted by ``key``, after dealing the rows out by it."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(batches)
        if sum(b.num_rows for b in table):
            cols = {c: np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in table]) for c in names}
            del table
            order = np.argsort(cols[key], kind="stable")
            cols = {c: v[order] for c, v in cols.items()}
            edge = np.flatnonzero(np.r_[True, np.diff(cols[key]) != 0])
            for out in step(cols, edge, np.diff(np.r_[edge, len(order)])):
                for at in range(0, len(next(iter(out.values()))), 100_000):
                    yield pa.RecordBatch.from_pydict({c: v[at : at + 100_000] for c, v in out.items()})

    return frames.mapped(df.repartition(key), run, schema)


def _shared(cols: dict, edge: np.ndarray, size: np.ndarray) -> Iterator[dict]:
    """Groups of different sets that share a signature, under a name of the group in the place of the signature.

    A set is in a group once: copies that several tasks signed need no signature
    to meet.  Near copies share many signatures and would come back as many equal
    groups; under their name those are one.
    """
    keep = np.repeat(size > 1, size)
    sign, a = cols["sign"][keep], cols["a"][keep]
    order = np.lexsort((a, sign))
    sign, a = sign[order], a[order]
    fresh = np.ones(len(sign), bool)
    fresh[1:] = (sign[1:] != sign[:-1]) | (a[1:] != a[:-1])
    sign, a = sign[fresh], a[fresh]
    if len(sign):
        edge = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
        sets = np.diff(np.r_[edge, len(sign)])
        name = mix(np.add.reduceat(mix(a.view(np.uint64)), edge) ^ sets.astype(np.uint64)).view(np.int64)
        once = np.zeros(len(edge), bool)
        once[np.unique(name, return_index=True)[1]] = True
        keep = np.repeat(once & (sets > 1), sets)
        sign, a = np.repeat(name, sets)[keep], a[keep]
    yield {"sign": sign, "a": a}


def _stars(percent: int):
    """Each group's best-connected node with every other node of a fitting size."""

    def step(cols: dict, edge: np.ndarray, size: np.ndarray) -> Iterator[dict]:
        group = np.repeat(np.arange(len(edge)), size)
        order = np.lexsort((cols["node"], -cols["degree"], group))
        lead, lead_n = (np.repeat(cols[c][order][edge], size) for c in ("node", "n"))
        node, n = cols["node"], cols["n"]
        keep = (node != lead) & (np.minimum(n, lead_n) * 100 >= np.maximum(n, lead_n) * percent)
        pairs = np.unique(np.stack([np.minimum(node, lead), np.maximum(node, lead)], 1)[keep], axis=0)
        yield {"u": pairs[:, 0], "v": pairs[:, 1]}

    return step


def _open(cols: dict, edge: np.ndarray, size: np.ndarray) -> Iterator[dict]:
    """Rows of groups that hold several components."""
    lowest, highest = (f.reduceat(cols["component"], edge) for f in (np.minimum, np.maximum))
    keep = np.repeat(lowest != highest, size)
    yield {c: cols[c][keep] for c in ("sign", "node", "component", "a")}


#: Groups up to this size are paired offset by offset over whole partitions, larger ones row by row.
PAIRED = 32


def _across(percent: int):
    """Pairs of a group in different components that sizes and sketches allow to link; a set is in a group once."""

    def step(cols: dict, edge: np.ndarray, size: np.ndarray) -> Iterator[dict]:
        node, part, many = (cols[c] for c in ("node", "component", "n"))
        whole = cols["sketch"]
        sketches = np.frombuffer(b"".join(map(folded, whole)), np.uint64).reshape(-1, SKETCH // 64)
        large = np.fromiter(map(len, whole), np.int64, len(whole)) > SKETCH // 8
        held, total = [], 0

        def fitting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Rows x and y (of equal length, or y one row) as the pairs that may link."""
            keep = (part[x] != part[y]) & (np.minimum(many[x], many[y]) * 100 >= np.maximum(many[x], many[y]) * percent)
            x, y = x[keep], np.broadcast_to(y, keep.shape)[keep]
            most = (100 - percent) * (many[x] + many[y]) // (100 + percent)
            keep = np.bitwise_count(sketches[x] ^ sketches[y]).sum(1) <= most
            for k in np.flatnonzero(keep & large[x] & large[y]):
                keep[k] = apart(whole[x[k]], whole[y[k]]) <= most[k]
            a, b = node[x[keep]], node[y[keep]]
            return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)

        end = np.repeat(edge + size, size)
        rows = np.flatnonzero(np.repeat(size <= PAIRED, size))
        for k in range(1, PAIRED):
            rows = rows[rows + k < end[rows]]
            for at in range(0, len(rows), 200_000):
                held.append(fitting(rows[at : at + 200_000], rows[at : at + 200_000] + k))
        for at, count in zip(edge[size > PAIRED], size[size > PAIRED], strict=True):
            value, where, common = np.unique(part[at : at + count], return_inverse=True, return_counts=True)
            inside = where == common.argmax()  # the largest component; its members need each other no more
            for i in np.flatnonzero(~inside):
                held.append(fitting(at + np.flatnonzero(inside | (np.arange(count) > i)), np.array([at + i])))
                total += len(held[-1])
            if total > 500_000:
                held, total = [np.unique(np.concatenate(held), axis=0)], 0
        if held:
            pairs = np.unique(np.concatenate(held), axis=0)
            yield {"u": pairs[:, 0], "v": pairs[:, 1]}

    return step


def _sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sizes and sketches allow to link, so that no texts travel for the others."""

    def step(batch: pa.RecordBatch) -> dict:
        most = (100 - percent) * (batch["u_n"].to_numpy() + batch["v_n"].to_numpy()) // (100 + percent)
        differ = [apart(x, y) for x, y in zip(batch["u_sketch"].to_pylist(), batch["v_sketch"].to_pylist(), strict=True)]
        keep = pa.array(np.array(differ, np.int64) <= most, pa.bool_())
        return {"u": batch["u"].filter(keep), "v": batch["v"].filter(keep)}

    known = sets.filter("n > 0").select("doc_id", "n", "sketch")
    for side in ("v", "u"):
        pairs = pairs.join(known.select(F.col("doc_id").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")), side)
    return frames.columns(pairs, "u long, v long", step).distinct()


def _taking_part(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose id may be in a pair, by a bitmap of hashed ids; a row too many costs its way through the shuffle, no more."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    bits = (
        pairs.select(F.explode(F.array("u", "v")).alias("doc_id"))
        .select(slot.alias("slot"))
        .groupBy(F.expr("slot div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(slot % 64)))").alias("bits"))
    )
    held = rows.withColumn("slot", slot).join(F.broadcast(bits), F.expr("slot div 64 = word and (bits & shiftleft(1L, int(slot % 64))) != 0"), "left_semi")
    return held.drop("slot")


def _verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The written pairs (u, v) whose sets link: both texts are brought together and counted exactly."""
    texts = frames.packed(_taking_part(rows, pairs))

    def step(batch: pa.RecordBatch) -> dict:
        keep, last = [], (None, None)
        for left, right in zip(frames.unpack(batch["left"]), frames.unpack(batch["right"]), strict=True):
            if last[0] != left:  # not by id: an id may have several texts
                last = (left, shingles_of(left, size))
            a, b = last[1], shingles_of(right, size)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        keep = pa.array(keep, pa.bool_())
        return {"u": batch["u"].filter(keep), "v": batch["v"].filter(keep)}

    right = texts.select(F.col("doc_id").alias("v"), F.col("packed").alias("right"))
    left = texts.select(F.col("doc_id").alias("u"), F.col("packed").alias("left"))
    return frames.columns(pairs.join(right, "v").join(left, "u").select("u", "v", "left", "right"), "u long, v long", step)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id (smallest id reachable by links) for each row.

    Two documents link when 100 * intersection >= ``percent`` * union of their
    sets.  A null, empty or wordless text has no shingles and links with
    nothing, so its component is itself; a text of fewer than ``size`` words is
    one shingle.  Rows that repeat an id are one node; a row without an id comes
    back with a null component; other columns are ignored.
    """
    rows = frames.documents(docs, id_col, text_col)
    signed = frames.written(signed_sets(rows, size, percent), "signed")
    # Half of a set's name tells sets apart here as well as a shingle's hash tells shingles apart; pairs are checked exactly.
    named = signed.filter("n > 0 and doc_id is not null").select("a", F.explode("signatures").alias("sign"))
    shared = frames.written(_grouped(named, "sign", "sign long, a long", _shared).distinct(), "shared")
    sets = frames.written(signed.drop("signatures"), "sets")
    frames.discard(signed)
    some = sets.filter("n > 0 and doc_id is not null")
    degree = shared.groupBy("a").agg(F.count("*").alias("degree"))
    # A set's node is the smallest id that has it; an id with several texts may be the node of several sets.
    nodes = some.groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"))
    nodes = frames.written(nodes.join(degree, "a", "left").select("a", "b", "node", "n", F.coalesce("degree", F.lit(0)).alias("degree")), "nodes")
    stars = shared.join(nodes, "a").select("sign", "node", "n", "degree")
    pairs = frames.written(_grouped(stars, "sign", "u long, v long", _stars(percent)).distinct(), "pairs")
    hopeful = frames.written(_sketched(pairs, some, percent), "hopeful")
    links = frames.written(_verified(hopeful, rows, size, percent), "linked")
    found = components(links).withColumnRenamed("node", "known")
    parts = nodes.join(found, nodes["node"] == found["known"], "left").select("a", "node", F.coalesce("component", "node").alias("component"))
    still = frames.written(_grouped(shared.join(parts, "a").select("sign", "node", "component", "a"), "sign", "sign long, node long, component long, a long", _open), "open")
    held = still.select("a", F.col("node").alias("doc_id")).distinct()
    sketches = some.select("a", "b", "doc_id", "n", "sketch").join(held, ["a", "doc_id"]).dropDuplicates(["a", "b"]).select("a", F.col("doc_id").alias("node"), "n", "sketch")
    rest = _grouped(still.join(sketches, ["a", "node"]).select("sign", "node", "component", "n", "sketch"), "sign", "u long, v long", _across(percent)).distinct().join(pairs, ["u", "v"], "left_anti")
    more = frames.written(_verified(frames.written(rest, "rest"), rows, size, percent), "linked")
    same = some.select("doc_id", "a", "b").join(nodes.select("a", "b", "node"), ["a", "b"]).filter("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    final = components(links.unionByName(more).unionByName(same))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
