"""Benchmark decontamination as a prefix-filtered set join, in DataFrame expressions only.

Benchmark items are cut into windows of ten words (an item of fewer words is one
window).  A document contains a window only if it has each of its words, so it
is enough to join on the window's rarest word: the prefix of an exact
containment is one token.  Rarity is counted over all documents.  Where a
document has such a token, its place in the window gives the only start
possible; starts outside the text are dropped (length and position), and the
words around the token are compared with the window.

Documents are read twice and never exploded into all their words with their
text: a table of token hashes, a literal of at most 1 MB, picks the places
worth joining inside the row.  The window table is broadcast only while it has
at most ``BROADCAST_WINDOWS`` rows; beyond that the same join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

WINDOW = 10
BROADCAST_WINDOWS = 100_000
#: Slots of the token filter: 16 a token, between these bounds.
FILTER_SLOTS = (1 << 16, 1 << 20)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: A-Z only: lower() does that for ASCII words, the slow translate() is for the others.
_FOLD = f"if(length(w) = octet_length(w), lower(w), translate(w, '{_UPPER}', '{_LOWER}'))"
_WORDS = f"array_remove(split(coalesce(cast({{0}} as string), ''), '{_GAP}'), '')"


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """words (of one window), items: each distinct window with the ids of the items that have it."""
    words = benchmark.select(F.col(id_col).alias("item_id"), F.expr(f"transform({_WORDS.format(f'`{text_col}`')}, w -> {_FOLD})").alias("ws"))
    cut = words.filter("size(ws) > 0").select("item_id", "ws", F.explode(F.expr(f"sequence(1, greatest(size(ws) - {window - 1}, 1))")).alias("at"))
    return cut.select("item_id", F.expr(f"slice(ws, at, {window})").alias("words")).groupBy("words").agg(F.collect_set("item_id").alias("items"))


def row_key(text: Column) -> Column:
    """64 bits naming a text, which tell rows of one id, or of none, apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def _token_filter(tokens: DataFrame, n: int) -> tuple[str, int]:
    """Hex of one byte a slot, 01 where some token falls, and the number of slots."""
    slots = FILTER_SLOTS[0]
    while slots < 16 * n and slots < FILTER_SLOTS[1]:
        slots *= 2
    table = bytearray(slots)
    for row in tokens.select(F.expr(f"cast(pmod(xxhash64(token), {slots}) as int)").alias("s")).distinct().toLocalIterator():
        table[row["s"]] = 1
    return table.hex(), slots


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated and row (``row_key`` of the text) for each row of ``docs``.

    Words are lower-cased (A-Z) and split at ASCII characters other than digits
    and letters.  Null or wordless texts have no words, windows or hits; an
    empty benchmark hits nothing; repeated rows and ids are judged row by row;
    items with equal windows all count; an item without an id counts in n_hit and
    is left out of item_ids; other columns are ignored.
    """
    windows = item_windows(benchmark, item_id_col, item_text_col, window)
    windows = frames.written(windows.select(F.xxhash64("words").alias("window"), "words", "items"), "windows")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(text_col)).alias("row"))
    vocabulary = windows.select(F.explode("words").alias("w")).distinct()
    n_vocabulary, n_windows = vocabulary.count(), windows.count()
    said = texts.select(F.explode(F.expr(_WORDS.format("text"))).alias("w")).select(F.expr(_FOLD).alias("w"))
    if n_vocabulary <= BROADCAST_WINDOWS:
        counts = said.join(F.broadcast(vocabulary), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    else:  # a task sends each word once, however common it is
        counts = said.groupBy("w").agg(F.count("*").alias("n")).join(vocabulary, "w", "left_semi")
    placed = windows.select("window", F.posexplode("words").alias("at", "w")).join(counts, "w", "left")
    rarest = placed.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "at")).alias("r"))
    prefix = frames.written(windows.join(rarest, "window").select("window", "words", "items", F.col("r.w").alias("token"), F.col("r.at").alias("at")), "prefix")
    table, slots = _token_filter(prefix, n_windows)

    rows = texts.withColumn("uid", F.monotonically_increasing_id()).withColumn("ws", F.expr(f"transform({_WORDS.format('text')}, w -> {_FOLD})"))
    member = f"substring(X'{table}', cast(pmod(xxhash64(x), {slots}) as int) + 1, 1) = X'01'"
    rows = rows.select("uid", "doc_id", "row", "ws", F.expr(f"filter(transform(ws, (x, i) -> if({member}, i, null)), i -> i is not null)").alias("places"))
    around = f"transform(places, i -> struct(i as i, get(ws, i) as token, greatest(i - {window - 1}, 0) as base, slice(ws, greatest(i - {window - 1}, 0) + 1, i - greatest(i - {window - 1}, 0) + {window}) as near))"
    rows = rows.select("uid", "doc_id", "row", F.expr("cast(size(ws) as long)").alias("n_words"), F.explode_outer(F.expr(around)).alias("p"))
    rows = rows.select("uid", "doc_id", "row", "n_words", F.col("p.i").alias("i"), F.col("p.token").alias("token"), F.col("p.base").alias("base"), F.col("p.near").alias("near"))
    right = _small(prefix.select(F.col("token").alias("t"), "at", "words", "window"), n_windows)
    bounds = F.expr("i - at >= 0 and i - at + size(words) <= n_words")
    same = F.expr("slice(near, greatest(i - at - base, 0) + 1, size(words)) = words")
    joined = rows.join(right, (F.col("token") == F.col("t")) & bounds & same, "left")
    hit = joined.groupBy("uid", "doc_id", "row", "n_words").agg(
        F.collect_set(F.expr("if(window is not null, struct(i - at as s, i - at + size(words) as e), null)")).alias("spans"),
        F.collect_set("window").alias("found"),
    )
    covered = "aggregate(array_sort(spans), struct(0 as e, 0L as n), (a, s) -> struct(greatest(a.e, s.e) as e, a.n + greatest(s.e - greatest(a.e, s.s), 0) as n), a -> a.n)"
    hit = frames.written(hit.select("uid", "doc_id", "row", "n_words", F.expr(covered).alias("n_hit"), "found"), "hits")
    items = hit.select("uid", F.explode("found").alias("window")).join(_small(windows.select("window", "items"), n_windows), "window")
    items = items.select("uid", F.explode("items").alias("item")).groupBy("uid").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
    out = hit.drop("found").join(items, "uid", "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"), "row")
