"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary, each a proper distribution over the words
that may follow a word (an end mark and unknown words included):

    P_c(w | v) = e_c(v,w) / N_c(v) + l_c(v) * (s(v,w) + b(v) * P_c(w))
    P_c(w)     = e_c(w) / N_c + l_c * P(w)
    P(w)       = (contexts of w - D) / contexts of all words

``e_c`` is a class count less its discount; ``l_c`` is the mass that the discounts
freed, so it follows the number and the counts of the continuations.  The
discount follows the shared count (both classes together): what that lets one
expect in the class, and Z standard deviations of it, so only expressions that
depart from the shared counts by more than chance keep a class count of their
own.  All others back off: pairs to the shared counts of departing pairs,
``s`` (less D each; ``b`` is what that frees), then to words, and words to the
continuation counts that both classes share, how many different words come
before a word.  Where both models back off, they agree but for constants, so the
tables hold departing words and pairs, with their contexts, and nothing else is
needed to score exactly.

The score compares the two log-likelihoods, normalised by length: a logistic
curve of their difference per word (and per square root of words) is fitted on
labelled rows that the counts have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .text import mix, word_hashes

#: Standard deviations in the discount of words and of pairs, and the discount of shared counts.
Z_WORD, Z_PAIR, SHARED = 8.0, 12.0, 0.5
#: Expressions with class evidence that are broadcast, the commonest first (4 MB); texts are joined with the others.
EXPRESSIONS = 1 << 18
#: Bits that tell which expressions may be among the others (8 MB); they steer cost, never results.
SLOTS = 1 << 26
#: Labelled rows, at most, on which the curve is fitted.
CURVE_ROWS = 20_000
#: Word pairs counted together in one task.
COUNTED = 1 << 21
#: What comes before the first word and after the last.
START, END = np.uint64(1), np.uint64(2)
_CONTEXT = np.uint64(0x5851F42D4C957F2D)


def sequence(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of the one before it; an end mark is the last word, a start mark comes first."""
    words = word_hashes(text, fold=True, marks=True)
    return np.r_[START, words], np.r_[words, END]


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + word)


def context_key(before: np.ndarray) -> np.ndarray:
    return mix(before ^ _CONTEXT)


def gram_counts(labelled: DataFrame, least: float = Z_PAIR) -> DataFrame:
    """before, word, toxic, ordinary, contexts: how often each class has each word (before is null) and each pair, over all rows (data, toxic).

    contexts is the number of different words before a word.  Pairs that no
    class has more than ``least`` times are left out; words never are.
    """

    def count(held: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        before, word = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        toxic = np.repeat([x[2] for x in held], [len(x[0]) for x in held])
        key = pair_key(before, word)
        order = np.argsort(key)
        edge = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        n, of_toxic = np.diff(np.r_[edge, len(key)]), np.add.reduceat(toxic[order].astype(np.int64), edge)
        first = order[edge]
        return pa.RecordBatch.from_pydict({"before": before[first].view(np.int64), "word": word[first].view(np.int64), "toxic": of_toxic, "ordinary": n - of_toxic})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for text, toxic in zip(frames.blobs(batch["data"]), batch["toxic"].to_pylist(), strict=True):
                before, word = sequence(text)
                held.append((before, word, toxic))
                total += len(word)
                if total >= COUNTED:
                    yield count(held)
                    held, total = [], 0
        if held:
            yield count(held)

    pairs = frames.mapped(labelled.select("data", "toxic"), run, "before long, word long, toxic long, ordinary long")
    pairs = pairs.groupBy("before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    word = "struct(cast(null as bigint) as before, word, toxic, ordinary)"
    rows = pairs.select(F.explode(F.expr(f"if(greatest(toxic, ordinary) > {least}D, array({word}, struct(before, word, toxic, ordinary)), array({word}))")).alias("x")).select("x.*")
    return rows.groupBy("before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("*").alias("contexts"))


def evidence(grams: DataFrame, z_word: float = Z_WORD, z_pair: float = Z_PAIR) -> tuple[DataFrame, float]:
    """gram, n and ratio of everything that keeps class evidence, and the log-ratio of a word without any.

    ratio is the toxic less the ordinary log-probability, less that constant: of
    a word by itself (gram: its hash), of a pair (``pair_key``), and of backing
    off after a word (``context_key``), to be added to the word's own.
    """
    words = grams.filter("before is null")
    total = words.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.sum("contexts").alias("contexts")).first()
    size = {c: float(total[c] or 0) for c in ("toxic", "ordinary")}
    if not all(size.values()):
        return grams.select(F.col("word").alias("gram"), F.col("toxic").alias("n"), F.lit(0.0).alias("ratio")).filter("false"), 0.0

    def excess(name: str, z: float):
        expected = (F.col("toxic") + F.col("ordinary")) * F.lit(size[name] / sum(size.values()))
        return F.greatest(F.col(name) - expected - F.lit(z) * F.sqrt(expected + 1.0), F.lit(0.0))

    words = words.select("word", "toxic", "ordinary", "contexts", excess("toxic", z_word).alias("e_t"), excess("ordinary", z_word).alias("e_o"))
    kept = words.agg(F.sum("e_t").alias("t"), F.sum("e_o").alias("o")).first()
    free_t, free_o = 1.0 - kept["t"] / size["toxic"], 1.0 - kept["o"] / size["ordinary"]
    base = float(np.log(free_t / free_o))
    shared = (F.col("contexts") - F.lit(SHARED)) / F.lit(float(total["contexts"]))
    words = words.select("word", "toxic", "ordinary", (F.col("e_t") / size["toxic"] + shared * free_t).alias("p_t"), (F.col("e_o") / size["ordinary"] + shared * free_o).alias("p_o"), (F.greatest("e_t", "e_o") > 0).alias("departs"))

    pairs = grams.filter("before is not null").select("before", "word", (F.col("toxic") + F.col("ordinary")).alias("n"), excess("toxic", z_pair).alias("e_t"), excess("ordinary", z_pair).alias("e_o")).filter("e_t > 0 or e_o > 0")
    # As often as a word comes, something follows it; the start mark comes as often as the end mark.
    said = words.select(F.when(F.col("word") == int(END), F.lit(int(START))).otherwise(F.col("word")).alias("before"), F.col("toxic").alias("n_t"), F.col("ordinary").alias("n_o"))
    free = pairs.groupBy("before").agg(F.sum("e_t").alias("s_t"), F.sum("e_o").alias("s_o"), F.sum(F.col("n") - SHARED).alias("s")).join(said, "before")
    left_of = lambda s, n: F.when(F.col(n) > 0, 1.0 - F.col(s) / F.col(n)).otherwise(1.0)
    free = free.select("before", "n_t", "n_o", left_of("s_t", "n_t").alias("l_t"), left_of("s_o", "n_o").alias("l_o"), (1.0 - F.col("s") / (F.col("n_t") + F.col("n_o"))).alias("b"))
    pairs = pairs.join(free, "before").join(words.select("word", "p_t", "p_o"), "word")
    both = (F.col("n") - SHARED) / (F.col("n_t") + F.col("n_o"))

    def chance(c: str):
        return F.when(F.col(f"n_{c}") > 0, F.col(f"e_{c}") / F.col(f"n_{c}")).otherwise(0.0) + F.col(f"l_{c}") * (both + F.col("b") * F.col(f"p_{c}"))

    rows = words.filter("departs").select(F.lit(None).cast("long").alias("before"), "word", (F.col("toxic") + F.col("ordinary")).alias("n"), (F.log("p_t") - F.log("p_o") - base).alias("ratio"))
    rows = rows.unionByName(free.select("before", F.lit(None).cast("long").alias("word"), (F.col("n_t") + F.col("n_o")).alias("n"), (F.log("l_t") - F.log("l_o")).alias("ratio")))
    rows = rows.unionByName(pairs.select("before", "word", "n", (F.log(chance("t")) - F.log(chance("o")) - base).alias("ratio")))

    def named(batch: pa.RecordBatch) -> dict:
        has = {c: batch[c].is_valid().to_numpy(zero_copy_only=False) for c in ("before", "word")}
        before, word = (batch[c].fill_null(0).to_numpy().view(np.uint64) for c in ("before", "word"))
        gram = np.where(has["before"] & has["word"], pair_key(before, word), np.where(has["word"], word, context_key(before)))
        return {"gram": gram.view(np.int64), "n": batch["n"], "ratio": batch["ratio"]}

    return frames.columns(rows, "gram long, n long, ratio double", named), base


def split_evidence(kept: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame | None, np.ndarray | None]:
    """The EXPRESSIONS commonest of ``kept`` as sorted grams and ratios, the others as a table (None: no others), and their slots in a table of SLOTS bits."""
    top = kept.orderBy(F.desc("n"), "gram").limit(EXPRESSIONS).toPandas()
    gram, ratio = top["gram"].to_numpy(np.int64).view(np.uint64), top["ratio"].to_numpy(float)
    order = np.argsort(gram)
    if kept.count() <= EXPRESSIONS:
        return gram[order], ratio[order], None, None
    last = top.iloc[-1]
    n, at = int(last["n"]), int(last["gram"])
    rest = kept.filter((F.col("n") < n) | ((F.col("n") == n) & (F.col("gram") > at)))
    slot = F.col("gram").bitwiseAND(F.lit(SLOTS - 1))
    bits = rest.select(F.shiftright(slot, 5).alias("word"), F.expr(f"shiftleft(1L, cast((gram & {SLOTS - 1}L) % 32 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    slots = np.zeros(SLOTS // 32, np.uint32)
    slots[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return gram[order], ratio[order], rest, slots


def difference(text: bytes, gram: np.ndarray, ratio: np.ndarray, slots: np.ndarray | None = None) -> tuple:
    """Toxic less ordinary log-likelihood of a text beyond the constant of each word, its words (and end mark), and what ``slots`` leaves open.

    That is pairs, contexts and words, how often, and what the last two give if they are not found.
    """
    before, word = sequence(text)
    pair, context = pair_key(before, word), context_key(before)

    def found(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(gram):
            return np.zeros(len(x), bool), np.zeros(len(x))
        at = np.minimum(np.searchsorted(gram, x), len(gram) - 1)
        return gram[at] == x, np.where(gram[at] == x, ratio[at], 0.0)

    def may(x: np.ndarray) -> np.ndarray:
        at = x & np.uint64(SLOTS - 1)
        return (slots[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1

    by_pair, by_context, by_word = found(pair), found(context), found(word)
    value = np.where(by_pair[0], by_pair[1], by_context[1] + by_word[1])
    if slots is None:
        return float(value.sum()), len(word)
    still = ~by_pair[0] & (may(pair) | (~by_context[0] & may(context)) | (~by_word[0] & may(word)))
    pairs, first, times = np.unique(pair[still], return_index=True, return_counts=True)
    return float(value[~still].sum()), len(word), pairs, *(x[still][first] for x in (context, word)), times, *(x[still][first] for x in (by_context[1], by_word[1]))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (per word, per root of words, constant) of a ridge logistic fit; the first two are not negative."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    weights = np.array([0.0, 0.0, np.log(rate / (1 - rate))])
    if not len(y) or y.min() == y.max():
        return weights
    scale = np.sqrt((x**2).mean(0)) + 1e-9
    design = np.c_[x / scale, np.ones(len(x))]
    free = np.array([True, True, True])
    for _ in range(3):
        w = np.where(free, weights, 0.0)
        w[:2] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (p - y) + 1e-2 * w
            hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(3)
            step = np.zeros(3)
            step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            w -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        if (w[:2] >= 0).all():
            break
        free[:2] &= w[:2] > 0
    return np.r_[np.maximum(w[:2], 0) / scale, w[2]]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, z_word: float = Z_WORD, z_pair: float = Z_PAIR) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, log_ratio and n_words for each document.

    Labels are learnt only from rows whose crc32(id as text) mod ``folds`` is not
    0; the last fold fits the curve (on CURVE_ROWS rows at most), the others are
    counted, all of them.  An id labelled twice counts as toxic if either label
    is; a null label teaches nothing.  Null and empty texts get the score of a
    document without evidence; without labels of both classes every score is
    the same; an empty table gives no rows.  log_ratio is the toxic less the
    ordinary log-likelihood, n_words the words and the end mark.  Repeated rows are scored each; other columns are ignored.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    rows = frames.documents(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic")).filter("toxic is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("fold", fold)
    counts = frames.written(gram_counts(frames.with_texts(rows, known.filter((F.col("fold") > 0) & (F.col("fold") < folds - 1)).drop("fold")), z_pair), "grams")
    kept, base = evidence(counts, z_word, z_pair)
    gram, ratio, rest, slots = split_evidence(frames.written(kept, "evidence"))
    held = docs.sparkSession.sparkContext.broadcast((gram, ratio, slots))

    def measure(batch: pa.RecordBatch) -> dict:
        got = [difference(x, *held.value) for x in frames.blobs(batch["data"])]
        out = {"log_ratio": np.array([x[0] for x in got]), "n_words": np.array([x[1] for x in got], np.int64)}
        if held.value[2] is not None:
            ends = pa.array(np.cumsum([0, *(len(x[2]) for x in got)]), pa.int32())
            for i, (name, kind) in enumerate((("pair", np.int64), ("context", np.int64), ("word", np.int64), ("times", np.int64), ("of_context", float), ("of_word", float)), 2):
                flat = np.concatenate([x[i] for x in got])
                out[name] = pa.ListArray.from_arrays(ends, pa.array(flat.view(kind) if flat.dtype == np.uint64 else flat.astype(kind)))
        return {c: batch[c] for c in batch.schema.names if c != "data"} | out

    def measured(some: DataFrame, schema: str) -> DataFrame:
        """log_ratio and n_words beside the columns of ``some`` (``schema``): expressions that were not broadcast are joined."""
        if rest is None:
            return frames.columns(some, f"{schema}, log_ratio double, n_words long", measure)
        lists = "pair array<long>, context array<long>, word array<long>, times array<long>, of_context array<double>, of_word array<double>"
        part = frames.columns(some.withColumn("uid", F.monotonically_increasing_id()), f"{schema}, uid long, log_ratio double, n_words long, {lists}", measure)
        part = frames.written(part, "measured")
        names = ("pair", "context", "word", "times", "of_context", "of_word")
        still = part.select("uid", F.explode(F.arrays_zip(*names)).alias("x")).select("uid", "x.*")
        for name in ("pair", "context", "word"):
            still = still.join(rest.select(F.col("gram").alias(name), F.col("ratio").alias(f"by_{name}")), name, "left")
        more = still.groupBy("uid").agg(F.sum(F.col("times") * F.coalesce("by_pair", F.coalesce("by_context", "of_context") + F.coalesce("by_word", "of_word"))).alias("more"))
        out = part.drop(*names).join(more, "uid", "left")
        return out.withColumn("log_ratio", F.col("log_ratio") + F.coalesce("more", F.lit(0.0))).drop("uid", "more")

    curve_labels = known.filter(F.col("fold") == folds - 1).orderBy(F.xxhash64("doc_id")).limit(CURVE_ROWS).select("doc_id", "toxic")
    sample = measured(frames.with_texts(rows, curve_labels).select("doc_id", "toxic", "data"), "doc_id long, toxic int").toPandas().sort_values("doc_id")
    n = np.maximum(sample["n_words"].to_numpy(float), 1.0)
    d = sample["log_ratio"].to_numpy(float) + base * n
    per_word, per_root, constant = (float(x) for x in fit_curve(np.c_[d / n, d / np.sqrt(n)], sample["toxic"].to_numpy(float)))
    scored = measured(rows.select("doc_id", "data"), "doc_id long").withColumn("log_ratio", F.col("log_ratio") + F.col("n_words") * F.lit(base))
    length = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    line = F.col("log_ratio") / length * per_word + F.col("log_ratio") / F.sqrt(length) * per_root + constant
    scored = scored.withColumn("score", 1.0 / (1.0 + F.exp(-line))).withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "log_ratio", "n_words")
