"""Quality as an ordinal grade: cumulative-link regression on hashed text.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector shared by all grades and
ordered thresholds t_1 < t_2 < ...  x are the hashed byte trigrams that a text
has, each once, over their number, and two shares of repetition.  The model is
fitted on a bounded sample of rated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .text import word_hashes

SLOTS = 1 << 13
#: Rated rows, at most, on which the model is fitted: those with the smallest hash of their id.
FIT_ROWS = 4000
#: Empty places added to each text, so a few odd trigrams don't decide on a short one.
PRIOR = 200


def features_of(text: bytes, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text, which is padded with a space on either side.

    The last two slots are the shares of words that repeat the word before them
    and of trigrams that the text has already had.
    """
    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.intp), np.zeros(0)
    x = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    seen = np.zeros(slots, bool)
    seen[np.minimum((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - slots.bit_length() + 1), slots - 3)] = True
    at = np.flatnonzero(seen)
    words = word_hashes(text)
    again = float((words[1:] == words[:-1]).sum()) / (len(words) + 1)
    value = np.full(len(at) + 2, 1.0 / (len(at) + PRIOR))
    value[-2:] = again, 1.0 - len(at) / (len(x) + PRIOR)
    return np.concatenate([at, [slots - 2, slots - 1]]), value


STEPS, RATE, RIDGE = 200, 0.15, 5e-3
#: Least scale of a feature; rarer trigrams weigh less.
LEAST_SCALE = 3e-4


@dataclass(frozen=True)
class OrdinalModel:
    grades: tuple[int, ...]  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than grades, ascending

    def line(self, text: bytes) -> float:
        at, value = features_of(text, len(self.weights))
        return float(self.weights[at] @ value)

    def tails(self, line: float) -> np.ndarray:
        """P(grade > k) for each grade but the last."""
        return 1 / (1 + np.exp(-np.clip(line - self.thresholds, -30, 30)))


def _sums(row: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the grades ``y``, summed, and its gradient in the weights and in the thresholds."""
    line = np.bincount(row, value * w[index], len(y))
    up = 1 / (1 + np.exp(-np.clip(line[:, None] - t[None, :], -30, 30)))
    # P(y) is the difference of neighbouring tails; its log's gradient in each tail's argument.
    tails = np.c_[np.ones(len(y)), up, np.zeros(len(y))]
    p = np.maximum(tails[np.arange(len(y)), y] - tails[np.arange(len(y)), y + 1], 1e-9)
    slope = up * (1 - up)
    d = np.zeros_like(up)
    for k in range(up.shape[1]):
        d[:, k] = np.where(y == k + 1, slope[:, k] / p, np.where(y == k, -slope[:, k] / p, 0.0))
    return float(np.log(p).sum()), np.bincount(index, value * d.sum(1)[row], len(w)), -d.sum(0)


def _whole(total: float, d_w: np.ndarray, d_t: np.ndarray, n: int, params: np.ndarray, slots: int) -> tuple[float, np.ndarray]:
    """Mean log-likelihood less the ridge and its gradient in ``params``, from sums over ``n`` rows."""
    w, g = params[:slots], params[slots:]
    d_gap = np.r_[d_t.sum(), np.exp(g[1:]) * np.cumsum(d_t[::-1])[::-1][1:]]
    return total / n - RIDGE * (w @ w) / 2, np.r_[d_w / n - RIDGE * w, d_gap / n]


def _thresholds(g: np.ndarray) -> np.ndarray:
    """Ascending thresholds of the first one and the logs of the gaps."""
    return g[0] + np.r_[0.0, np.cumsum(np.exp(g[1:]))]


def likelihood(row: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, params: np.ndarray, slots: int) -> tuple[float, np.ndarray]:
    """Mean log-likelihood of the grades ``y`` less the ridge, and its gradient.

    ``params``: weights, the first threshold and the logs of the gaps between
    thresholds, which keeps them ordered.
    """
    return _whole(*_sums(row, index, value, y, params[:slots], _thresholds(params[slots:])), len(y), params, slots)


#: Slots, about, that a step of the fit takes at a time.
BLOCK = 1 << 17


def fit(features: list[tuple[np.ndarray, np.ndarray]], ratings: np.ndarray, slots: int = SLOTS) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on the whole sample; grades are the ratings that occur, features those of ``features_of``."""
    kind = np.min_scalar_type(slots)
    index, value = (np.concatenate([x[i] if i else x[i].astype(kind) for x in features] or [np.zeros(0)]) for i in (0, 1))
    return _fit(index, value, np.array([len(x[0]) for x in features], int), ratings, slots)


def _fit(index: np.ndarray, value: np.ndarray, lengths: np.ndarray, ratings: np.ndarray, slots: int) -> OrdinalModel:
    """``fit`` on features one after another, ``lengths`` of them a row.

    They stay as they are, in small types: the sample is read in blocks of rows,
    and the features' scales divide the weights instead of the values.
    """
    grades, y = np.unique(ratings, return_inverse=True)
    if len(grades) < 2:
        return OrdinalModel(tuple(int(g) for g in grades) or (0,), np.zeros(slots), np.zeros(0))
    ends = np.r_[0, np.cumsum(lengths)]
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)), len(y)])

    def blocks():
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = slice(ends[a], ends[b])
            yield np.repeat(np.arange(b - a), lengths[a:b]), index[part].astype(np.intp), value[part], y[a:b]

    scale = np.sqrt(sum(np.bincount(i, v.astype(float) ** 2, slots) for _, i, v, _ in blocks()) / len(y)) + LEAST_SCALE
    share = np.array([(y > k).mean() for k in range(len(grades) - 1)])
    theta = -np.log(share / (1 - share))  # thresholds at w = 0
    gaps = np.r_[theta[0], np.log(np.maximum(np.diff(theta), 1e-3))]
    params = np.concatenate([np.zeros(slots), gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, t = params[:slots] / scale, _thresholds(params[slots:])
        total, d_w, d_t = 0.0, np.zeros(slots), np.zeros(len(t))
        for block in blocks():
            some = _sums(*block, w, t)
            total, d_w, d_t = total + some[0], d_w + some[1], d_t + some[2]
        grad = _whole(total, d_w / scale, d_t, len(y), params, slots)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) / np.sqrt(step)
    return OrdinalModel(tuple(int(x) for x in grades), params[:slots] / scale, _thresholds(params[slots:]))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", rating_col: str = "quality", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """A model of the rated documents, fitted on at most ``fit_rows`` of them: those with the smallest hash of their id.

    Null ratings teach nothing, of two ratings of an id the lower counts; null
    and empty texts are two spaces; without ratings or documents the model has
    one grade, 0.  Features are taken in tasks, so the driver gets a bounded
    number of slots a document and no texts.
    """
    rated = ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(rating_col).cast("int").alias("rating")).filter("rating is not null and doc_id is not null")
    rated = rated.groupBy("doc_id").agg(F.min("rating").alias("rating")).orderBy(F.xxhash64("doc_id")).limit(fit_rows)

    def step(batch: pa.RecordBatch) -> dict:
        found = [features_of(x) for x in frames.blobs(batch["data"])]
        ends = pa.array(np.cumsum([0, *(len(x[0]) for x in found)]), pa.int32())
        index, value = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        return {"doc_id": batch["doc_id"], "rating": batch["rating"], "at": pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int16))), "value": pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))}

    sample = frames.with_texts(frames.documents(docs, id_col, text_col), rated).select("doc_id", "rating", "data")
    sample = frames.columns(sample, "doc_id long, rating int, at array<short>, value array<float>", step).toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("rating", "ascending")]).combine_chunks()
    at, value = (pa.concat_arrays(sample[c].chunks) if sample.num_rows else pa.array([], sample[c].type) for c in ("at", "value"))
    lengths = at.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    model = _fit(at.flatten().to_numpy(), value.flatten().to_numpy(), lengths, sample["rating"].to_numpy(), SLOTS)
    del sample, at, value
    frames.hand_back()
    return model


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: int | None = None, tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of ``least`` or more) and selected (that is ``tail`` or more).

    ``least`` is the second-lowest grade unless given.  A null or empty text is
    graded as two spaces; a model of one grade gives that grade, selected;
    repeated rows are graded each; other columns are ignored; an empty table
    gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    grades = np.array(model.grades, float)
    cut = int(np.searchsorted(model.grades, least)) - 1 if least is not None else 0

    def step(batch: pa.RecordBatch) -> dict:
        tails = [held.value.tails(held.value.line(x)) for x in frames.blobs(batch["data"])]
        expected = np.array([grades[0] + (np.diff(grades) * t).sum() for t in tails])
        upper = np.array([t[cut] if 0 <= cut < len(t) else float(cut < 0 or not len(t)) for t in tails])
        return {"doc_id": batch["doc_id"], "row": batch["row"], "expected_grade": expected, "tail_probability": upper, "selected": upper >= tail}

    return frames.columns(frames.documents(docs, id_col, text_col), "doc_id long, row int, expected_grade double, tail_probability double, selected boolean", step)


def select(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: int | None = None, tail: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``grade`` would select, with all their columns, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    cut = int(np.searchsorted(model.grades, least)) - 1 if least is not None else 0

    def run(batches):
        for batch in batches:
            keep = []
            for text in batch[text_col].to_pylist():
                t = held.value.tails(held.value.line((text or "").encode()))
                keep.append(bool((t[cut] if 0 <= cut < len(t) else float(cut < 0 or not len(t))) >= tail))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return frames.mapped(docs, run, docs.schema)
