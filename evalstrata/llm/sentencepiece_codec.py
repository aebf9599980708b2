"""SentencePiece encoding and decoding with shared-prefix forward states.

A text is marked (a space becomes U+2581, one goes in front) and cut where no
piece of the vocabulary reaches across: before each run of marks, and before
newlines.  The distinct marked words of a part of the input are sorted, which
makes them a trie; a depth-first walk keeps one forward state for each prefix,
so words reuse the states of the prefix they share with their neighbour.  The
pieces that end at a prefix come from an Aho-Corasick automaton, whose state is
part of the forward state.

The rest of the forward state follows the kind of model.  For a unigram model it
is the Viterbi score of the prefix and the last piece of its best segmentation.
A best-sum Viterbi does not give the ids of a merge-based (BPE) model, but
another recurrence with the same shape does: the encoding of every prefix ends
in exactly one piece, the one that is compatible with the last piece of the
prefix before it.  Two pieces are compatible if no merge across their border
comes before the merges that build them.  Ids equal those of the SentencePiece
library.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

MARK = "▁"
#: Text whose distinct words are sorted together, in characters; a longer text is cut between words.
PART = 1 << 21
#: What a worker remembers from one part to the next: words with their ids, compatible pairs, automaton steps.
CACHE_WORDS, CACHE_PAIRS, CACHE_STEPS = 100_000, 250_000, 250_000
#: Types of pieces and models, and fields, of a serialized model.
NORMAL, UNKNOWN, USER_DEFINED, BYTE, UNIGRAM, BPE = 1, 2, 4, 6, 1, 2

_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}][^{MARK}\n]*")
_BORDER = re.compile(f"\n|(?<!{MARK}){MARK}")
_NEVER = float("inf")


def merge_runs(word: str, ranks: dict[str, float], stop: str = "") -> list[str]:
    """Pieces of a word by the merges themselves, lowest rank first, then leftmost; short of the last merge if that gives ``stop``.

    Equal neighbours are kept as one run and merged at once where no merge that
    this makes possible comes earlier, so 10**6 spaces take a few steps.
    """
    sym, many, start, after, before, heap = [], [], [], [], [], []
    for i, c in enumerate(word):
        if sym and sym[-1] == c:
            many[-1] += 1
        else:
            sym.append(c)
            many.append(1)
            start.append(i)
    after = [*range(1, len(sym)), -1]
    before = [*range(-1, len(sym) - 1)]
    version = [0] * len(sym)
    total = len(word)

    def offer(i: int) -> None:
        """The merge inside run ``i`` and the one across its right border."""
        if many[i] > 1 and (rank := ranks.get(sym[i] * 2)) is not None:
            heapq.heappush(heap, (rank, start[i], i, -1, version[i], 0))
        j = after[i]
        if j >= 0 and (rank := ranks.get(sym[i] + sym[j])) is not None:
            heapq.heappush(heap, (rank, start[i] + (many[i] - 1) * len(sym[i]), i, j, version[i], version[j]))

    def insert(i: int, j: int, s: str, n: int, at: int) -> int:
        """A new run between the runs ``i`` and ``j``."""
        new = len(sym)
        for column, x in zip((sym, many, start, before, after, version), (s, n, at, i, j, 0), strict=True):
            column.append(x)
        if i >= 0:
            after[i] = new
        if j >= 0:
            before[j] = new
        return new

    def shrink(i: int, n: int, at: int) -> int:
        """Run ``i`` with ``n`` members from ``at`` on; -1 if none are left."""
        version[i] += 1
        many[i], start[i] = n, at
        if n:
            return i
        if before[i] >= 0:
            after[before[i]] = after[i]
        if after[i] >= 0:
            before[after[i]] = before[i]
        return -1

    for i in range(len(sym)):
        offer(i)
    while heap and not (stop and total == 2):
        rank, _, i, j, seen, seen_next = heapq.heappop(heap)
        if version[i] != seen or not many[i] or (j >= 0 and (version[j] != seen_next or after[i] != j)):
            continue
        s, n, at = sym[i], many[i], start[i]
        left, right = before[i], after[i]
        if j >= 0:
            width = len(sym[j])
            made = insert(i, j, s + sym[j], 1, at + (n - 1) * len(s))
            shrink(i, n - 1, at)
            shrink(j, many[j] - 1, start[j] + width)
            total -= 1
        else:
            new = [s * 3, s * 4] + ([sym[left] + s * 2] if left >= 0 else []) + ([s * 2 + sym[right]] if right >= 0 else [])
            twos = 1 if any(ranks.get(x, _NEVER) < rank for x in new) else n // 2
            made = insert(left, i, s * 2, twos, at)
            shrink(i, n - 2 * twos, at + 2 * twos * len(s))
            total -= twos
        for k in (before[before[made]] if before[made] >= 0 else -1, before[made], made, after[made]):
            if k >= 0:
                offer(k)
    out, i = [], next((i for i in range(len(sym)) if many[i] and before[i] < 0), -1)
    while i >= 0:
        out += [sym[i]] * many[i]
        i = after[i]
    return out


class Vocabulary:
    """Pieces with ids and scores (BPE: merges of a higher score come first); what cannot be matched is written as bytes.

    What workers derive (the automaton, remembered pairs and words) is not
    shipped with it.
    """

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], bytes_: list[int], kind: int):
        self.kind, self.bytes_ = kind, bytes_
        self.texts = list(pieces)
        self.ids = [pieces[p] for p in self.texts]
        self.scores = [scores[p] for p in self.texts]
        self.left = self.right = None
        self.odd: set[int] = set()  # pieces that merges never build, or not in rising order
        if kind == BPE:
            self.texts += sorted({c for p in self.texts for c in p}.difference(self.texts))  # merged, but no pieces by themselves
            self._split()

    def _split(self) -> None:
        ranks, place = self.ranks(), {p: k for k, p in enumerate(self.texts)}
        self.left, self.right = array("i", [-1]) * len(self.texts), array("i", [-1]) * len(self.texts)
        for k, p in enumerate(self.texts):
            if len(p) > 1:
                parts = merge_runs(p, ranks, p)
                if len(parts) == 2:
                    self.left[k], self.right[k] = place[parts[0]], place[parts[1]]
                else:
                    self.odd.add(k)
        for k in range(len(self.ids)):
            for side in (self.left, self.right):
                at = k
                while side[at] >= 0:
                    if len(self.texts[side[at]]) > 1 and self.scores[side[at]] <= self.scores[at]:
                        self.odd.add(k)
                    at = side[at]

    def ranks(self) -> dict[str, float]:
        return {p: -s for p, s in zip(self.texts, self.scores, strict=False)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("encoder", "spelled")}

    def worker(self) -> Encoder:
        """The encoder of this process, made once."""
        if "encoder" not in self.__dict__:
            self.encoder = Encoder(self)
        return self.encoder

    def spelling(self) -> list[bytes]:
        """The bytes that each id stands for, marks as spaces."""
        if "spelled" not in self.__dict__:
            self.spelled = [b""] * (1 + max([*self.ids, *self.bytes_], default=-1))
            for p, i in zip(self.texts, self.ids, strict=False):
                self.spelled[i] = p.replace(MARK, " ").encode("utf-8", "surrogatepass")
            for b, i in enumerate(self.bytes_):
                self.spelled[i] = bytes([b])
        return self.spelled


class Encoder:
    """Depth-first encoding of sorted words; remembers pairs, automaton steps and words up to fixed numbers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.ranks = vocabulary, vocabulary.ranks() if vocabulary.kind == BPE else {}
        self.sizes = [len(p) for p in vocabulary.texts]
        self.step: list[dict[str, int]] = [{}]
        self.fail, self.ends_here = [0], [()]
        self.steps, self.words = 0, {}
        self.known: list[dict[int, bool]] = [{} for _ in vocabulary.ids]  # of each piece: whether it may follow another
        self.forget_pairs()
        self.single = {p: k for k, p in enumerate(vocabulary.texts) if k >= len(vocabulary.ids)}
        for k, p in enumerate(vocabulary.texts[: len(vocabulary.ids)]):
            if k not in vocabulary.odd:
                at = 0
                for c in p:
                    to = self.step[at].get(c)
                    if to is None:
                        to = self.step[at][c] = len(self.step)
                        self.step.append({})
                        self.fail.append(0)
                        self.ends_here.append(())
                    at = to
                self.ends_here[at] = ((len(p), k, self.known[k]),)
        todo = list(self.step[0].values())
        for at in todo:  # breadth first: shorter states are done before longer ones
            self.ends_here[at] += self.ends_here[self.fail[at]]
            for c, to in self.step[at].items():
                if to not in (0, at):
                    back = self.fail[at]
                    while back and c not in self.step[back]:
                        back = self.fail[back]
                    self.fail[to] = self.step[back].get(c, 0)
            todo += self.step[at].values()
        least = min(vocabulary.scores, default=0.0) if vocabulary.kind == UNIGRAM else 0.0
        self.unknown = np.float32(least) - np.float32(10)
        self.scores = [np.float32(s) for s in vocabulary.scores]

    def follow(self, at: int, c: str) -> int:
        """The automaton's next state where the trie has no direct step."""
        back = at
        while back and c not in self.step[back]:
            back = self.fail[back]
        to = self.step[back].get(c, 0)
        if self.steps < CACHE_STEPS:
            self.steps += 1
            self.step[at][c] = to
        return to

    def compatible(self, first: int, second: int) -> bool:
        texts, ranks, scores, left, right = self.v.texts, self.ranks, self.v.scores, self.v.left, self.v.right
        a, a_used = first, _NEVER
        while True:
            b, b_used, text = second, _NEVER, texts[a]
            while True:
                rank = ranks.get(text + texts[b])
                if rank is not None and rank < a_used and rank <= b_used:
                    return False
                if left[b] < 0:
                    break
                b, b_used = left[b], -scores[b]
            if right[a] < 0:
                return True
            a, a_used = right[a], -scores[a]

    def spell(self, word: str, pieces: list[int]) -> bytes:
        """Ids as bytes (32 bits each) of pieces from the last to the first; a character without one is written as bytes."""
        out, ids, i = [], self.v.ids, len(word)
        for k in pieces:
            if 0 <= k < len(ids):
                out.append(ids[k])
                i -= self.sizes[k]
            else:
                i -= 1
                out += [self.v.bytes_[b] for b in reversed(word[i].encode("utf-8", "surrogatepass"))]
        out.reverse()
        return array("i", out).tobytes()

    def merged(self, word: str) -> bytes:
        place = self.place = self.__dict__.get("place") or dict(zip(self.v.texts, self.v.ids, strict=False))
        out = array("i")
        for p in merge_runs(word, self.ranks):
            known = place.get(p)
            out.extend([known] if known is not None else [self.v.bytes_[b] for b in p.encode("utf-8", "surrogatepass")])
        return out.tobytes()

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """Ids of each word of a sorted list, by the depth-first walk of their trie."""
        return [self.merged(w) if self.v.kind == BPE and w.startswith(MARK * 2) else p for w, p in zip(words, self._walk(words), strict=True)]

    def _walk(self, words: list[str]) -> Iterator[bytes]:
        sizes, unigram = self.sizes, self.v.kind == UNIGRAM
        last, state, score = [-2], [0], [np.float32(0)]  # of each prefix of the word before
        before = ""
        for word in words:
            if not unigram and word.startswith(MARK * 2):  # runs of marks tie in merge order
                yield b""
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], state[shared + 1 :]
            if unigram:
                del score[shared + 1 :]
                self._score(word[shared:], last, state, score)
            else:
                self._fit(word[shared:], last, state)
            before, pieces, i = word, [], len(word)
            while i > 0:
                k = last[i]
                pieces.append(k)
                i -= sizes[k] if k >= 0 else 1
            yield self.spell(word, pieces)

    def _fit(self, tail: str, last: list[int], state: list[int]) -> None:
        """Appends the last compatible piece and the automaton's state of each longer prefix."""
        step, here, at = self.step, self.ends_here, state[-1]
        for c in tail:
            to = step[at].get(c)
            at = self.follow(at, c) if to is None else to
            for size, piece, known in here[at]:
                ahead = last[-size]
                fits = known.get(ahead)
                if fits is None:
                    self.pairs += 1
                    if self.pairs > CACHE_PAIRS:
                        self.forget_pairs()
                    fits = known[ahead] = self.compatible(ahead, piece)
                if fits:
                    break
            else:
                piece = self.single.get(c, -1)
            last.append(piece)
            state.append(at)

    def _score(self, tail: str, last: list[int], state: list[int], score: list) -> None:
        """Appends the last piece of the best segmentation, its score and the automaton's state of each longer prefix."""
        at = state[-1]
        for c in tail:
            to = self.step[at].get(c)
            at = self.follow(at, c) if to is None else to
            best, found, single = None, -1, False
            for size, piece, _ in self.ends_here[at]:  # the longest first; of equal scores it stays
                single |= size == 1
                s = score[-size] + self.scores[piece]
                if best is None or s > best:
                    best, found = s, piece
            if not single and (best is None or score[-1] + self.unknown > best):
                best, found = score[-1] + self.unknown, -1
            score.append(best)
            last.append(found)
            state.append(at)

    def forget_pairs(self) -> None:
        self.pairs = 0
        for known in self.known:
            known.clear()
            known.update({-1: True, -2: True})  # after nothing, or a character without a piece

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words in any order."""
        new = sorted(w for w in words if w not in self.words)
        fresh = dict(zip(new, self.encode_sorted(new), strict=True))
        out = [fresh[w] if w in fresh else self.words[w] for w in words]
        if len(self.words) + len(fresh) > 2 * CACHE_WORDS:
            self.words.clear()
        for w in new[: max(0, CACHE_WORDS - len(self.words))]:
            if len(w) < 64:
                self.words[w] = fresh[w]
        return out


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


def load(model_file: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model (BPE or unigram) with byte fallback, read once on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    trainer = dict(_fields(dict(_fields(model.serialized_model_proto())).get(2, b"")))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE) or not trainer.get(35):
        raise ValueError("a BPE or unigram model with byte fallback is needed")
    ids, scores, bytes_ = {}, {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if MARK in piece.lstrip(MARK) or "\n" in piece[1:]:
                raise ValueError(f"piece {piece!r} reaches across words")
            ids[piece], scores[piece] = i, model.get_score(i)
    return Vocabulary(ids, scores, bytes_, kind)


def marked_parts(text: str) -> Iterator[str]:
    """The marked text, cut between words into parts of about PART characters."""
    if not text:
        return
    marked = MARK + text.replace(" ", MARK)
    at = 0
    while len(marked) - at > PART:
        border = _BORDER.search(marked, at + PART)
        if not border:
            break
        yield marked[at : border.start()]
        at = border.start()
    yield marked[at:] if at else marked


def units(text: str) -> list[str]:
    """The marked words of a text, in order.  A unit without a mark follows a newline, which it starts with."""
    return [w for part in marked_parts(text) for w in _UNITS.findall(part)]


def encode_parts(parts: list[str], encoder: Encoder) -> list[np.ndarray]:
    """Ids of each marked part; the distinct words of all of them are sorted into one trie."""
    place: dict[str, int] = defaultdict(count().__next__)
    at = [np.fromiter(map(place.__getitem__, _UNITS.findall(p)), np.int32) for p in parts]
    found = encoder.ids_of(list(place))
    sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    flat = np.frombuffer(b"".join(found), np.int32)
    starts = np.cumsum(sizes) - sizes
    out = []
    for w in at:
        n = sizes[w]
        out.append(flat[np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """doc_id, row, n_tokens and ids for each document; with ``check`` also round_trip, whether the ids decode to the text.

    Equal to the library's ids.  A null or empty text has no ids; repeated rows
    are encoded each; other columns are ignored; an empty table gives no rows.
    Texts of any length: words are held for one part at a time.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spelling = held.value.worker(), held.value.spelling()
        for batch in batches:
            first, ids, waiting = 0, [], []  # ids: of the rows from first on; waiting: (row, part)

            def settle() -> None:
                for (k, _), x in zip(waiting, encode_parts([p for _, p in waiting], encoder), strict=True):
                    ids[k - first].append(x)
                waiting.clear()

            def done(last: int) -> pa.RecordBatch:
                lists = [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in ids]
                counts = [len(x) for x in lists]
                out = {"doc_id": batch["doc_id"].slice(first, last - first), "row": batch["row"].slice(first, last - first), "n_tokens": pa.array(counts, pa.int64())}
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate(lists)))
                if check:
                    texts = frames.blobs(batch["data"].slice(first, last - first))
                    out["round_trip"] = pa.array([decode_ids(x.tolist(), spelling) == t.decode() for x, t in zip(lists, texts, strict=True)])
                return pa.RecordBatch.from_pydict(out)

            size = 0
            for k, cell in enumerate(batch["data"]):
                ids.append([])
                for part in marked_parts((cell.as_py() or b"").decode()):
                    waiting.append((k, part))
                    size += len(part)
                    if size >= PART:
                        settle()
                        size = 0
                if not size and k > first:
                    yield done(k + 1)
                    first, ids = k + 1, []
            if ids:
                settle()
                yield done(batch.num_rows)

    return frames.mapped(frames.documents(docs, id_col, text_col), run, "doc_id long, row int, n_tokens long, ids array<int>" + (", round_trip boolean" if check else ""))


def decode_ids(ids: list[int], spelling: list[bytes]) -> str:
    """Text of ids: pieces, runs of bytes as UTF-8 (U+FFFD where they are none), marks to spaces, the first one off."""
    text = b"".join([spelling[i] for i in ids if 0 <= i < len(spelling)]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each id list (null: the empty text); ids that are no piece give nothing.

    ``decode(encode(x))`` is x, but for a U+2581 in x, which the model cannot
    tell from a space.  An empty table gives no rows.
    """
    held = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def step(batch: pa.RecordBatch) -> dict:
        spelling = held.value.spelling()
        return {"doc_id": batch["doc_id"], "text": pa.array([decode_ids([i for i in x or () if i is not None], spelling) for x in batch["ids"].to_pylist()], pa.string())}

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return frames.columns(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, text string", step)
