from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalstrata.llm import components, jaccard_join, substring_dedup
from evalstrata.llm.text import CHUNK, Sequences, word_bounds, word_hashes

from . import cases


def test_word_hashes_follow_the_byte_rule():
    text = "One\u00a0two  three\x0bFOUR\x1cfive\nÉcole".encode()
    start, end = word_bounds(text)
    assert [text[a:b] for a, b in zip(start, end, strict=True)] == text.split()
    assert (word_hashes(b"ABC d", fold=True) == word_hashes(b"abc D", fold=True)).all()
    assert (word_hashes(b"ABC") != word_hashes(b"abc")).all()
    assert len(word_hashes("don't, é-x".encode(), marks=True)) == 4
    assert len(word_hashes(b"")) == 0


def test_long_texts_are_hashed_in_parts_alike():
    text = (b"word " * 3 + b"x" * 10) * (CHUNK // 10)
    assert len(text) > CHUNK
    got = word_hashes(text)
    assert len(got) == len(text.split()) and len(set(got.tolist())) == len(set(text.split()))
    assert len(word_hashes(b"y" * (3 * CHUNK))) == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60))
def test_sequences_equal_only_for_equal_windows(values):
    h = np.array(values, np.uint64)
    got = Sequences(h).windows(3)
    want = [tuple(values[i : i + 3]) for i in range(len(values) - 2)]
    assert len(got) == len(want)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(want)) for j in range(len(want)))


@pytest.mark.parametrize("window,gram", [(50, 8), (12, 4)])
def test_substring_dedup_equals_brute_force(spark, window, gram):
    rows = cases.documents()
    got = substring_dedup.dedup_substrings(cases.frame(spark, rows), window=window, gram=gram).collect()
    assert cases.ordered((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got) == cases.ordered(cases.removed_words(rows, window))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert any(0 < r.n_removed < r.n_words for r in got)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.dedup_substrings(cases.frame(spark, [])).collect() == []


def test_jaccard_components_equal_brute_force(spark):
    rows = cases.documents()
    got = jaccard_join.jaccard_components(cases.frame(spark, rows)).collect()
    assert cases.ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == cases.ordered(cases.linked(rows))
    assert jaccard_join.jaccard_components(cases.frame(spark, [])).collect() == []


def test_jaccard_components_of_a_large_loose_family(spark):
    """Copies with several edits each: many link to the original only, some not at all; a passage that strangers share links nobody."""
    rng = random.Random(5)
    base, passage = cases.prose(rng, 120).split(), cases.prose(rng, 60)
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"{cases.prose(rng, 90)} {passage}") for i in range(40)]
    got = jaccard_join.jaccard_components(cases.frame(spark, rows)).collect()
    assert cases.ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == cases.ordered(cases.linked(rows))


def test_jaccard_components_of_null_ids_and_ids_with_two_texts(spark):
    """A text without an id comes first in its task, its copies with ids later; an id's second set links where its first does not."""
    rng = random.Random(9)

    def edited(text: str, n: int) -> str:
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        return " ".join(w)

    rows = []
    for k in range(12):
        base, other = cases.prose(rng, 120), cases.prose(rng, 40)
        rows += [(None, base), (100 * k + 50, base), (100 * k + 51, edited(base, 2)), (100 * k + 10, other), (100 * k + 10, base + " end")]
        rows += [(100 * k + 5, other), (100 * k + 60, edited(base, 4)), (100 * k + 61, edited(base, 4)), (100 * k + 62, edited(base, 5))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert cases.ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == cases.ordered(cases.linked(rows))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([60, 75, 90]))
def test_similar_sets_share_a_signature_and_sketches_bound_the_difference(size, seed, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
    drop, add = (int(x) for x in rng.integers(0, max(1, size // 5) + 1, 2))
    b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, add, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    union = len(a) + len(b) - both
    common = lambda s: (s % np.uint64(7) == 0).astype(np.int64) * (s % np.uint64(50)).astype(np.int64)  # noqa: E731  any order that both share
    if len(b) and 100 * both >= percent * union:
        assert set(jaccard_join.signatures(a, common(a), percent).tolist()) & set(jaccard_join.signatures(b, common(b), percent).tolist())
    bits = lambda s: np.frombuffer(jaccard_join.sketch_of(s), np.uint64)
    assert np.bitwise_count(bits(a) ^ bits(b)).sum() <= union - both


@pytest.mark.parametrize("small, more", [(0, 3), (900, 200), (1000, 40), (5000, 1500), (20_000, 9000)])
def test_sketches_of_unequal_sizes_never_differ_more_than_sets(small, more):
    rng = np.random.default_rng(small)
    a = np.unique(rng.integers(0, 2**63, small).astype(np.uint64))
    b = np.union1d(a[small // 50 :], rng.integers(0, 2**63, more).astype(np.uint64))
    x, y = jaccard_join.sketch_of(a), jaccard_join.sketch_of(b)
    assert jaccard_join.apart(x, y) <= len(np.setxor1d(a, b))
    stranger = jaccard_join.sketch_of(np.unique(rng.integers(0, 2**63, max(small, 1)).astype(np.uint64)))
    assert small < 5000 or jaccard_join.apart(x, stranger) > 2 * len(a) * 25 // 175


def test_equal_groups_come_back_once():
    """Two signatures of the same two sets are one group; copies of one set are none."""
    cols = {"sign": np.array([1, 1, 2, 2, 3, 3, 4, 4, 4]), "a": np.array([7, 8, 8, 7, 9, 9, 7, 9, 9])}
    edge = np.array([0, 2, 4, 6])
    (got,) = jaccard_join._shared(cols, edge, np.array([2, 2, 2, 3]))
    groups = {}
    for sign, a in zip(got["sign"].tolist(), got["a"].tolist(), strict=True):
        groups.setdefault(sign, []).append(a)
    assert sorted(groups.values()) == [[7, 8], [7, 9]]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (7, 7), (5, 6), (6, 5), (100, 9), (2, 1)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 9, 100)} == dict.fromkeys((1, 2, 3, 9, 100), 1)
    assert got[5] == got[6] == 5 and 7 not in got
    assert all(got[1000 + i] == 1000 for i in range(41))
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
