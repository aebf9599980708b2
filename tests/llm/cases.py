"""Documents with the awkward cases that every operator must take, and brute-force twins."""

from __future__ import annotations

import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ta", "re", "ön", "li", "SO", "um"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, Unicode spaces, repeated rows, copies, shared passages, a very long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 160)) for _ in range(25)]
    passage = prose(rng, 70)
    texts = [None, "", "  \n\t ", "one", "Two words", "a\u00a0b c\u2003d", "x" * 5000, "Ünï\u0000côdé ＡＢＣ " * 12]
    texts += base + [base[0], base[0], base[3] + " tail", "head " + base[4]]
    for t in base[5:12]:
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)]
    texts += [prose(rng, 12) + " " + base[1] + "\n" + base[1], prose(rng, 30_000)]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, base[2]), (None, None), (500, base[2])]


def frame(spark, rows, schema="doc_id long, text string"):
    """With null and clashing extra columns, in several partitions."""
    extra = ["row", "anchor", "content", "start", "count", "n", "a", "b", "sign", "uid", "ws", "packed", "data", "node", "component_id", "score", "page_id", "words", "h", "lines", "lang"]
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.selectExpr("*", *[f"cast(null as string) as `{c}`" for c in extra if c not in df.columns])


def removed_words(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, kept, n_words, n_removed) of each row, for unique non-null ids or repeated rows."""
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = SPACE.findall(fold(text or ""))
    return frozenset(tuple(w[p : p + size]) for p in range(max(1, len(w) - size + 1))) if w else frozenset()


def linked(rows: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t) for _, t in rows]
    near: dict[int, set] = {i: {i} for i, _ in rows if i is not None}
    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows):
            if i is not None and j is not None and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                near[i].add(j)
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        seen, todo = set(), [i] if i is not None else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        out.append((i, len(s), min(seen, default=None)))
    return out


def hits(text: str | None, items: list[tuple], window: int = 10) -> tuple[int, int, list[str]]:
    w = ALNUM.findall(fold(text or ""))
    covered, found = set(), set()
    for item, t in items:
        b = ALNUM.findall(fold(t or ""))
        size = min(window, len(b))
        for q in range(max(1, len(b) - window + 1)) if b else ():
            for p in range(len(w) - size + 1):
                if w[p : p + size] == b[q : q + size]:
                    covered.update(range(p, p + size))
                    found.add(str(item))
    return len(w), len(covered), sorted(found)


def ordered(rows) -> list:
    return sorted(map(repr, rows))
