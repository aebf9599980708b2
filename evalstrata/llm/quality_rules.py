"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a Boolean column over a document's measures.  A bounded sample
tells how often each rule rejects and what it costs; the rules then run in the
order of rejections per cost, and the first that rejects ends the document's
cascade (``CASE`` evaluates no later branch).  The order changes cost, never a
verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents, about, in the sample that orders the rules.
SAMPLE_ROWS = 1000

_SPACE = r"[\\x20\\x09-\\x0D]"
_NOT_SPACE = r"[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over the measures and ``text``; ``cost``: SQL for the work of one row, in characters read."""

    name: str
    rejects: str
    cost: str


#: The method's own rules, beside those that every caller gets through ``base_failed``.
RULES = (
    Rule("symbols", "n_symbols * 10 > n_words * 3", "1"),
    Rule("repeated_lines", "n_dup_lines >= 3 and n_dup_lines * 10 > n_lines * 3", "1"),
    Rule("word_length", "word_chars > 25 * n_words or word_chars < 2 * n_words", "1"),
    Rule("shouting", "regexp_count(text, '[!?]{2,}') * 5 > n_words", "length(text)"),
    Rule("capitals", "regexp_count(text, '[A-Z]') * 2 > word_chars", "length(text)"),
    Rule("digits", "regexp_count(text, '[0-9]') * 2 > word_chars", "length(text)"),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the measures n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Each step is a projection of its own, so no array is made twice.  Windows
    of eight words are hashed by doubling (1, 2, 4, 8).  A text whose windows
    all differ, which most are, skips the search for the repeated ones.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.selectExpr("*", f"array_remove(split(text, '{_SPACE}+'), '') as words", f"filter(split(text, '\\n'), x -> x rlike '{_NOT_SPACE}') as lines")
    df = df.selectExpr(
        "doc_id", "text", "cast(size(words) as long) as n_words", "cast(length(array_join(words, '')) as long) as word_chars",
        "cast(regexp_count(text, '[#*$%&|<>]') as long) as n_symbols", "cast(size(lines) as long) as n_lines",
        "cast(size(lines) - size(array_distinct(lines)) as long) as n_dup_lines", "transform(words, w -> xxhash64(w)) as h",
    )
    for step in (1, 2, 4):
        df = df.withColumn("h", F.expr(f"zip_with(h, slice(h, {step + 1}, greatest(size(h), 1)), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn("h", F.expr("slice(h, 1, greatest(size(h) - 7, 0))"))
    df = df.withColumn("sorted", F.expr("if(size(h) > size(array_distinct(h)), array_sort(transform(h, (x, i) -> struct(x as h, i as i))), null)"))
    repeated = "array_sort(transform(filter(sorted, (s, k) -> s.h = get(sorted, k - 1).h or s.h = get(sorted, k + 1).h), s -> s.i))"
    covered = f"aggregate({repeated}, struct(-8 as e, 0L as n), (a, i) -> struct(i + 8 as e, a.n + least(8, i + 8 - a.e) as n), a -> a.n)"
    return df.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.expr(f"case when sorted is null then 0L else {covered} end").alias("n_repeat_words"))


def sampled(docs: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` rows of ``docs``, drawn row by row where they lie, so none is sent anywhere."""
    n = docs.count()
    return docs if n <= sample_rows else docs.sample(fraction=sample_rows / n, seed=7)


def ordered(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """``rules`` by rejections per cost on the sample ``measured``, the best first; ties keep the order given.

    Sums are made in each partition; only they are brought together.
    """
    stats = [F.sum(F.expr(f"if({r.rejects}, 1D, 0D)")).alias(f"r{i}") for i, r in enumerate(rules)]
    stats += [F.sum(F.expr(f"cast({r.cost} as double)")).alias(f"c{i}") for i, r in enumerate(rules)]
    row = measured.agg(*stats).first()
    worth = [(row[f"r{i}"] or 0.0) / max(row[f"c{i}"] or 0.0, 1.0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth[i])]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null where none does."""
    out = F
    for r in rules:
        out = out.when(F.expr(r.rejects), F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each document's measures, base_failed, kept and rejected_by (the rule, ``base`` for the base ones).

    ``base_failed``: fewer than 20 words, or over 30 of 100 words inside 8-word
    windows that the text has twice or more.  A null text is an empty one and
    fails the base; repeated rows are judged each; other columns are ignored;
    an empty table gives no rows.  Every caller gets all measures, so rules on
    measures alone cost nothing more; those that read the text again are the ones
    that the cascade spares.
    """
    measured = measures(docs, id_col, text_col)
    order = ordered(measures(sampled(docs, sample_rows), id_col, text_col), rules)
    out = measured.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop("text")
