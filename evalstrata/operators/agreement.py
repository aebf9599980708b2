"""Consensus of reviewers and chance-corrected agreement.

Coefficients come from counts by (unit, value); no pair of labels is listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import draws as draw
from ..functions.stats import interpret_agreement, pairs, share

VALUES = ("yes", "no", "uncertain", "exclude")
CASE = ["image_id", "question_id"]


def resolve_labels(labels: DataFrame) -> DataFrame:
    """Each case's value and state: adjudicated before single, unanimous, majority (more than half) and conflict (uncertain).

    Counts are of independent labels; a case with adjudications alone is valid, with 0.
    """
    own = ~F.col("is_adjudication")
    counts = [F.count_if(own & (F.col("value") == v)).alias(f"c_{v}") for v in VALUES]
    latest = F.max_by(F.when(F.col("is_adjudication"), F.col("value")), F.when(F.col("is_adjudication"), F.struct("updated_at", "annotator")))
    notes = F.array_sort(F.collect_list(F.when(F.col("note") != "", F.concat_ws(": ", "annotator", "note"))))
    out = labels.groupBy(*CASE).agg(*counts, latest.alias("ruling"), F.substring(F.array_join(notes, " · "), 1, 2000).alias("notes"))
    n = sum((F.col(f"c_{v}") for v in VALUES[1:]), F.col(f"c_{VALUES[0]}"))
    kinds = sum(((F.col(f"c_{v}") > 0).cast("int") for v in VALUES[1:]), (F.col(f"c_{VALUES[0]}") > 0).cast("int"))
    top = F.greatest(*[F.col(f"c_{v}") for v in VALUES])
    chosen = F.coalesce(*[F.when(F.col(f"c_{v}") == top, F.lit(v)) for v in VALUES])
    state = F.when(F.col("ruling").isNotNull(), "adjudicated").when(n == 1, "single").when(kinds == 1, "unanimous").when(2 * top > n, "majority").otherwise("conflict")
    out = out.withColumns({"label_count": n, "distinct_values": kinds, "agreement": state})
    value = F.when(F.col("agreement") == "adjudicated", F.col("ruling")).when(F.col("agreement") == "conflict", "uncertain").otherwise(chosen)
    return out.select(*CASE, value.alias("value"), "agreement", F.col("label_count").cast("long"), F.col("distinct_values").cast("long"), "notes")


def consensus_summary(labels: DataFrame) -> DataFrame:
    return resolve_labels(labels).groupBy("agreement").agg(F.count("*").alias("cases"))


def contested_cases(labels: DataFrame, limit: int = 200) -> DataFrame:
    """Cases to look at again, open conflicts first; totals are of all of them, before the limit."""
    rank = F.when(F.col("agreement") == "conflict", 0).when(F.col("agreement") == "majority", 1).otherwise(2)
    some = resolve_labels(labels).filter(F.col("agreement").isin("conflict", "majority", "adjudicated"))
    totals = some.agg(F.count("*").alias("total"), F.count_if(F.col("agreement") == "conflict").alias("unresolved"))
    top = some.drop("notes").withColumn("state_rank", rank.cast("long")).orderBy("state_rank", F.desc("distinct_values"), "image_id", "question_id").limit(limit)
    return top.crossJoin(F.broadcast(totals))  # one row


def annotators(labels: DataFrame) -> DataFrame:
    """Labels of each annotator, the spelling's case ignored."""
    return labels.groupBy(F.lower("annotator").alias("annotator")).agg(
        F.count_if(~F.col("is_adjudication")).alias("labels"), F.count_if("is_adjudication").alias("adjudications"),
        F.count_if((F.col("value") == "yes") & ~F.col("is_adjudication")).alias("yes"), F.max("updated_at").alias("last_seen"),
    )


def annotation_board(labels: DataFrame, images: DataFrame, question: int, annotator: str) -> DataFrame:
    """Each image with its consensus on one question, the annotator's own label and how many others labelled it."""
    one = labels.filter((F.col("question_id") == question) & ~F.col("is_adjudication"))
    mine = F.lower("annotator") == annotator.lower()
    seen = one.groupBy("image_id").agg(F.max(F.when(mine, F.col("value"))).alias("mine"), F.count_if(~mine).alias("others"))
    agreed = resolve_labels(labels.filter(F.col("question_id") == question)).select("image_id", F.col("value").alias("consensus"), "agreement")
    out = images.join(seen, "image_id", "left").join(agreed, "image_id", "left")
    hidden = F.when(F.col("mine").isNotNull(), F.col("consensus"))  # blind until one's own label is there
    return out.select("image_id", "mine", F.coalesce("others", F.lit(0)).alias("others"), hidden.alias("consensus"), "agreement", F.col("mine").isNotNull().alias("mine_done"))


def unit_values(labels: DataFrame, *keys: str) -> DataFrame:
    """Counts by unit of independent labels: n, the sum of squares, and the count of each value; units with two labels or more."""
    each = labels.filter("not is_adjudication").groupBy(*keys, *[k for k in CASE if k not in keys]).agg(F.count("*").alias("n"), *[F.count_if(F.col("value") == v).alias(v) for v in VALUES])
    squares = sum((F.col(v) * F.col(v) for v in VALUES[1:]), F.col(VALUES[0]) * F.col(VALUES[0]))
    return each.filter("n >= 2").withColumn("squares", squares)


def coefficients(labels: DataFrame, *keys: str) -> DataFrame:
    """Observed agreement, nominal Krippendorff alpha and Fleiss kappa of each group of ``keys`` (all labels: none).

    alpha = 1 - D_o / D_e, null where the values don't vary; kappa is null
    unless two units or more have one and the same number of labels.
    """
    u = unit_values(labels, *keys)
    n = F.col("n").cast("double")
    sums = [F.sum(v).cast("double").alias(f"m_{v}") for v in VALUES]
    g = u.groupBy(*keys).agg(
        F.count("*").alias("units"), F.sum(pairs(F.col("n"))).alias("pairs"), (F.sum(F.col("squares") - F.col("n")) / 2).cast("long").alias("agreed"),
        F.sum((n * n - F.col("squares")) / (n - 1)).alias("d_o"), F.sum("n").cast("double").alias("total"), *sums,
        F.min("n").alias("least"), F.max("n").alias("most"), F.avg((F.col("squares") - n) / (n * (n - 1))).alias("p_bar"),
    )
    squares = sum((F.col(f"m_{v}") * F.col(f"m_{v}") for v in VALUES[1:]), F.col(f"m_{VALUES[0]}") * F.col(f"m_{VALUES[0]}"))
    d_e = F.try_divide(F.col("total") * F.col("total") - squares, F.col("total") - 1)
    by_chance = F.try_divide(squares, F.col("total") * F.col("total"))
    alpha = F.when((F.col("total") >= 2) & (d_e > 0), F.lit(1.0) - F.col("d_o") / d_e)
    fleiss = F.when((F.col("units") >= 2) & (F.col("least") == F.col("most")) & (by_chance < 1), (F.col("p_bar") - by_chance) / (F.lit(1.0) - by_chance))
    return g.select(*keys, "units", F.try_divide(F.col("agreed").cast("double"), F.col("pairs").cast("double")).alias("observed"), alpha.alias("alpha"), fleiss.alias("fleiss"), interpret_agreement(alpha).alias("band"))


def fixed_panel(labels: DataFrame, size: int) -> DataFrame:
    """The labels of cases with exactly ``size`` independent labels, on which Fleiss' kappa is defined."""
    n = F.count("*").over(W.partitionBy(*CASE))
    return labels.filter("not is_adjudication").withColumn("panel", n).filter(F.col("panel") == size).drop("panel")


def _pairs_of(labels: DataFrame) -> DataFrame:
    own = labels.filter("not is_adjudication").select(*CASE, "annotator", "value")
    a, b = own.toDF(*CASE, "a", "a_value"), own.toDF(*CASE, "b", "b_value")
    return a.join(b, CASE).filter("a < b")  # within a case, whose labels are one an annotator


def cohen_kappa(labels: DataFrame) -> DataFrame:
    """Each pair of annotators on the cases both labelled: shared, agreed and Cohen's kappa (null under two, or without variation)."""
    joint = _pairs_of(labels).groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.count_if(F.col("a_value") == F.col("b_value")).alias("agreed"),
        *[F.count_if(F.col("a_value") == v).alias(f"a_{v}") for v in VALUES], *[F.count_if(F.col("b_value") == v).alias(f"b_{v}") for v in VALUES],
    )
    n = F.col("shared").cast("double")
    chance = sum((F.col(f"a_{v}") * F.col(f"b_{v}") for v in VALUES[1:]), F.col(f"a_{VALUES[0]}") * F.col(f"b_{VALUES[0]}")) / (n * n)
    seen = F.col("agreed") / n
    return joint.select("a", "b", "shared", "agreed", F.when((n >= 2) & (chance < 1), (seen - chance) / (F.lit(1.0) - chance)).alias("kappa"))


def confusions(labels: DataFrame, top: int = 8) -> DataFrame:
    """The commonest disagreements of each pair of annotators."""
    each = _pairs_of(labels).filter("a_value != b_value").groupBy("a", "b", "a_value", "b_value").agg(F.count("*").alias("cases"))
    rank = F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("cases"), "a_value", "b_value"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= top)


def annotator_report(labels: DataFrame) -> DataFrame:
    """Each annotator's independent labels by value, and the share of yes among yes and no (spelling as stored)."""
    own = labels.filter("not is_adjudication")
    out = own.groupBy("annotator").agg(F.count("*").alias("labels"), F.count_distinct("image_id").alias("images"), F.count_distinct("question_id").alias("questions"), *[F.count_if(F.col("value") == v).alias(f"n_{v}") for v in VALUES])
    return out.withColumn("positive_share", F.try_divide(F.col("n_yes").cast("double"), (F.col("n_yes") + F.col("n_no")).cast("double")))


def _draw(slot: Column, rep: Column, n: Column, seed: int) -> Column:
    """A position below ``n`` from a hash of (seed, repetition, slot)."""
    text = F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), slot.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % n).cast("long")


#: Units whose kinds are sent to every task (two bytes each or one), and kinds of units that are told apart there.
MOST_PACKED, MOST_KINDS = 50_000_000, 1 << 16
#: Slots and draws that one task takes.
SPAN, SHARE = 5 * draw.STRIDE, 50


def _kinds(u: DataFrame, most: int) -> tuple[int, np.ndarray | None]:
    """The number of units, and a row (n, squares, count of each value) for each kind of unit; none if there are more than ``most`` kinds."""
    names = ["n", "squares", *VALUES]
    each = u.groupBy(*names).agg(F.count("*").alias("units"))
    found = each.limit(most + 1).toArrow()
    if found.num_rows > most:
        return u.count(), None
    table = np.array([found[c].to_numpy() for c in names], np.int64).T.reshape(-1, len(names))
    return int(found["units"].to_numpy().sum()), table[np.lexsort(table.T[::-1])]


def _packed(u: DataFrame, kinds: np.ndarray) -> np.ndarray:
    """The kind of each unit, in order of (question, image)."""
    names, small = ["n", "squares", *VALUES], np.min_scalar_type(max(1, len(kinds)) - 1)
    known = u.sparkSession.createDataFrame(pa.table({**{c: kinds[:, i] for i, c in enumerate(names)}, "kind": np.arange(len(kinds))}))
    ordered = u.join(F.broadcast(known), names).select("question_id", "image_id", "kind").orderBy("question_id", "image_id").select("kind")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"kinds": pa.array([batch["kind"].to_numpy().astype(small).tobytes()], pa.binary())})

    return np.frombuffer(b"".join(x.as_py() for x in ordered.mapInArrow(run, "kinds binary").toArrow()["kinds"]), small)


def _measures(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each kind of unit its observed disagreement, and n with the count of each value."""
    n, squares = kinds[:, 0].astype(float), kinds[:, 1]
    return (n * n - squares) / (n - 1), kinds[:, [0, *range(2, 2 + len(VALUES))]]


def _drawn_from_kinds(u: DataFrame, units: int, kinds: np.ndarray, draws: int, seed: int) -> DataFrame:
    """rep and the sums of what it draws, in tasks that hash a span of slots for some repetitions and look the units' kinds up; no row a draw."""
    held = u.sparkSession.sparkContext.broadcast((_packed(u, kinds), kinds))
    span = max(SPAN, -(-units // 256))
    spans, shares = -(-units // span), -(-draws // SHARE)

    def run(batches):
        where, table = held.value
        d_o, counts = _measures(table)
        for batch in batches:
            for task in batch["id"].to_pylist():
                at, first = task % spans * span, task // spans * SHARE
                reps = range(first, min(first + SHARE, draws))
                seen = np.zeros((len(reps), len(table)), np.int64)
                for rep, positions in draw.hashed(seed, reps, at, min(at + span, units), units):
                    seen[rep - first] += np.bincount(where[positions], minlength=len(table))
                sums = seen @ counts
                yield pa.RecordBatch.from_pydict({"rep": np.array(reps), "d_o": seen @ d_o, "total": sums[:, 0], **{f"m_{v}": sums[:, 1 + i] for i, v in enumerate(VALUES)}})

    schema = "rep long, d_o double, total long, " + ", ".join(f"m_{v} long" for v in VALUES)
    each = u.sparkSession.range(0, spans * shares, 1, max(1, spans * shares)).mapInArrow(run, schema)
    return each.groupBy("rep").agg(F.sum("d_o").alias("d_o"), *[F.sum(c).cast("double").alias(c) for c in ("total", *[f"m_{v}" for v in VALUES])])


def _drawn_by_joins(u: DataFrame, total: DataFrame, draws: int, seed: int) -> DataFrame:
    """The same where there are too many units or kinds to send to all tasks: units are joined once a draw slot."""
    # The rank of a unit: within a range partition, plus what came before it.
    ordered = u.repartitionByRange("question_id", "image_id").withColumn("part", F.spark_partition_id())
    ordered = ordered.withColumn("within", F.row_number().over(W.partitionBy("part").orderBy("question_id", "image_id")))
    before = ordered.groupBy("part").agg(F.count("*").alias("size"))
    before = before.withColumn("before", F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))  # one row a partition
    units = ordered.join(F.broadcast(before), "part").withColumn("pos", F.col("within") - 1 + F.coalesce("before", F.lit(0)))
    slots = units.select(F.col("pos").alias("slot")).crossJoin(F.broadcast(total))  # one row
    picked = slots.select("slot", "units", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("rep"))
    taken = picked.groupBy("rep", _draw(F.col("slot"), F.col("rep"), F.col("units"), seed).alias("pos")).agg(F.count("*").alias("times"))
    n = F.col("n").cast("double")
    return taken.join(units, "pos").groupBy("rep").agg(
        F.sum(F.col("times") * (n * n - F.col("squares")) / (n - 1)).alias("d_o"), F.sum(F.col("times") * F.col("n")).cast("double").alias("total"),
        *[F.sum(F.col("times") * F.col(v)).cast("double").alias(f"m_{v}") for v in VALUES],
    )


def alpha_bootstrap(labels: DataFrame, draws: int = 100, seed: int = 20260825) -> DataFrame:
    """An interval of alpha by resampling cases, with hashed draws: the same on any engine and partitioning.

    Null under four units or where fewer than half of the draws are defined.
    Units are numbered in order of (question, image).  Alpha depends only on how
    often each kind of unit (its counts of the values) is drawn, so the kinds by
    number are collected and sent to the tasks; beyond MOST_PACKED units or
    MOST_KINDS kinds the draws are joined with the units instead.
    """
    u = unit_values(labels).select("question_id", "image_id", "n", "squares", *VALUES)
    units, kinds = _kinds(u, MOST_KINDS)
    total = labels.sparkSession.range(1).select(F.lit(units).cast("long").alias("units"))
    drawn = _drawn_by_joins(u, total, draws, seed) if kinds is None or units > MOST_PACKED else _drawn_from_kinds(u, units, kinds, draws, seed)
    squares = sum((F.col(f"m_{v}") * F.col(f"m_{v}") for v in VALUES[1:]), F.col(f"m_{VALUES[0]}") * F.col(f"m_{VALUES[0]}"))
    d_e = (F.col("total") * F.col("total") - squares) / (F.col("total") - 1)
    each = drawn.select(F.when(d_e > 0, F.lit(1.0) - F.col("d_o") / d_e).alias("alpha"))
    out = each.agg(F.count("alpha").alias("defined"), F.percentile("alpha", F.lit(0.025)).alias("low"), F.percentile("alpha", F.lit(0.975)).alias("high"))
    out = out.crossJoin(F.broadcast(total))  # one row each
    ok = (F.col("units") >= 4) & (F.col("defined") * 2 >= draws)
    return out.select("units", "defined", F.when(ok, F.col("low")).alias("low"), F.when(ok, F.col("high")).alias("high"))


def agreement_warnings(labels: DataFrame) -> DataFrame:
    """severity and warning, the severest first: few reviewers or double cases, low alpha, open conflicts, a near-constant reviewer."""
    all_ = coefficients(labels)
    some = annotator_report(labels)
    conflicts = resolve_labels(labels).filter("agreement = 'conflict'").agg(F.count("*").alias("n"))
    rows = [
        some.agg(F.count("*").alias("n")).filter("n = 1").select(F.lit("high").alias("severity"), F.lit("one reviewer only").alias("warning")),
        all_.filter("units < 20").select(F.lit("medium"), F.lit("fewer than 20 cases with two labels")),
        all_.filter("alpha < 0.67").select(F.when(F.col("alpha") < 0.4, "high").otherwise("medium"), F.lit("alpha below 0.67")),
        conflicts.filter("n > 0").select(F.lit("medium"), F.concat(F.col("n").cast("string"), F.lit(" open conflicts"))),
        coefficients(labels, "question_id").filter("units >= 10 and alpha < 0.4").select(F.lit("medium"), F.concat(F.lit("question "), F.col("question_id").cast("string"), F.lit(": alpha below 0.4"))),
        some.filter("labels >= 20 and (positive_share > 0.9 or positive_share < 0.1)").select(F.lit("low"), F.concat(F.col("annotator"), F.lit(" answers almost always alike"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("rank", F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)).orderBy("rank", "warning")


def verified_share(labels: DataFrame) -> DataFrame:
    out = resolve_labels(labels).agg(F.count("*").alias("cases"), F.count_if(F.col("label_count") >= 2).alias("verified"))
    return out.withColumn("verified_share", share("verified", "cases"))


#: Units, and kinds of units, that the sequential bootstrap takes to one place (up to 4 bytes a unit).
MOST_UNITS, MOST_UNIT_KINDS = 250_000_000, 1_000_000


def alpha_bootstrap_python(labels: DataFrame, draws: int = 300, seed: int = 20260825) -> DataFrame:
    """The interval of alpha with Python's own generator, draw by draw, as a reference for ``alpha_bootstrap``.

    Sequential by definition, so it takes the units' kinds by number (never the
    labels) to the driver, up to MOST_UNITS, and draws there in long arrays.
    """
    u = unit_values(labels).select("question_id", "image_id", "n", "squares", *VALUES)
    units, kinds = _kinds(u, MOST_UNIT_KINDS)
    if kinds is None or units > MOST_UNITS:
        raise ValueError("too many units for the sequential bootstrap; use alpha_bootstrap")
    found = []
    if units >= 4:
        where, (d_o, counts) = _packed(u, kinds), _measures(kinds)
        pieces, rest = draw.sequential(seed, units), np.zeros(0, np.uint32)
        for _ in range(draws):
            seen, left = np.zeros(len(kinds), np.int64), units
            while left:
                rest = rest if len(rest) else next(pieces)
                seen += np.bincount(where[rest[:left]], minlength=len(kinds))
                rest, left = rest[left:], max(0, left - len(rest))
            total, *m = (int(x) for x in seen @ counts)
            expected = (total * total - sum(x * x for x in m)) / (total - 1)
            if expected > 0:
                found.append(1 - float(seen @ d_o) / expected)
    known = labels.sparkSession.createDataFrame([(float(x),) for x in found], "alpha double")
    ends = known.agg(F.count("*").alias("defined"), F.percentile("alpha", F.lit(0.025)).alias("low"), F.percentile("alpha", F.lit(0.975)).alias("high"))
    ok = F.col("defined") * 2 >= draws
    return ends.select(F.lit(units).cast("long").alias("units"), "defined", F.when(ok, F.col("low")).alias("low"), F.when(ok, F.col("high")).alias("high"))
