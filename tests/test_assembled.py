from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalstrata.operators import agreement, arena, assembled, quantiles


def test_grouped_quantiles_equal_numpy_on_any_spread(spark):
    rng = random.Random(4)
    values = {1: [rng.lognormvariate(5, 3) for _ in range(400)], 2: [7.0] * 50, 3: [-3.5, 2.0], 4: [0.0], 5: [rng.uniform(-1, 1) for _ in range(101)] + [1e12, -1e12], 6: [100 + i / 1e6 for i in range(300)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(1, None), (7, None)]
    of = {"least": 0.0, "median": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.k: r for r in quantiles.grouped_quantiles(spark.createDataFrame(rows, "k long, x double").repartition(5), ["k"], "x", of).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, q in of.items():
            assert got[k][name] == pytest.approx(float(np.percentile(vs, 100 * q)), rel=1e-12, abs=1e-12)
    empty = spark.createDataFrame([], "k long, x double")
    assert quantiles.grouped_quantiles(empty, ["k"], "x", of).count() == 0


def _labels(spark, rows):
    return spark.createDataFrame([(i, q, a, v, ruling, t, "") for i, q, a, v, ruling, t in rows], "image_id long, question_id long, annotator string, value string, is_adjudication boolean, updated_at long, note string")


def _kappa(pairs):
    n = len(pairs)
    seen = sum(a == b for a, b in pairs) / n
    chance = sum(sum(a == v for a, _ in pairs) * sum(b == v for _, b in pairs) for v in agreement.VALUES) / n**2
    return (seen - chance) / (1 - chance) if n >= 2 and chance < 1 else None


def test_intervals_agree_with_resampling_case_by_case(spark):
    rng = random.Random(9)
    truth = [rng.choice(agreement.VALUES[:2]) for _ in range(120)]
    rows = [(i, 1, a, t if rng.random() < 0.8 else rng.choice(agreement.VALUES), False, 1) for i, t in enumerate(truth) for a in ("x", "y", "z")]
    rows += [(i, 2, a, "yes", False, 1) for i in range(3) for a in ("u", "v")]  # under four cases
    df = _labels(spark, rows)
    got = {(r.a, r.b): r for r in assembled.pair_intervals(df.repartition(3), draws=2000).collect()}
    own = {(i, a): v for i, q, a, v, *_ in rows if q == 1}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        pairs = [(own[i, a], own[i, b]) for i in range(120)]
        draws = [_kappa([pairs[rng.randrange(120)] for _ in pairs]) for _ in range(2000)]
        low, high = np.percentile([x for x in draws if x is not None], [2.5, 97.5])
        assert got[a, b].kappa == pytest.approx(_kappa(pairs))
        assert got[a, b].low == pytest.approx(low, abs=0.03) and got[a, b].high == pytest.approx(high, abs=0.03)
    assert got["u", "v"].low is None and got["u", "v"].shared == 3
    by_question = {r.question_id: r for r in assembled.question_intervals(df, draws=2000).collect()}
    want = agreement.alpha_bootstrap_python(df.filter("question_id = 1"), draws=400).first()
    assert by_question[1].low == pytest.approx(want.low, abs=0.03) and by_question[1].high == pytest.approx(want.high, abs=0.03)
    assert by_question[2].low is None and by_question[2].high is None
    again = assembled.question_intervals(df.repartition(7), draws=2000).filter("question_id = 1").first()
    assert (again.low, again.high) == (by_question[1].low, by_question[1].high)  # whatever the partitions


def test_a_meeting_is_refused_for_each_of_its_reasons(spark):
    protocol = dict.fromkeys(arena.SIGNATURE, "1")
    make = lambda i, status="completed", demo=False, **other: (i, status, demo, *{**protocol, **other}.values())
    runs = [make(1), make(2), make(3, "paused"), make(4, demo=True), make(5, seed="2"), *[make(i) for i in range(10, 23)]]
    runs = spark.createDataFrame(runs, "id long, status string, is_demo boolean, " + ", ".join(f"{c} string" for c in arena.SIGNATURE))
    meetings = {"fine": [1, 2], "alone": [1], "many": list(range(10, 23)), "open": [1, 3], "demo": [1, 4], "seed": [1, 5], "ghost": [1, 99], "apart": [2, 10]}
    chosen = spark.createDataFrame([(a, r) for a, rs in meetings.items() for r in rs + rs[:1]], "arena string, run_id long")
    got = {(r.arena, r.reason) for r in assembled.arena_refusals(runs, chosen).collect()}
    assert got == {("alone", "not 2 to 12 runs"), ("many", "not 2 to 12 runs"), ("open", "a run is not completed"), ("demo", "demo beside real models"), ("seed", "protocols differ"), ("ghost", "unknown run")}
    # runs 1 and 2 share a unit; 10 answers another image only
    row = lambda run, image: (run, 1, image, 7, True, "canonical", "yes", "yes", True, "")
    rows = spark.createDataFrame([row(1, 1), row(2, 1), row(2, 2), row(10, 3)], "run_id long, question_id long, image_id long, variant_id long, canonical boolean, mutation_type string, answer string, ground_truth string, format_valid boolean, source_group string")
    some = chosen.filter("arena in ('fine', 'apart')")
    assert [(r.arena, r.reason) for r in assembled.arena_refusals(runs, some, rows).collect()] == [("apart", "no common units")]


def test_labels_are_admitted_applied_and_withdrawn(spark):
    labels = _labels(spark, [(1, 1, "a", "yes", False, 1), (1, 1, "b", "no", False, 1), (2, 1, "a", "yes", False, 1), (2, 1, "b", "yes", False, 1), (3, 1, "a", "no", False, 1)])
    rows = [
        (1, 1, "c", "no", True, 2, "", False), (2, 1, "c", "no", True, 2, "", False),  # a ruling on a conflict; on a case that nobody disputes
        (2, 1, "a", "no", False, 2, "", False), (2, 1, "a", "uncertain", False, 3, "", False),  # the later one holds
        (3, 1, "a", "yes", False, 2, "", True), (3, 1, "z", "yes", False, 2, "", True), (2, 1, "b", "perhaps", False, 2, "", None), (2, 1, "b", None, False, 2, "", False),
    ]
    changes = spark.createDataFrame(rows, labels.schema.add("withdraw", "boolean"))
    labels = labels.select("image_id", "question_id", "annotator", "value", "is_adjudication", "updated_at", "note")
    refused = sorted((r.image_id, r.annotator, r.refused) for r in assembled.admit_labels(labels, changes).filter("refused is not null").collect())
    assert refused == [(2, "b", "unknown value"), (2, "b", "unknown value"), (2, "c", "nobody disputes the case"), (3, "z", "nothing to withdraw")]
    after = assembled.apply_labels(labels, changes)
    assert after.columns == labels.columns
    got = {(r.image_id, r.value, r.agreement) for r in agreement.resolve_labels(after).collect()}
    assert got == {(1, "no", "adjudicated"), (2, "uncertain", "conflict")}  # case 3 has no label left, so no consensus
    none = assembled.apply_labels(labels.limit(0), changes.limit(0))
    assert none.count() == 0


def test_audit_names_what_is_wrong_by_severity(spark):
    images = spark.createDataFrame([(i, "s1" if i < 4 else "", 3000, 10, "train" if i % 2 else "test") for i in range(6)], "id long, source_group string, width long, height long, split string")
    notes = spark.createDataFrame([(0, 1, "yes"), (1, 2, "exclude")], "image_id long, question_id long, value string")
    pairs = spark.createDataFrame([(0, 1, 2, "identical", True), (1, 4, 9, "same scene", False)], "a long, b long, distance long, kind string, same_group boolean")
    files = spark.createDataFrame([("p", "missing"), ("q", "changed"), ("r", "ok")], "path string, state string")
    got = [(r.severity, r.area, r.n) for r in assembled.audit_report(images, notes, pairs, images.select("id").filter("id < 5"), files).collect()]
    assert [s for s, *_ in got] == sorted((s for s, *_ in got), key=assembled.SEVERITY.index)
    for want in [("high", "files", 1), ("high", "hashes", 1), ("high", "duplicates", 1), ("high", "split", 2), ("medium", "scenes", 4), ("low", "scenes", 2), ("low", "resolution", 6), ("medium", "question 2", 0), ("medium", "question 1", 1)]:
        assert want in got
    nothing = assembled.audit_report(images, notes, pairs.limit(0), images.select("id").limit(0))
    assert [r.n for r in nothing.filter(F.col("area") == "hashes").collect()] == [6]
