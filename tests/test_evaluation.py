"""Published and hand-made numbers for the evaluation operators."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from evalstrata.functions import draws, stats, text
from evalstrata.operators import agreement, arena, audit, diagnostics, metrics, performance, runs
from evalstrata.plans import queries
from evalstrata.plans.units import unit_table

ROW = "run_id long, image_id long, question_id long, variant_id long, canonical boolean, mutation_type string, answer string, ground_truth string, format_valid boolean, parser string, latency_ms double, source_group string, gt_agreement string, gt_labels int, input_preprocess string, repetition int"


def row(image, variant, answer, truth, rep=0, run=1, group="", parser="json", labels=1):
    return (run, image, 1, variant, variant == 1, "canonical" if variant == 1 else "negation", answer, truth, parser == "json", parser, 100.0, group, "single", labels, "", rep)


def rows(spark, data):
    return spark.createDataFrame(data, ROW)


def test_fragility_and_accuracy(spark):
    df = rows(spark, [row(1, 1, "yes", "yes"), row(1, 2, "yes", "yes"), row(2, 1, "no", "no"), row(2, 2, "yes", "no")])
    s = metrics.run_summary(df).first()
    assert (s.pfs, s.drift, s.accuracy, s.tie_units) == (50.0, 0.0, 0.75, 0)
    assert sorted(r.accuracy for r in metrics.variant_summary(df).collect()) == [0.5, 1.0]
    assert metrics.majority_baseline(df).first().baseline == 0.5
    assert metrics.evidence_gate(df).first().grade == "C"


def test_a_flipping_repeat_drifts_but_is_not_fragile(spark):
    s = metrics.run_summary(rows(spark, [row(1, 1, "yes", "yes", 0), row(1, 1, "no", "yes", 1), row(1, 2, "yes", "yes")])).first()
    assert (s.pfs, s.drift, s.tie_units) == (0.0, 100.0, 1)


def test_scene_balance_and_parsers(spark):
    df = rows(spark, [row(i, 1, "yes", "yes", group="a") for i in range(3)] + [row(9, 1, "no", "yes", group="b", parser="word"), row(10, 1, "uncertain", "yes"), row(11, 1, None, None)])
    assert metrics.scene_balanced(df, "run_id").first().scene_balanced_accuracy == 0.5
    s = metrics.run_summary(df).first()
    assert (s.eligible, s.parsed, s.coverage) == (5, 4, 0.8)
    p = {r.parser: (r.accuracy, r.share) for r in metrics.parser_breakdown(df).collect()}
    assert p == {"json": (1.0, 0.75), "word": (0.0, 0.25)}
    assert all(r.balanced_accuracy is None for r in metrics.variant_summary(df).collect())


def test_paired_majority_over_repeats(spark):
    data = [row(1, 1, a, "yes", i) for i, a in enumerate(["yes", "yes", "no"])] + [row(1, 2, a, "yes", i) for i, a in enumerate(["no", "no", "yes"])]
    c = metrics.paired_comparisons(unit_table(rows(spark, data))).first()
    assert (c.paired, c.canonical_only, c.alternative_only, c.p_value) == (1, 1, 0, 1.0)


def test_a_quitter_cannot_win(spark):
    data = [row(i, 1, "yes" if i else "no", "yes", run=1) for i in range(10)] + [row(i, 1, "yes", "yes", run=2) for i in range(1, 6)]
    ranked = {r.run_id: r for r in arena.arena_rank(rows(spark, data), 2).collect()}
    assert (ranked[1].accuracy, ranked[2].accuracy, ranked[1].own_accuracy, ranked[2].own_accuracy, ranked[1].units) == (1.0, 1.0, 0.9, 1.0, 5)
    assert {r.measure: r.leader for r in arena.sole_leaders(arena.arena_rank(rows(spark, data), 2)).collect()}["accuracy"] is None
    p = arena.arena_pairwise(rows(spark, data)).first()
    assert (p.paired, p.delta) == (5, 0.0) and p.ci_low <= p.delta <= p.ci_high


@pytest.mark.parametrize("b,c", [(0, 0), (10, 0), (3, 7), (40, 41), (1500, 1600)])
def test_exact_mcnemar(spark, b, c):
    n, m = b + c, min(b, c)
    want = 1.0 if not n else min(1.0, float(2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n) if n < 1000 else 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n)
    got = spark.range(1).select(stats.exact_mcnemar_p(F.lit(b), F.lit(c)).alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-9)


def label(image, who, value, question=1, ruling=False, at=1.0, note=""):
    return (image, question, who, value, ruling, at, note)


LABEL = "image_id long, question_id long, annotator string, value string, is_adjudication boolean, updated_at double, note string"


def test_published_krippendorff_alpha(spark):
    # Four observers on twelve units, a published nominal data set (values 1 to 5 as four labels and one more).
    table = {"A": "1 2 3 3 2 1 4 1 2 . . .", "B": "1 2 3 3 2 2 4 1 2 5 . 3", "C": ". 3 3 3 2 3 4 2 2 5 1 .", "D": "1 2 3 3 2 4 4 1 2 5 1 ."}
    names = dict(zip("12345", ["yes", "no", "uncertain", "exclude", "other"], strict=True))
    data = [label(i, who, names[v]) for who, line in table.items() for i, v in enumerate(line.split()) if v != "."]
    old = agreement.VALUES
    try:
        agreement.VALUES = (*old, "other")
        c = agreement.coefficients(spark.createDataFrame(data, LABEL)).first()
    finally:
        agreement.VALUES = old
    assert round(c.alpha, 3) == 0.743 and c.fleiss is None


def test_cohen_kappa_and_constant_answers(spark):
    data, i = [], 0
    for a, b, n in (("yes", "yes", 20), ("yes", "no", 5), ("no", "yes", 10), ("no", "no", 15)):
        for _ in range(n):
            data += [label(i, "a", a), label(i, "b", b)]
            i += 1
    k = agreement.cohen_kappa(spark.createDataFrame(data, LABEL)).first()
    assert (k.shared, k.agreed, round(k.kappa, 3)) == (50, 35, 0.4)
    same = spark.createDataFrame([label(i, w, "yes") for i in range(5) for w in "ab"], LABEL)
    c = agreement.coefficients(same).first()
    assert (c.observed, c.alpha, c.fleiss) == (1.0, None, None) and agreement.cohen_kappa(same).first().kappa is None


def test_consensus_states(spark):
    data = [label(1, "a", "yes"), *[label(2, w, "no") for w in "ab"], *[label(3, w, v) for w, v in zip("abc", ("yes", "yes", "no"), strict=True)], label(4, "a", "yes"), label(4, "b", "no")]
    data += [label(5, "a", "yes"), label(5, "b", "no"), label(5, "z", "no", ruling=True, at=1.0), label(5, "y", "yes", ruling=True, at=2.0), label(6, "z", "no", ruling=True)]
    data += [label(7, w, v) for w, v in zip("abcde", ("yes", "yes", "no", "uncertain", "exclude"), strict=True)]
    got = {r.image_id: (r.agreement, r.value, r.label_count) for r in agreement.resolve_labels(spark.createDataFrame(data, LABEL)).collect()}
    assert got == {1: ("single", "yes", 1), 2: ("unanimous", "no", 2), 3: ("majority", "yes", 3), 4: ("conflict", "uncertain", 2), 5: ("adjudicated", "yes", 2), 6: ("adjudicated", "no", 0), 7: ("conflict", "uncertain", 5)}
    assert agreement.alpha_bootstrap(spark.createDataFrame(data, LABEL).filter("image_id < 4")).first().low is None


def test_performance(spark):
    calls = spark.createDataFrame([(i, 1, "error" if i == 9 else "json", None if i == 9 else 100.0 + 200 * (i % 2), True, 5 + 10 * (i % 2), i) for i in range(10)], "id long, provider_id long, parser string, latency_ms double, format_valid boolean, completion_tokens int, created_at long")
    run = spark.createDataFrame([(1, "running", 6, 1, 20.0, 10, 1), (1, "completed", 6, 5, 0.0, 20, 2), (2, "running", 3, 3, 1.0, None, 1), (3, "running", 3, 1, 1.0, None, 1)], "provider_id long, status string, total int, completed int, runtime_seconds double, memory_bytes long, created_at long")
    providers = spark.createDataFrame([(1, "p", "ollama", False), (4, "q", "openai", False)], "id long, name string, kind string, is_demo boolean")
    p = {r.provider_id: r for r in performance.provider_performance(providers, calls, run).collect()}
    assert (p[1].error_rate, p[1].memory_bytes, p[1].responses_per_second) == (0.1, 20, 0.05)
    assert (p[4].total, p[4].error_rate, p[4].median_ms) == (0, None, None)
    eta = {r.provider_id: r.eta_seconds for r in performance.eta(calls, run).collect()}
    assert eta[1] == 0.5 and eta[2] == 0.0 and eta[3] is None


def test_dark_images_fail(spark):
    df = rows(spark, [row(i, 1, "no" if i < 2 else "yes", "yes") for i in range(4)])
    features = spark.createDataFrame([(i, 0.1 if i < 2 else 0.5, 0.5, 0.0, 800, 800) for i in range(4)], "image_id long, brightness double, contrast double, edge_density double, width int, height int")
    top = {r.tag: r for r in diagnostics.risk_patterns(diagnostics.diagnostic_units(df, features)).collect()}["dark"]
    assert (top.failure_rate, top.delta, top.examples) == (1.0, 1.0, "0,1")


def test_near_duplicates_clusters_and_split(spark):
    hashes = spark.createDataFrame([(1, 0, 0xFFFFFFFF, 0xFFFFFFFF), (2, 0, 0xFFFFFFFF, 0xFFFFFF00), (3, 1, 0xFFFFFFFF, 0xFFFFFF01), (4, 2, 0, 0), (5, 3, 0x0F0F0F0F, 0x3C3C3C3C)], "id long, scene int, high long, low long")
    pairs = audit.near_duplicates(hashes)
    assert {(r.a, r.b, r.distance, r.kind, r.same_group) for r in pairs.collect()} == {(1, 2, 8, "same scene", True), (1, 3, 7, "same scene", False), (2, 3, 1, "identical", False)}
    clustered = audit.clusters(hashes, pairs).persist()
    assert {(r.node, r.cluster) for r in clustered.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    for seed in range(4):
        side = {r.node: r.side for r in audit.split_python(clustered, seed, 0.4).collect()}
        assert side[1] == side[2] == side[3] and len(set(side.values())) == 2
    with pytest.raises(ValueError):
        audit.split_python(clustered.filter("cluster = 1"))
    assert {r.node for r in audit.split_hash(clustered).collect()} == {1, 2, 3, 4, 5}


def test_units_join_scenes_and_near_pairs(spark, monkeypatch):
    far = [(1, 0, 0, 0), (2, 0, 0xFFFFFFFF, 0xFFFFFFFF), (3, 1, 0xFFFFFFFF, 0xFFFFFFFE), (4, 1, 0x0F0F0F0F, 0x0F0F0F0F), (5, 2, 0x33333333, 0x0F0FF0F0), (6, None, 0x55555555, 0x33333333), (7, None, 0x3C3C3C3C, 0x55555555)]
    hashes = spark.createDataFrame(far, "id long, scene int, high long, low long")
    monkeypatch.setattr(queries, "hashed", lambda spark, d: hashes)
    assert {(r.node, r.cluster) for r in queries.independence_clusters(spark, "").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 7)}
    for split in (queries.split_hash, queries.split_python):
        assert len({r.side for r in split(spark, "").collect() if r.node < 5}) == 1


def test_a_set_that_cannot_be_divided_is_refused_with_its_units(spark, monkeypatch):
    """Two scenes are divided; one near pair across them leaves one unit, which the query refuses; so it does where a unit is too large for the target."""
    apart = [(1, 0, 0, 0), (2, 0, 0x0F0F0F0F, 0x0F0F0F0F), (3, 0, 0x33333333, 0x0F0FF0F0), (4, 1, 0xFFFFFFFF, 0xFFFFFFFF)]
    for rows_, refused in ((apart, None), ([*apart, (5, 1, 0, 1)], "independence units 1, images in the largest 5 of 5$")):
        hashes = spark.createDataFrame(rows_, "id long, scene int, high long, low long")
        monkeypatch.setattr(queries, "hashed", lambda spark, d, hashes=hashes: hashes)
        if refused:
            with pytest.raises(ValueError, match=refused):
                queries.split_python(spark, "")
        else:
            assert {(r.node, r.side) for r in queries.split_python(spark, "").collect()} == {(1, "train"), (2, "train"), (3, "train"), (4, "test")}
    uneven = spark.createDataFrame([(i, 1 if i < 10 else 10) for i in range(1, 11)], "node long, cluster long")
    with pytest.raises(ValueError, match="independence units 2, images in the largest 9 of 10$"):
        audit.split_python(uneven, ratio=0.05)
    with pytest.raises(ValueError, match="independence units 0, images in the largest 0 of 0$"):
        audit.split_python(uneven.limit(0))


VERDICTS = [
    ('{"answer":"yes"}', "yes", True, "json"), ('{"answer":"yes","reason":"extra"}', "yes", False, "json"), ('{"answer":"si"}', "yes", True, "json"), ("<think>long</think> La risposta è sì.", "yes", False, "word"),
    ("<think>maybe yes", "invalid", False, "truncated"), ("Non si vede alcuna luce accesa.", "invalid", False, "none"), ("There is no doubt that the answer is yes.", "invalid", False, "ambiguous"), ("sì", "yes", True, "word"),
    ("123", "invalid", False, "none"), ("", "invalid", False, "none"), (None, "invalid", False, "none"), ("**Yes.**", "yes", False, "word"), ('{"answer":"maybe"} no', "no", False, "word"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VERDICTS)], "id long, raw string")
    got = {r.id: (r.answer, r.parser) for r in text.parse_verdict(df).collect()}
    assert got == {i: (v[1], v[3]) for i, v in enumerate(VERDICTS)}
    valid = {r.id: r.format_valid for r in text.parse_verdict(df).collect()}
    assert [valid[i] for i in range(11)] == [v[2] for v in VERDICTS[:11]]


def test_small_functions(spark):
    one = spark.range(1)
    ev = lambda c: one.select(c.alias("x")).first().x
    assert [ev(stats.format_bytes(F.lit(n))) for n in (None, 0, 1023, 1024, 5_046_586_573, 3 * 1024**4)] == [None, "0 B", "1023 B", "1.0 KB", "4.7 GB", "3.0 TB"]
    assert ev(text.bar_text(F.lit(0.5), 5)) == "██░░░" and ev(text.slugify(F.lit("  Hé llo!! "))) == "h-llo" and ev(text.slugify(F.lit("!"))) == "evaluation"
    assert ev(stats.hamming(F.lit("ffffffffffffffff"), F.lit("ffffffffffffff00"))) == 8 and ev(stats.hamming(F.lit(""), F.lit(""))) == 64
    assert [ev(text.eta_text(F.lit(s))) for s in (0.5, 42.0, 130.0, 3720.0)] == ["almost done", "~42s", "~2 min", "~1h 02m"]
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert (ev(low), ev(high)) == (0.0, 0.0)
    bright = [float(x % 9) for x in range(72)]
    assert ev(text.difference_hash(F.array(*map(F.lit, bright)), 9, 8)) == "ff" * 8


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(i, str(i) if i else None) for i in range(50)], "x long, y string")
    f = lambda df: runs.fingerprint(df, ["y", "x"]).first().fingerprint
    assert f(a) == f(a.orderBy(F.desc("x")).repartition(7)) != f(a.filter("x < 49"))


def test_pending_grid(spark):
    images, variants = spark.createDataFrame([(1,), (2,)], "image_id long"), spark.createDataFrame([(10,)], "variant_id long")
    done = spark.createDataFrame([(1, 10, 0, "json"), (2, 10, 0, "error")], "image_id long, variant_id long, repetition int, parser string")
    left = runs.pending_units(runs.grid(images, variants, 1), done).collect()
    assert [(r.image_id, r.variant_id, r.repetition) for r in left] == [(2, 10, 0)]


def test_stress_variants_and_models(spark):
    raw = '<think>{}</think> ok {"variants":[{"axis":"Negation","text":" Not lit? "},{"axis":"negation","text":"not LIT?"},{"axis":"color","text":"x"},{"axis":"order","text":"is it lit?"},{"axis":"length","text":""},{"axis":"order","text":"Lit, is it?"}]} bye'
    got = text.stress_variants(spark.createDataFrame([(1, "Is it lit?", raw), (2, "q", "none"), (3, "q", None)], "id long, canonical string, raw string")).collect()
    assert [(r.id, r.axis, r.text, r.position) for r in sorted(got, key=lambda r: r.position)] == [(1, "negation", "Not lit?", 1), (1, "order", "Lit, is it?", 2)]
    models = spark.createDataFrame([("b", ["vision"]), ("A ", ["vision", "x"]), ("c", ["x"]), ("d", None), ("b", ["vision"])], "name string, capabilities array<string>")
    assert [r.name for r in text.discovered_models(models).collect()] == ["A", "b"]


def test_slugs_queue_and_files(spark):
    slugs = text.unique_slugs(spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, "a b!")], "id long, name string")).collect()
    assert {r.id: r.slug for r in slugs} == {1: "a-b", 2: "a-b-2", 3: "a-b-3"}
    labels = spark.createDataFrame([label(1, "Ann", "yes"), label(2, "bob", "no"), label(3, "ANN", "no", ruling=True)], LABEL)
    queue = runs.reviewer_queue(labels.select("image_id", "question_id").distinct(), labels, "ann").collect()
    assert [(r.question_id, r.next_image, r.remaining) for r in queue] == [(1, 2, 2)]
    manifest = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, sha256 string")
    files = spark.createDataFrame([("a", 5, "1", 3), ("b", 5, "2", 3), ("c", 5, "1", None)], "path string, length long, sha256 string, width int")
    assert {r.path: r.state for r in audit.inspect_files(manifest, files).collect()} == {"a": "ok", "b": "changed", "c": "unreadable", "d": "missing"}


def test_sequential_bootstrap(spark):
    data = [label(i, w, "yes" if (i + k) % 3 else "no") for i in range(12) for k, w in enumerate("ab")]
    df = spark.createDataFrame(data, LABEL)
    a, b = agreement.alpha_bootstrap_python(df, 60).first(), agreement.alpha_bootstrap(df, 60).first()
    alpha = agreement.coefficients(df).first().alpha
    assert a.units == b.units == 12 and a.low <= alpha <= a.high and b.low <= alpha <= b.high
    assert agreement.alpha_bootstrap_python(df.filter("image_id < 3"), 60).first().low is None


def _many_labels(spark, units):
    """Two or three labels a unit, some adjudications, images not in order of their rows."""
    df = spark.range(units).select(((F.col("id") * 7919) % units).alias("image_id"), (F.col("id") % 3).alias("question_id"), F.explode(F.array(*map(F.lit, "abc"))).alias("annotator"))
    kind = F.hash("image_id", "annotator") % 5
    df = df.filter("annotator != 'c' or image_id % 2 = 0").withColumn("value", F.when(kind < 0, "yes").when(kind < 2, "no").when(kind < 3, "uncertain").otherwise("exclude"))
    return df.withColumns({"is_adjudication": (F.col("annotator") == "c") & (F.col("image_id") % 7 == 0), "updated_at": F.lit(0.0), "note": F.lit("")})


def test_hashed_draws_equal_md5_one_by_one():
    for seed, reps, a, b, n in ((20260825, range(8, 12), 0, 1205, 1205), (20260825, range(99, 102), 99_990, 100_020, 147_236), (-3, range(1000, 1002), 999, 1001, 17), (10**60, range(2), 0, 12, 99), (1, range(799, 800), 10**10 - 9, 10**10 + 9, 10**10 + 9)):
        got = {r: [] for r in reps}
        for r, x in draws.hashed(seed, reps, a, b, n):
            got[r] += x.tolist()
        assert got == {r: [int(hashlib.md5(f"{seed}|{r}|{i}".encode()).hexdigest()[:15], 16) % n for i in range(a, b)] for r in reps}


def test_hash_bootstrap_makes_no_row_a_draw(spark, monkeypatch):
    df = _many_labels(spark, 3000)
    monkeypatch.setattr(agreement, "SPAN", 700)
    fast = agreement.alpha_bootstrap(df, 120)
    plan = fast._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Window" not in plan  # draws are neither listed nor joined
    a = fast.first()
    monkeypatch.setattr(agreement, "MOST_PACKED", 0)
    b = agreement.alpha_bootstrap(df.repartition(5), 120).first()
    assert (a.units, a.defined) == (b.units, b.defined) == (3000, 120) and a.low == pytest.approx(b.low, abs=1e-12) and a.high == pytest.approx(b.high, abs=1e-12)


def test_sequential_draws_equal_python_call_by_call(spark):
    for seed, n in ((1, 5), (20260825, 147_236), (42, 2**31 + 5), (3, 1), (3, 64)):
        rng = random.Random(seed)
        got = itertools.islice(itertools.chain.from_iterable(x.tolist() for x in draws.sequential(seed, n, 700)), 2000)
        assert list(got) == [rng.randrange(n) for _ in range(2000)]
    df = _many_labels(spark, 500)
    rows, rng, want = agreement.unit_values(df).orderBy("question_id", "image_id").collect(), random.Random(5), []
    for _ in range(40):
        some = [rows[rng.randrange(len(rows))] for _ in rows]
        total = sum(r.n for r in some)
        expected = (total**2 - sum(sum(r[v] for r in some) ** 2 for v in agreement.VALUES)) / (total - 1)
        want.append(1 - sum((r.n**2 - r.squares) / (r.n - 1) for r in some) / expected)
    want = sorted(want)
    at = lambda q: want[int(39 * q)] + (want[int(39 * q) + 1] - want[int(39 * q)]) * (39 * q % 1)
    got = agreement.alpha_bootstrap_python(df, 40, seed=5).first()
    assert (got.units, got.defined, got.low, got.high) == (500, 40, pytest.approx(at(0.025), abs=1e-12), pytest.approx(at(0.975), abs=1e-12))


def test_sequential_bootstrap_takes_more_than_a_million_units(spark):
    got = agreement.alpha_bootstrap_python(_many_labels(spark, 1_000_001), 3).first()
    assert (got.units, got.defined) == (1_000_001, 3) and got.low <= got.high


def test_registered_bootstraps_take_800_draws(spark, monkeypatch):
    data = [label(i, w, "yes" if (i + k) % 3 else "no") for i in range(12) for k, w in enumerate("ab")]
    monkeypatch.setattr(queries, "labels", lambda spark, d: spark.createDataFrame(data, LABEL))
    for query in (queries.alpha_bootstrap_hash, queries.alpha_bootstrap_python):
        assert 700 < query(spark, "").first().defined <= 800
