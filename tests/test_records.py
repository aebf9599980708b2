from __future__ import annotations

import random
from math import comb

import pytest
from pyspark.sql import functions as F

from evalstrata.functions import stats, text
from evalstrata.operators import arena, audit, records


def test_slugs_are_unique_and_numbered_until_free(spark):
    rng = random.Random(2)
    rows = [(1, "a"), (2, "a"), (3, "a-2"), (4, "A 2"), (5, "a-2-2"), (6, None), (7, "!!"), (8, "b"), (9, "b")]
    rows += [(10 + i, rng.choice(["x", "x-2", "x-3", "x-2-2", "y", "Y!"])) for i in range(60)]
    taken, want = set(), []
    for i, name in rows:
        base = {None: "evaluation", "!!": "evaluation", "A 2": "a-2", "Y!": "y"}.get(name, name)
        slug, k = base, 2
        while slug in taken:
            slug, k = f"{base}-{k}", k + 1
        taken.add(slug)
        want.append((i, slug))
    got = text.unique_slugs(spark.createDataFrame(rows, "id long, name string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == want and len({r.slug for r in got}) == len(rows)


def test_exact_mcnemar_of_few_and_very_many_pairs(spark):
    cases = [(0, 0), (3, 5), (0, 12), (40, 80), (1000, 1100), (1200, 1500), (2500, 2500)]
    df = spark.createDataFrame([*cases, (2_000_000_000, 2_000_000_000), (2_000_000_000, 2_000_200_000)], "b long, c long")
    got = [r.p for r in df.select(stats.exact_mcnemar_p("b", "c").alias("p")).collect()]
    for (b, c), p in zip(cases, got, strict=False):
        n, m = b + c, min(b, c)
        want = min(1.0, 2 * sum(comb(n, k) for k in range(m + 1)) / 2**n) if n else 1.0
        assert abs(p - want) < 1e-9 + 1e-7 * want
    assert got[-2] == 1.0 and abs(got[-1] - 0.00157) < 2e-4


def test_clusters_raise_when_rounds_are_not_enough(spark):
    chain = spark.range(40).selectExpr("id as a", "id + 1 as b")
    nodes = spark.range(41).select("id")
    assert audit.clusters(nodes, chain).select("cluster").distinct().count() == 1
    with pytest.raises(RuntimeError, match="did not settle"):
        audit.clusters(nodes, chain, rounds=1)


def test_runs_of_other_protocols_or_too_many_do_not_meet(spark):
    one = dict.fromkeys(arena.SIGNATURE, 1)
    rows = [{**one, "id": i, "status": "completed"} for i in range(3)] + [{**one, "max_tokens": 2, "id": 9, "status": "completed"}, {**one, "seed": 5, "id": 10, "status": "paused"}]
    rows += [{**one, "seed": 7, "id": 100 + i, "status": "completed"} for i in range(13)]
    got = arena.signature_groups(spark.createDataFrame(rows)).collect()
    assert [(r.runs, r.first_run, r.seed) for r in got] == [(3, 0, 1)]


def test_wide_rows_keep_responses_without_an_annotation(spark):
    responses = spark.createDataFrame([(1, 5, 10, 0, "yes"), (1, 6, 10, 0, "no"), (1, 5, 99, 0, "no"), (1, 77, 10, 0, "no")], "run_id int, image_id long, variant_id int, repetition int, answer string")
    variants = spark.createDataFrame([(10, 1, True, "canonical")], "id int, question_id int, canonical boolean, mutation_type string")
    images = spark.createDataFrame([(5, "s"), (6, "")], "id long, source_group string")
    annotations = spark.createDataFrame([(5, 1, "yes"), (6, 2, "no")], "image_id long, question_id int, value string")
    got = records.wide_rows(responses, variants, images, annotations).collect()
    assert sorted((r.image_id, r.answer, r.ground_truth or "") for r in got) == [(5, "yes", "yes"), (6, "no", "")]


def test_split_filter_refuses_an_empty_side(spark):
    images = spark.createDataFrame([(1, "train"), (2, "")], "id long, split string")
    grid = spark.createDataFrame([(1, 0), (2, 0)], "image_id long, repetition int")
    assert [r.image_id for r in records.split_filter(grid, images, "train").collect()] == [1] and records.split_filter(grid, images).count() == 2
    with pytest.raises(ValueError, match="test"):
        records.split_filter(grid, images, "test")
    sides = spark.createDataFrame([(2, "test")], "node long, side string")
    assert sorted((r.id, r.split) for r in records.assign_split(images, sides).collect()) == [(1, ""), (2, "test")]
    assert {r.split for r in records.clear_split(images).collect()} == {""}


def test_pairs_of_annotators_without_a_shared_case_are_kept(spark):
    labels = spark.createDataFrame([(1, 1, "a", "yes", False), (1, 1, "b", "no", False), (2, 1, "c", "yes", False)], "image_id long, question_id int, annotator string, value string, is_adjudication boolean")
    assert [(r.a, r.b, r.shared, r.agreed, r.observed) for r in records.annotator_pairs(labels).collect()] == [("a", "b", 1, 0, 0.0), ("a", "c", 0, 0, None), ("b", "c", 0, 0, None)]


def test_quantiles_by_counts_and_texts(spark):
    values = [1, 1, 2, 5, 9, 9, 9]
    counts = spark.createDataFrame([(v,) for v in values], "v int").groupBy("v").agg(F.count("*").alias("n"))
    r = records.quantiles(counts, "v", {"median": 0.5, "p95": 0.95, "p10": 0.1}).first()
    assert (r.median, round(r.p95, 6), round(r.p10, 6)) == (5.0, 9.0, 1.0)
    one = spark.range(1)
    got = one.select(records.percent(F.lit(0.123)).alias("a"), records.percent(F.lit(None).cast("double")).alias("b"), records.coefficient(F.lit(0.74321)).alias("c"), records.html_escape(F.lit("<a href='x'>&\"")).alias("d"), records.script_safe(F.lit("</script>")).alias("e")).first()
    assert tuple(got) == ("12.3%", "—", "0.743", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", "<\\/script>")


def test_image_features_of_a_small_picture(spark):
    rows = [(1, x, y, *((255, 255, 255) if (x + y) % 2 else (0, 0, 0))) for x in range(2) for y in range(2)] + [(2, 0, 0, 255, 0, 0)]
    got = {r.id: r for r in records.image_features(spark.createDataFrame(rows, "id long, x int, y int, r int, g int, b int")).collect()}
    assert [round(got[1][c], 9) for c in ("brightness", "contrast", "saturation", "edge_density")] == [0.5, 0.5, 0.0, 1.0]
    assert round(got[2].brightness, 4) == 0.2126 and got[2].saturation == 1.0 and got[2].edge_density == 0.0
