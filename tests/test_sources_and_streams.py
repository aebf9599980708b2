from __future__ import annotations

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evalstrata.operators import runs
from evalstrata.sources import readers, reports
from evalstrata.streaming import live


def png(w: int, h: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02"


def jpeg(w: int, h: int) -> bytes:
    return b"\xff\xd8\xff\xe0\x00\x10" + b"\0" * 14 + b"\xff\xc0\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" * 10


def test_image_headers():
    assert readers.size_of(png(36, 24)) == (36, 24) and readers.size_of(jpeg(640, 480)) == (640, 480)
    assert readers.size_of(b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little")) == (7, 9)
    assert readers.size_of(b"not an image") is None and readers.size_of(b"\xff\xd8\xff") is None


def test_import_statuses(spark, tmp_path):
    for name, data in {"a.png": png(1, 2), "b.PNG": png(1, 2), "c.jpg": b"nothing", "d.jpeg": jpeg(5, 5), "e.txt": b"x", "f.png": png(8, 8)}.items():
        (tmp_path / name).write_bytes(data)
    files = readers.image_files(spark, str(tmp_path))
    import hashlib

    old = spark.createDataFrame([(hashlib.sha256(jpeg(5, 5)).hexdigest(), 1.0)], "sha256 string, deleted_at double")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in readers.import_report(files, old).collect()}
    assert got == {"a.png": "imported", "b.PNG": "duplicate", "c.jpg": "rejected", "d.jpeg": "restored", "f.png": "imported"}
    counts = readers.import_counts(readers.import_report(files, old, most=5)).first()
    assert counts.asDict() == {"files": 5, "imported": 2, "restored": 1, "duplicate": 1, "rejected": 1}
    with pytest.raises(ValueError, match="more than 4 files"):
        readers.import_report(files, old, most=4)


def test_ground_truth_and_ledger(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"cases": [{"file": "1.png", "light": "yes", "night": "no"}]}))
    assert {tuple(r) for r in readers.ground_truth(spark, str(tmp_path / "t.json")).collect()} == {("1.png", "light", "yes"), ("1.png", "night", "no")}
    schema = "id long, name string, project string, provider string, model string, is_demo boolean, status string, archived_at double, completed long, total long, created_at double, started_at double, finished_at double, runtime_seconds double, error string"
    rows = [(1, 'a "b"', "p", "x", "m", True, "completed", None, 2, 2, 10.0, 0.0, None, 1.26, None), (2, "città, due", "p", "x", "m", False, "failed", 5.0, 0, 2, 86400.0, 86400.0, 86401.0, None, "lost")]
    runs = spark.createDataFrame(rows, schema)
    reports.write_ledger(runs, str(tmp_path / "csv"))
    got = {r.id: r for r in spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).collect()}
    assert got["1"].asDict() | {"error": None} == got["1"].asDict() and (got["1"].name, got["1"].runtime_s, got["1"].demo, got["1"].archived) == ('a "b"', "1.3", "yes", "no")
    assert tuple(got["1"].asDict()) == reports.LEDGER and got["2"].created == "1970-01-02 00:00:00"
    text = reports.ledger_csv(runs)
    lines = list(csv.reader(io.StringIO(text.decode("utf-8-sig"))))
    assert text.startswith(b"\xef\xbb\xbf") and tuple(lines[0]) == reports.LEDGER
    assert [x[0] for x in lines[1:]] == ["2", "1"] and lines[1][1] == "città, due" and lines[1][13:] == ["0.0", "lost"] and lines[2][11:13] == ["", ""]


def test_reports_and_bundle(spark):
    view_rows = [(1, 1, i, 10 + v, v == 0, "canonical" if v == 0 else "x|y", "yes" if (i + v) % 3 else "no", "yes" if i % 2 else "no", True, "json" if i % 4 else "word", 20.0 * i, "", "single", 1, "proxy" if i == 1 else "", r) for i in range(8) for v in range(2) for r in range(2)]
    schema = "run_id long, question_id long, image_id long, variant_id long, canonical boolean, mutation_type string, answer string, ground_truth string, format_valid boolean, parser string, latency_ms double, source_group string, gt_agreement string, gt_labels long, input_preprocess string, repetition long"
    rows = spark.createDataFrame(view_rows, schema)
    labels = spark.createDataFrame([(i, 1, a, "yes" if i % 2 else "no", False, 1.0, "") for i in range(6) for a in ("ann", "b<b>")], "image_id long, question_id long, annotator string, value string, is_adjudication boolean, updated_at double, note string")
    run = {"id": 1, "name": "a </script> | b", "endpoint": "http://secret", "is_demo": True, "config": {"seed": 7, "question_ids": [1], "timeout": 5}}
    report = reports.run_report(rows, run, labels)
    assert report["summary"]["samples"] == 32 and report["summary"]["normalised_inputs"] == 1 and len(report["variants"]) == 2 and report["agreement"][0]["alpha"] == 1.0
    page, text = reports.html(report, "f00d"), reports.markdown(report, "f00d")
    assert page.count("</script>") == 1 and "secret" not in page + text and "b&lt;b&gt;" in page and "x\\|y" in text and "# a </script> \\| b" in text and reports.DEMO in text
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    assert data["run"]["name"] == run["name"] and data["fingerprint"] == "f00d"
    z = zipfile.ZipFile(io.BytesIO(reports.bundle(report, "f00d", labels=[{"annotator": "ann", "stored_path": "/x"}])))
    assert sorted(z.namelist()) == ["README.txt", "eval.yaml", "manifest.json", "report.html", "report.md"] and not any(b"secret" in z.read(n) for n in z.namelist())
    assert json.loads(z.read("manifest.json"))["labels"] == [{"annotator": "ann"}]
    settings = dict(line.split(": ", 1) for line in z.read("eval.yaml").decode().splitlines())
    assert settings["seed"] == "7" and settings["repetitions"] == "1" and "timeout" not in settings
    empty = reports.run_report(rows.limit(0), run)
    assert empty["summary"] == {} and "Nothing to show." in reports.markdown(empty, "") and "Nothing to show." in reports.html(empty, "")


def test_streams(spark, tmp_path):
    rows = [(1, 1, 1, 1, 0, "yes", True, "json", None, 1.0), (1, 1, 1, 1, 1, "no", True, "json", None, 2.0), (1, 1, 1, 1, 1, "yes", True, "json", None, 3.0)]
    schema = "run_id long, question_id long, image_id long, variant_id long, repetition int, answer string, format_valid boolean, parser string, error string, created_at double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("v_votes", live.votes(source)), ("v_last", live.last_write(source))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    v = spark.table("v_votes").first()
    assert (v.y, v.n) == (2, 1) and live.drift_of(spark.table("v_votes")).first().disagreeing == 2
    assert {r.repetition: r.answer for r in spark.table("v_last").collect()} == {0: "yes", 1: "yes"}
    pending = spark.createDataFrame([(1, 1, 0), (1, 1, 5)], "image_id long, variant_id long, repetition int")
    assert [r.repetition for r in live.resume(pending, spark.createDataFrame(rows, schema)).collect()] == [5]


def test_a_choice_of_variants_must_leave_some(spark):
    variants = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "question_id long, variant_id long")
    chosen = lambda *a: sorted(r.variant_id for r in runs.resolve_variants(variants, *a).collect())
    assert chosen([1]) == [10, 11] and chosen([1, 2], [11, 20]) == [11, 20]
    for none in (([3],), ([1], [20])):
        with pytest.raises(ValueError, match="no variant"):
            runs.resolve_variants(variants, *none)


def test_windows_and_changed_consensus(spark):
    calls = spark.createDataFrame([(1, "json", 10.0, "2024-01-01 00:01:00"), (1, "error", None, "2024-01-01 00:02:00"), (1, "json", 30.0, "2024-01-01 00:12:00")], "provider_id long, parser string, latency_ms double, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.total for r in live.provider_windows(calls).collect()) == [1, 2]
    labels = spark.createDataFrame([(1, 1, "a", "yes", False, 1.0, ""), (2, 1, "a", "no", False, 1.0, "")], "image_id long, question_id long, annotator string, value string, is_adjudication boolean, updated_at double, note string")
    written = []
    live.consensus_of_changes(lambda: labels, lambda df: written.extend(df.collect()))(labels.filter("image_id = 2"), 0)
    assert [(r.image_id, r.value) for r in written] == [(2, "no")]
