"""What leaves the engine: reports in Markdown and HTML, settings, bundles and the ledger as CSV.

A report is about one run, so its tables are small; ``run_report`` collects
them and everything after it is plain text work on the driver.
"""

from __future__ import annotations

import io
import json
import zipfile
from html import escape
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fragility_verdict
from ..operators import assembled, metrics
from ..plans.units import unit_table

# The columns of the exported ledger.
LEDGER = ("id", "name", "project", "provider", "model", "demo", "status", "archived", "completed", "total", "created", "started", "finished", "runtime_s", "error")
#: Fields of a run that no export holds.
SECRET = ("endpoint", "provider_endpoint")
MOST_CASES = 100


def run_report(rows: DataFrame, run: dict[str, Any], labels: DataFrame | None = None) -> dict[str, Any]:
    """A run's summary and tables as plain values: variants, paired comparisons, parsers, the first MOST_CASES fragile cases, reviewers."""
    own = rows.filter(F.col("run_id") == run["id"])
    units = unit_table(own)
    take = lambda df, *order: [r.asDict() for r in df.orderBy(*order).collect()]
    summary = assembled.run_summary_full(own).withColumn("verdict", fragility_verdict("pfs")).collect()
    return {
        "run": {k: v for k, v in run.items() if k not in SECRET},
        "summary": summary[0].asDict() if summary else {},
        "gate": (take(metrics.evidence_gate(own), "run_id") or [{}])[0],
        "variants": take(metrics.variant_summary(own), "question_id", F.desc("canonical"), "variant_id"),
        "comparisons": take(metrics.paired_comparisons(units), "question_id", "variant_id"),
        "parsers": take(metrics.parser_breakdown(own), "parser"),
        "fragile_cases": take(metrics.fragile_cases(units, MOST_CASES), F.desc("disagree"), "image_id", "question_id"),
        "reviewers": take(assembled.annotators_full(labels), F.desc("labels"), "annotator") if labels is not None else [],
        "agreement": take(assembled.question_intervals(labels), "question_id") if labels is not None else [],
    }


def _text(x: Any) -> str:
    return "—" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)


def _percent(x: float | None) -> str:
    return "—" if x is None else f"{100 * x:.1f}%"


def _sections(report: dict[str, Any]) -> list[tuple[str, list[str], list[list[str]]]]:
    """Title, header and rows of each table, the same for every format."""
    s, gate = report["summary"], report["gate"]
    if not s:
        return [("Summary", ["Measure", "Value"], [])]
    numbers = [
        ("Prompt fragility", f"{s['pfs']:.1f} of 100 ({s['verdict']})"), ("Accuracy", f"{_percent(s['accuracy'])} ({_percent(s['wilson_low'])} to {_percent(s['wilson_high'])})"),
        ("Always the commoner answer", f"{_percent(s['majority_baseline'])} ({s['majority_answer'] or '—'})"), ("Accuracy by scene", f"{_percent(s['scene_balanced_accuracy'])} over {s['independent_groups']} scenes"),
        ("Readable", _percent(s["coverage"])), ("In the asked format", _percent(s["format_rate"])), ("Read as strict JSON", f"{_percent(s['strict_share'])}, right {_percent(s['strict_accuracy'])}"),
        ("Drift between repetitions", f"{s['drift']:.1f} of 100, {s['tie_units']} ties"), ("Latency", f"median {s['median_ms']:.0f} ms, 95 % under {s['p95_ms']:.0f} ms"),
        ("Truth by two reviewers or more", _percent(s["verified_share"])), ("Open conflicts", str(s["conflict_cases"])), ("Inputs sent in another form", f"{s['normalised_inputs']} of {s['input_images']}"),
    ]
    checks = [[k.removeprefix("check_"), "yes" if v else "no"] for k, v in sorted(gate.items()) if k.startswith("check_")]
    variants = [[_text(v["question_id"]), _text(v["variant_id"]), _text(v["mutation_type"]), _percent(v["accuracy"]), _percent(v["balanced_accuracy"]), _percent(v["coverage"]), _percent(v["format_rate"]), f"{v['median_ms']:.0f} ms"] for v in report["variants"]]
    paired = [[_text(c["variant_id"]), _text(c["paired"]), _text(c["canonical_only"]), _text(c["alternative_only"]), f"{c['p_value']:.4g}"] for c in report["comparisons"]]
    parsers = [[p["parser"], _text(p["parsed"]), _percent(p["share"]), _percent(p["accuracy"]), f"{_percent(p['wilson_low'])} to {_percent(p['wilson_high'])}"] for p in report["parsers"]]
    cases = [[_text(c["image_id"]), _text(c["question_id"]), _text(c["disagree"]), c["answers"]] for c in report["fragile_cases"]]
    out = [
        ("Summary", ["Measure", "Value"], [list(x) for x in numbers]), (f"Evidence: grade {gate.get('grade', '—')}", ["Check", "Passed"], checks),
        ("Variants", ["Question", "Variant", "Kind", "Accuracy", "Balanced", "Readable", "Format", "Median"], variants), ("Against the canonical wording", ["Variant", "Pairs", "Canonical only", "Variant only", "p"], paired),
        ("How answers were read", ["Parser", "Answers", "Share", "Accuracy", "Interval"], parsers), ("Cases that change with the wording", ["Image", "Question", "Differing pairs", "Answers"], cases),
    ]
    if report["reviewers"]:
        out.append(("Reviewers", ["Reviewer", "Labels", "Yes share", "Rulings"], [[r["annotator"], _text(r["labels"]), _percent(r["positive_share"]), _text(r["adjudications"])] for r in report["reviewers"]]))
        out.append(("Agreement", ["Question", "Cases", "Alpha", "Interval", "Band"], [[_text(a["question_id"]), _text(a["units"]), _text(a["alpha"]), f"{_text(a['low'])} to {_text(a['high'])}", _text(a["band"])] for a in report["agreement"]]))
    return out


SCOPE = "Holds for this set, these wordings, this model and these settings only."
DEMO = "Synthetic answers: not the result of a model."


def markdown(report: dict[str, Any], fingerprint: str) -> str:
    """The report as Markdown; cells are escaped, an empty table says so."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\r", " ").replace("\n", " ").strip()
    lines = [f"# {cell(report['run'].get('name', ''))}", "", f"Fingerprint: `{fingerprint}`", ""]
    if report["run"].get("is_demo"):
        lines += [f"> {DEMO}", ""]
    for title, head, rows in _sections(report):
        lines += [f"## {title}", ""]
        lines += [f"| {' | '.join(head)} |", "|-" * len(head) + "|", *[f"| {' | '.join(map(cell, r))} |" for r in rows], ""] if rows else ["Nothing to show.", ""]
    return "\n".join([*lines, SCOPE, ""])


def html(report: dict[str, Any], fingerprint: str) -> str:
    """The report as one page without outside parts; the data are in it as JSON."""
    body = [f"<h1>{escape(str(report['run'].get('name', '')))}</h1><p>Fingerprint <code>{escape(fingerprint)}</code></p>"]
    if report["run"].get("is_demo"):
        body.append(f"<p class=demo>{DEMO}</p>")
    for title, head, rows in _sections(report):
        cells = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in rows)
        body.append(f"<h2>{escape(title)}</h2>" + ("<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr>{cells}</table>" if rows else "<p>Nothing to show.</p>"))
    data = json.dumps({**report, "fingerprint": fingerprint}, default=str, ensure_ascii=False).replace("</", "<\\/")
    style = "body{font:15px sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.demo{color:#a00}"
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(str(report["run"].get("name", "")))}</title><style>{style}</style>{"".join(body)}<p>{SCOPE}</p><script type="application/json" id="data">{data}</script></html>'


#: Settings that the manifest of an evaluation holds, with what stands in for a missing one.
SETTINGS: dict[str, Any] = {"question_ids": [], "split": "", "repetitions": 1, "temperature": 0.0, "seed": 0, "max_tokens": 128}


def settings_yaml(run: dict[str, Any], fingerprint: str) -> str:
    """The settings that repeat a run; every value is JSON, which YAML reads."""
    config = {**SETTINGS, **{k: v for k, v in (run.get("config") or {}).items() if k in SETTINGS and v is not None}}
    named = {"name": run.get("name", ""), "model": run.get("model", ""), "provider": run.get("provider", ""), "fingerprint": fingerprint, **config, "answers": ["yes", "no", "uncertain"]}
    return "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in named.items())


def bundle(report: dict[str, Any], fingerprint: str, **tables: list[dict[str, Any]]) -> bytes:
    """A zip of manifest.json, eval.yaml, report.html, report.md and README.txt; ``tables`` (labels, annotations, responses) go into the manifest. No pixels, no endpoint, no stored path."""
    hidden = {*SECRET, "stored_path"}
    clean = {name: [{k: v for k, v in row.items() if k not in hidden} for row in rows] for name, rows in tables.items()}
    files = {
        "manifest.json": json.dumps({"fingerprint": fingerprint, **report, **clean}, indent=1, sort_keys=True, default=str, ensure_ascii=False),
        "eval.yaml": settings_yaml(report["run"], fingerprint), "report.html": html(report, fingerprint), "report.md": markdown(report, fingerprint),
        "README.txt": "manifest.json holds every number, label and answer of the run; eval.yaml its settings. Images are not included.\n",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def ledger_rows(runs: DataFrame) -> DataFrame:
    """The ledger's columns as they are exported: yes or no, local time stamps, runtimes to one place, empty texts for nulls."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    stamp = lambda c: F.when(F.col(c) > 0, F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd HH:mm:ss")).otherwise("")
    return runs.select(
        "id", "name", "project", "provider", "model", yes(F.col("is_demo")).alias("demo"), "status", yes(F.col("archived_at").isNotNull()).alias("archived"), "completed", "total",
        stamp("created_at").alias("created"), stamp("started_at").alias("started"), stamp("finished_at").alias("finished"), F.round(F.coalesce("runtime_seconds", F.lit(0.0)), 1).alias("runtime_s"), F.coalesce("error", F.lit("")).alias("error"),
    )


def write_ledger(runs: DataFrame, path: str) -> None:
    """The whole ledger as CSV files with a header, written by the tasks."""
    ledger_rows(runs).write.option("header", "true").option("escape", '"').csv(path)


def ledger_csv(runs: DataFrame, limit: int = 300) -> bytes:
    """The newest ``limit`` runs as one CSV with a byte order mark, for spreadsheets."""
    import csv

    out = io.StringIO()
    sheet = csv.writer(out)
    sheet.writerow(LEDGER)
    for r in ledger_rows(runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)).collect():
        sheet.writerow(r)
    return out.getvalue().encode("utf-8-sig")
