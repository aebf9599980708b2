"""The entry module's contract, and a sample of queries against their oracles."""

from __future__ import annotations

import importlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables here")


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert "flagship_run_summary" in entry_module.queries()


@needs_data
def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.count() == 3 and "pfs" in df.columns


@needs_data
@pytest.mark.parametrize("name", ["variant_summary", "paired_mcnemar", "consensus", "agreement_coefficients", "provider_performance", "risk_patterns", "near_duplicates_20", "parse_verdict", "synthetic_answers"])
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = entry_module.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("missing", ["evalstrata.llm", "corpus_pipeline"])
def test_queries_without_an_optional_part(monkeypatch, missing):
    """A part that cannot be imported takes no other query with it."""
    real = importlib.import_module

    def without(name, *rest):
        if name.startswith(missing):
            raise ImportError(f"no {name}")
        return real(name, *rest)

    monkeypatch.setattr(entry_module.importlib, "import_module", without)
    with pytest.warns(UserWarning, match="left out"):
        names = set(entry_module.queries())
    assert "flagship_run_summary" in names and "pipeline" not in names
