from __future__ import annotations

import base64
import gzip
import hashlib
import time

import pytest

from evalstrata.llm import frames, url_filter, warc
from evalstrata.llm.registry import URL_RULES
from evalstrata.llm.url_filter import UrlRule

from . import cases

URLS = [
    None, "", "no scheme", "http://Example.COM/en/x", "https://www.example.com/en/", "https://www.example.com/de", "http://a.b.net/es/1?x=/fr/", "http://b.net/fr", "http://notcom/en/", "http://com", "http://x.com?y#z",
    "http://example.com#/en/", "ftp://net/es/", "http://net//es/", "http://xexample.com/en/", "http://u@example.com:80/en/", "a://b://c.com/", "http://É.com/en/a\nb?c", "http:///en/",
]


def brute(url: str | None, rules: list[UrlRule]) -> tuple:
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = cases.fold(rest[:cut]), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.text), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_filter_equals_brute_force(spark):
    rows = [(i % 15, u) for i, u in enumerate([*URLS, URLS[3], URLS[3]])]
    more = [*URL_RULES, UrlRule("block", "example.com", "/de/pre"), UrlRule("allow", "b.net", "/"), UrlRule("block", "b.net", "/"), UrlRule("block", "é.com".upper().lower(), "/en/a\nb")]
    for rules in (URL_RULES, more, []):
        got = url_filter.filter_urls(cases.frame(spark, rows, "page_id long, url string"), rules).collect()
        assert cases.ordered((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == cases.ordered((i, *brute(u, rules)) for i, u in rows)
    assert url_filter.filter_urls(cases.frame(spark, [], "page_id long, url string"), URL_RULES).collect() == []
    for wrong in (UrlRule("maybe", "com"), UrlRule("allow", "com", "en/")):
        with pytest.raises(ValueError):
            url_filter.build([wrong])


def test_a_url_costs_the_same_however_many_rules_its_host_has():
    rules = [UrlRule("block", "example.com", f"/x{k:06d}") for k in range(200_000)]
    root = url_filter.build(rules)
    began = time.process_time()
    for k in range(2000):
        assert url_filter.decide(root, "www.example.com", f"/x{k * 100:06d}/more").path == f"/x{k * 100:06d}"
        assert url_filter.decide(root, "www.example.com", "/y") is None
    assert time.process_time() - began < 1
    assert url_filter.decide(root, "example.com", "") is None


PAGES = [(5, "http://a/", "same"), (2, "http://b c\r\n/", "same"), (9, None, "same"), (1, "http://d/", None), (3, "http://e/", ""), (4, "http://f/", "é\r\n\r\nWARC/1.1\r\n" * 50), (7, "http://g/", "long " * 5000), (8, "http://h/", "long " * 5000), (-6, "http://i/", "x")]


@pytest.mark.parametrize("chunk,least,archive,broadcast", [(7, 0, 1 << 30, 500_000), (7, 0, 1 << 30, -1), (1 << 20, 0, 400, 500_000), (64, 5, 1 << 30, -1)])
def test_warc_round_trip(spark, monkeypatch, chunk, least, archive, broadcast):
    monkeypatch.setattr(frames, "BROADCAST_ROWS", broadcast)
    frame = cases.frame(spark, PAGES, "page_id long, url string, html string")
    index = warc.write(frame, chunk=chunk, least=least, archive_bytes=archive)
    chunks = warc.read(index, chunk)
    assert all(len(r.chunk) <= chunk for r in chunks.collect())
    got = {r.page_id: r for r in warc.records(chunks).collect()}
    first: dict = {}
    for i, _, h in sorted(PAGES):
        first.setdefault(h or "", i)
    for i, _, h in PAGES:
        data = (h or "").encode()
        other = first[h or ""] if len(data) >= least and first[h or ""] != i else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), digest, "revisit" if other is not None else "response", other)
    payloads: dict = {}
    for r in sorted(chunks.filter("record_type = 'response'").collect(), key=lambda r: (r.page_id, r.chunk_no)):
        payloads[r.page_id] = payloads.get(r.page_id, b"") + bytes(r.chunk)
    assert all(payloads[i] == (h or "").encode() for i, _, h in PAGES if i in payloads)
    for path in {r.path for r in index.collect()}:  # whole archives are plain gzipped WARC
        with gzip.open(path) as f:
            assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: re")


def test_warc_repeated_rows_null_ids_and_nothing(spark, monkeypatch):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "b"), (None, "u", "z")]
    rows += [(None, None, None), (None, "u", "b"), (0, "u", None)]
    want = [(0, "response", 0), *[(1, "response", 0)] * 3, (2, "revisit", 1), *[(-1, "response", 0)] * 3]
    for broadcast in (500_000, -1):
        monkeypatch.setattr(frames, "BROADCAST_ROWS", broadcast)
        got = warc.records(warc.read(warc.write(cases.frame(spark, rows, "page_id long, url string, html string")))).collect()
        assert sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to or 0) for r in got) == sorted(want)
        assert {r.payload_digest for r in got if r.page_id is None} == {base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (b"", b"b", b"z")}
    assert warc.records(warc.read(warc.write(cases.frame(spark, [], "page_id long, url string, html string")))).collect() == []
