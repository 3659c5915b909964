import duckdb
import numpy as np
import pandas as pd

from lorespark.llm import urls

URLS = [
    "http://a.org/x", "https://EXAMPLE.org/es/1", "https://www.example.org/en/10?x=/es/", "https://example.org/en/2", "https://notexample.org/es/", "x.org/es",
    None, "", "http://", "http://org", "http://org/", "ftp://b.com/fr/#a", "ftp://b.com/de/", "http://b.com?/de/", "http://b.com#/fr/", "http://b.net/fr/", "a://b://c.org/", "http://É.org/é",
    "http://user@b.com:80/fr/", "http://b.com.:/fr/", "http://x.com/fr", "http://" + "a." * 300 + "org/" + "p" * 5000,
]


def test_matches_sql(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    pages = pd.DataFrame(rows, columns=["page_id", "url"])  # noqa: F841
    want = duckdb.sql(urls.SQL).fetchall()
    frame = spark.createDataFrame([(i, u, "h") for i, u in rows] + [(3, URLS[3], "h")], "page_id long, url string, host string")
    got = urls.judge(spark, frame, urls.RULES).collect()
    assert len(got) == len(rows) + 1
    assert {tuple(r) for r in got} == set(want)
    assert urls.judge(spark, frame.limit(0), urls.RULES).collect() == []


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "_keys", lambda strings: np.array([len(s) % 2 for s in strings], dtype=np.uint64))
    path = tmp_path / "x.sda"
    path.write_bytes(urls.build([("a.org/", "block"), ("b.org/", "allow"), ("c.org/x", "block"), ("c.org/x", "allow")]))
    array = urls.DigestArray(str(path))
    assert array.find(1, [b"a.org/", b"b.org/", b"c.org/x", b"d.org/"]) == [b"block", b"allow", b"allow", None]


def test_no_rules(tmp_path):
    path = tmp_path / "x.sda"
    path.write_bytes(urls.build([]))
    assert urls.match(urls.DigestArray(str(path)), ["http://a/b"]) == [("a", "/b", None, None)]


def test_large_array_and_hosts_beyond_ascii(tmp_path):
    """A hundred thousand rules, and upper-case letters that only Unicode lowers."""
    rules = [(f"H{k}.example.net/p{k % 7}", "block" if k % 2 else "allow") for k in range(100_000)] + [("ÉCOLE.fr/", "block")]
    path = tmp_path / "x.sda"
    path.write_bytes(urls.build(rules))
    asked = [f"http://www.h{k}.EXAMPLE.net/p{k % 7}/x" for k in range(0, 100_000, 997)] + ["http://ÉCOLE.FR/", "http://école.fr/", "http://h5.example.net/p6"]
    got = urls.match(urls.DigestArray(str(path)), asked)
    assert [g[3] for g in got] == ["block" if k % 2 else "allow" for k in range(0, 100_000, 997)] + ["block", None, None]
