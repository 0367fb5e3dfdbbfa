"""URL filters against a plain loop over all rules."""

import random
import re

import pytest

from tallyforge.llm import url_filter

RNG = random.Random(13)
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LETTERS)
    fits = [(len(h + p), len(h), h + p, v == "block") for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], "block" if best and best[3] else "allow"


def some_urls():
    urls = [
        None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://xnet/", "http://.net/", "http://a.net?x=/", "http://a.net#/en/", "http://example.net/en", "http://example.net/en/",
        "https://WWW.Example.NET/en/a/b?c#d", "http://example.com/de/x", "http://example.com/DE/x", "http://example.com//de/", "http://a.org/fr/", "http://a.org/fr", "http://org/fr/://net/", "http://ÄB.net/é/",
        "http://user@a.net:80/", "http://a.net./", "http://a\nb.net/\nen/", "http://" + "a." * 3000 + "net/" + "x/" * 3000, "http://a.b.c/" + "y" * 100_000,
    ]
    parts = ["net", "example", "org", "com", "a", "b"]
    for _ in range(300):
        urls.append("http://" + ".".join(RNG.choice(parts) for _ in range(RNG.randint(1, 4))) + "".join(RNG.choice(["/", "/en", "/de", "/fr", "x"]) for _ in range(RNG.randint(0, 5))))
    return urls + urls[:5]


MORE = [("a.b", "/", "block"), ("b", "/en/d", "allow"), ("b", "/en/de/", "block"), ("b", "/en/de/", "allow"), ("", "/", "block"), ("com", "", "block"), ("a.com", "x", "allow"), (None, "/", "block"), ("org", None, "block"), ("example.org", "/", "block"), ("b", "/x", "block")]


@pytest.mark.parametrize(("rules", "most"), [(url_filter.RULES, 100_000), (list(url_filter.RULES) + MORE, 100_000), (list(url_filter.RULES) + MORE, 0), ([], 100_000)])
def test_verdicts_match_brute_force(spark, tmp_path, monkeypatch, rules, most):
    monkeypatch.setattr(url_filter, "BROADCAST", most)
    urls = some_urls()
    path = str(tmp_path / "pages.parquet")
    # columns named like the operator's own
    spark.createDataFrame([(i if i % 7 else None, u, "x", "y", i) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, n long").repartition(3).write.parquet(path)
    pages, table = spark.read.parquet(path), url_filter.rule_table(spark, rules)
    rows = url_filter.judged(pages, table).collect()
    want = [brute(u, rules) for u in urls]
    assert sorted(map(str, [tuple(r)[1:] for r in rows])) == sorted(map(str, want))
    kept = url_filter.allowed(pages, table)
    assert kept.columns == pages.columns
    assert sorted(r.n for r in kept.collect()) == [i for i, w in enumerate(want) if w[3] == "allow"]
    if rules is url_filter.RULES:
        got = url_filter.op13(spark, str(tmp_path)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((i if i % 7 else None, *w)) for i, w in enumerate(want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert url_filter.op13(spark, str(tmp_path)).collect() == []
