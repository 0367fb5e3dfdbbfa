"""Importance resampling against plain loops, with texts cut into chunks of a few bytes and whole."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import resampling

RNG = random.Random(17)


def grams(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target):
    """(doc_id, n_features, weight, score, rank) in the table's order."""
    bucket = lambda f: zlib.crc32(f) % 10000
    s = Counter(bucket(f) for _, t in rows for f in grams(t)[0])
    t = Counter(bucket(f) for x in target for f in grams(x)[0])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        fs, words = grams(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    order = sorted((i for i, r in enumerate(out) if r[4]), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    rank = {i: k + 1 for k, i in enumerate(order[: 5 * len(order) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def prose(n):
    return RNG.choice([" ", ", ", "\n"]).join(RNG.choice(["The", "of", "été", "x", "über", "word7", "QUITE", "long" * 30, "日本語" * 20, "a-b"]) + RNG.choice(["", "", "s", "2"]) for _ in range(n))


@pytest.mark.parametrize("limit", [1, 37, 300, 1 << 18])
def test_chunks_own_every_start_once(limit):
    for text in ["", " ", "one", " one two  three four ", prose(60), "x" * 1000, "-" * 9000 + "a b", "é" * 5000 + " " * 9000 + "z y x w"]:
        data = np.frombuffer(text.encode(), np.uint8)
        whole = np.array([len(data)])
        runs, words = resampling.features(data, np.array([0, len(data)]), whole)
        got, count = [Counter() for _ in runs], 0
        for start, stop, end in resampling.cut(data, limit):
            data[start:end].tobytes().decode()  # no character is cut
            found, n = resampling.features(data[start:end], np.array([0, end - start]), np.array([stop - start]))
            count += int(n[0])
            for k, (bucket, _) in enumerate(found):
                got[k].update(bucket.tolist())
        assert count == words.sum() and got == [Counter(b.tolist()) for b, _ in runs]
        assert sum(len(b) for b, _ in runs) == len(grams(text)[0])


@pytest.mark.parametrize("limit", [200, 1 << 18])
def test_resampling_matches_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(resampling, "CHUNK", limit)
    texts = [None, "", " -- ", "word", prose(19), prose(20), prose(4000)] + [prose(RNG.randint(1, 120)) for _ in range(120)]
    texts += [texts[5]] * 4
    rows = [(None if i in (1, 30, 31) else 40 if i in (40, 41) else i, t) for i, t in enumerate(texts)]
    target = [None, "", prose(30), texts[9], "日本語 été"]
    spark.createDataFrame([(*r, "v", "v", "v", "v") for r in rows], "doc_id long, text string, rank string, weight string, owned string, own_id string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(rows, target)
    got = [tuple(r) for r in resampling.op11(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[4] is not None for r in want) >= 5
    documents = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = resampling.drawn(documents, spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if r[4])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert resampling.op11(spark, str(tmp_path)).collect() == []
    spark.createDataFrame([(1, prose(30))], "doc_id long, text string").write.parquet(str(tmp_path / "one" / "documents.parquet"))
    spark.createDataFrame([], "text string").write.parquet(str(tmp_path / "one" / "benchmark.parquet"))
    assert [tuple(r)[:1] + (r.rank,) for r in resampling.op11(spark, str(tmp_path / "one")).collect()] == [(1, None)]
