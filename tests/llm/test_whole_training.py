"""Models and limits of the pipeline come from all documents, however many there are."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from test_corpus import prose

from tallyforge.llm import langid, secrets

EN, FR = "the and thing that with there", "été les dans où près cœur"


def _labelled(spark, tmp_path, n):
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice((FR if i % 2 else EN).split()) for _ in range(rng.randint(3, 9))), "fr" if i % 2 else "en") for i in range(n)]
    marks = list("!#$%&()*+,./:;<=>?@")
    ids = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    for c, i in zip(marks, ids[:: len(ids) // len(marks)], strict=False):
        rows[i] = (i, rows[i][1] + c, rows[i][2])
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    return spark.read.parquet(path), rows, marks


def test_languages_are_learned_from_all_documents(spark, tmp_path):
    df, rows, marks = _labelled(spark, tmp_path, 4000)
    model = langid.train(df)
    # each sign is in one document
    assert all(model.classes[ord(c)] for c in marks)
    grams = langid.counted(df)
    size = lambda keep: sum(len(t.encode()) for i, t, _ in rows if keep(zlib.crc32(str(i).encode()) % 4))
    assert {r.probe: r.n for r in grams.groupBy("probe").agg({"n": "sum"}).toDF("probe", "n").collect()} == {True: size(lambda f: f == 1), False: size(lambda f: f in (0, 3))}


def test_limits_come_from_all_probed_documents(spark, tmp_path):
    df, rows, _ = _labelled(spark, tmp_path, 4000)
    grams = langid.counted(df)
    model = langid.learned(grams.filter("not probe")).ready()
    probed = [(t.encode(), k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 == 1]
    sizes = model.lengths(np.frombuffer(b"".join(t for t, _ in probed), np.uint8), np.cumsum([0, *(len(t) for t, _ in probed)]))
    got = {r["__pred"]: r["__most"] for r in langid.limits(df, grams).collect()}
    for k, name in enumerate(model.langs):
        own = [x[k] / 1024 / len(t) for x, (t, lang) in zip(sizes, probed, strict=True) if lang == name and x.argmin() == k]
        middle, outer = np.percentile(own, [50, 100 * langid.OUTER])
        assert len(own) > 450 and abs(got[name] - (outer + langid.SPREAD * (outer - middle))) < 20 / langid.RATES


def test_long_texts_are_counted_in_pieces(spark, tmp_path, monkeypatch):
    text = prose(600, (EN + " " + FR).split())
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y", "x"], "text": [text, "ab", None], "probe": [False, False, True]})
    whole = Counter()
    for b in langid._counts([batch]):
        whole.update({(r["lang"], r["probe"], r["gram"]): r["n"] for r in b.to_pylist()})
    monkeypatch.setattr(langid, "CHUNK_BYTES", 100)
    monkeypatch.setattr(langid, "chunks", lambda texts, f=langid.chunks: f(texts, 100))
    pieces = Counter()
    for b in langid._counts([batch]):
        pieces.update({(r["lang"], r["probe"], r["gram"]): r["n"] for r in b.to_pylist()})
    assert pieces == whole and sum(whole.values()) == len(text.encode()) + 2


def test_secret_models_equal_counts_over_all_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(secrets, "SYNTHETIC", 0)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh0-Z/+=_.é ") for _ in range(rng.randint(1, 24)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 9))) + (f" token = {word()}xyzxyz" if i % 9 == 0 else "") for i in range(5000)]
    texts += [None, "", "ab", "a", "AKIA" + "Q7" * 9 + " deadbeef" * 3 + " " + "0123456789abcdef" * 2]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = secrets.train(spark.read.parquet(path))
    tokens = Counter()
    for t in (t or "" for t in texts):
        found = [m[2] for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6] + re.findall(secrets.ACCESS, t) + re.findall(secrets.HEX, t)
        tokens.update((True, x) for x in found)
        rest = re.sub(secrets.HEX, " ", re.sub(secrets.ACCESS, " ", re.sub(secrets.ASSIGN, " ", t)))
        words = [w for w in re.findall(secrets._TOKEN + "{2,}", rest) if len(w) < secrets.SHORTEST]
        tokens.update((False, x) for x in [*words, "_-/"[len(t) % 3].join(words)])
    pairs, single = Counter(), Counter()
    for (kind, token), n in tokens.items():
        if re.fullmatch(secrets._TOKEN + "+", token):
            for a, b in zip("\0" + token, token, strict=False):
                pairs[kind, ord(a), ord(b)] += n
                single[kind, ord(b)] += n
    alphabet = [ord(c) for c in secrets._ALPHABET]
    for a in [0, *alphabet]:
        for c in alphabet:
            log = {}
            for kind in (True, False):
                back = (single[kind, c] + 1) / (sum(single[kind, x] for x in alphabet) + len(alphabet))
                log[kind] = math.log((pairs[kind, a, c] + 8 * back) / (sum(pairs[kind, a, x] for x in alphabet) + 8))
            assert abs(got[a * 128 + c] - (log[True] - log[False])) < 1e-4, (chr(a), chr(c))
