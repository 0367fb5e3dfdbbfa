"""Learned operators, path ratios and the pipeline against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from statistics import median

import numpy as np
import pytest
from test_corpus import brute_contamination, brute_fingerprint, brute_secrets, prose, roots

from tallyforge.llm import common, html_text, langid, mixing, secrets, toxicity

RNG = random.Random(23)
MASK = 2**64 - 1
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def mixed64(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def word_hash(w):
    total = sum(int(common._BYTE[c]) * pow(common._BASE, j, 2**64) for j, c in enumerate(w))
    return mixed64((total + len(w) * 0x2545F4914F6CDD1D) & MASK)


def brute_features(text):
    words = [word_hash(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    out = {(h * 0x9E3779B97F4A7C15 & MASK) >> (64 - toxicity.BITS) for h in words}
    for step, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        for a, b in zip(words, words[step:], strict=False):
            out.add((mixed64(a * salt & MASK) + b * 0x9E3779B97F4A7C15 & MASK) >> (64 - toxicity.BITS))
    return out


def test_toxicity_equals_scalar_ftrl(spark, tmp_path):
    texts = [(prose(12) + (" you awful slug" if i % 3 == 0 else "")) for i in range(90)] + [None, "", "É é A-b"]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark.read.parquet(path), labels).collect()}
    rows = sorted((mixed64(i), int(i % 3 == 0), brute_features(texts[i])) for i in range(90) if zlib.crc32(str(i).encode()) % 5)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        l1 = 0.0 if k == "bias" else toxicity.L1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA)

    for _ in range(toxicity.EPOCHS):
        for _, label, at in rows:
            w = {k: weight(k) for k in [*at, "bias"]}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - label
            g *= toxicity.POSITIVE if label else 1
            for k in w:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA * w[k]
                n[k] += g * g
    for i, t in enumerate(texts):
        want = 1 / (1 + math.exp(-sum(weight(k) for k in [*brute_features(t), "bias"])))
        assert abs(got[i] - want) < 2e-3, (i, got[i], want)


def test_code_lengths_equal_scalar_prediction_by_partial_matching(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "LEAST", 6)
    kinds = {"en": "the and thing that with there 12", "fr": "été les dans où près cœur", "de": "und über nicht schön daß Ich"}
    rows = [(i, prose(RNG.randint(3, 14), kinds[k].split()), k) for i, k in enumerate(list(kinds) * 20)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    model = langid.train(spark.read.parquet(path))
    fold = lambda t: bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in t.encode())
    learned = [(fold(t), k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    seen = defaultdict(lambda: defaultdict(Counter))  # language, context, byte
    third = Counter()
    symbols = {c for t, _ in learned for c in t}
    for t, k in learned:
        padded = b"   " + t
        for j, c in enumerate(t):
            for order in range(4):
                seen[k][padded[j + 3 - order : j + 3]][c] += 1
            third[padded[j : j + 3]] += 1
    unseen = 256 - len(symbols)

    def predict(k, context):
        """Probabilities of each learned byte, and of all others together (None)."""
        if context is None:
            return {c: 1 / 256 for c in symbols} | {None: unseen / 256}
        lower = predict(k, context[1:] if context else None)
        n = seen[k].get(context)
        if not n:
            return lower
        rest = sum(p for c, p in lower.items() if c not in n)
        q = len(n) if rest > 0 else 0
        mass = sum(n.values()) + q
        return {c: n[c] / mass if c in n else p / rest * q / mass for c, p in lower.items()}

    texts = [rows[1][1], "THE été 99", "Привет", "", "und the"]
    data = b"".join(t.encode() for t in texts)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = model.ready().lengths(np.frombuffer(data, np.uint8), offs)
    for i, t in enumerate(texts):
        b = fold(t)
        padded = b"   " + b
        for k, name in enumerate(model.langs):
            want = 0
            for j, c in enumerate(b):
                # a byte that was never seen makes a context that was never seen
                context = padded[j : j + 3] if third[padded[j : j + 3]] >= 6 else padded[j + 1 : j + 3]
                while context and not set(context) <= symbols:
                    context = context[1:] if context[0] not in symbols or len(context) == 1 else context[1:]
                p = predict(name, context)
                want += round(-math.log(p[c if c in symbols else None]) * 1024) + (0 if c in symbols else round(math.log(unseen) * 1024))
            assert abs(int(got[i, k]) - want) <= len(b), (t, name)


class Plain(HTMLParser):
    """Text segments with path and block of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.block = [], [], 0

    def handle_starttag(self, tag, attrs):
        own = dict(attrs).get("class")
        if tag not in ("a", "b"):
            self.block += 1
        self.stack.append((tag, f"{tag}.{own}" if own and tag == "div" else tag))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.block += 1
        self.stack.pop()

    def handle_data(self, data):
        path = tuple(s for t, s in self.stack if t not in ("a", "b"))
        self.out.append((path, self.block, data, any(t == "a" for t, _ in self.stack), any(t in ("nav", "footer") or s == "div.ad" for t, s in self.stack)))


def brute_main_text(page):
    parser = Plain()
    parser.feed(page)
    rows = [x for x in parser.out if x[2].strip()]
    good = [x for x in rows if not x[4]]
    if not good:
        return ""
    order = list(dict.fromkeys(p for p, *_ in good))
    raw = {}
    for p in order:
        own = [(len(t.strip()), linked, t) for q, _, t, linked, _ in good if q == p]
        chars, plain = sum(n for n, _, _ in own), sum(n for n, linked, _ in own if not linked)
        marks = sum(len(re.findall(r"[.,;:!?]", t)) for _, linked, t in own if not linked)
        raw[p] = (plain / len(own) * (1 + marks / len(own)) * plain / chars, 2 * (chars - plain) <= chars)
    score = {}
    for k, p in enumerate(order):
        near = [raw[order[j]][0] for j in (k - 1, k + 1) if 0 <= j < len(order)]
        score[p] = 0.75 * raw[p][0] + 0.25 * sum(near) / len(near) if near and raw[p][1] else raw[p][0]
    typical = median(score[p] for p, _, t, *_ in good for _ in range(1 + len(t) // 200))
    chosen = {p for p in order if score[p] >= 0.2 * typical}
    # articles that hold half of the content are taken whole; else the content and what is weak beside it
    tops = {p[: max(j for j, s in enumerate(p) if s in ("article", "main")) + 1] for p in chosen if {"article", "main"} & set(p)}
    chars = lambda paths: sum(len(t.strip()) for p, _, t, *_ in good if p in paths)
    within = {p for p in order if any(p[: len(r)] == r for r in tops)}
    if chosen and 2 * chars(within & chosen) >= chars(chosen):
        chosen, weak = {p for p in within if p in chosen or "div.tags" not in p or raw[p][1]}, set()
    else:
        k = 0
        low, high = min(chosen, default=()), max(chosen, default=())
        while k < min(len(low), len(high)) - 1 and low[k] == high[k]:
            k += 1
        weak = set()
        for n, (p, *_) in enumerate(good):
            if p not in chosen and raw[p][1]:
                beside = any(q in chosen for q, *_ in good[max(n - 1, 0) : n + 2])
                if beside and p[:k] == low[:k] or p[-1] == "h1":
                    weak.add(p)
    lines = defaultdict(str)
    for p, block, t, *_ in parser.out:
        if p in chosen | weak and not any(s in ("nav", "footer", "div.ad") for s in p):
            lines[block] += t
    return "\n".join(x for x in (re.sub(r"\s+", " ", t).strip() for t in lines.values()) if x)


def random_page(rng):
    sentence = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet nulla".split()) for _ in range(rng.randint(2, 25))) + rng.choice([".", ", and.", "", "?"])
    link = lambda: f"<a href='x'>{rng.choice(['Home', 'More of it', 'Tags'])}</a>"

    def body():
        parts = [f"<h1>{sentence()[:20]}</h1>"]
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice([f"<p>{sentence()} <b>{sentence()}</b> {link()}</p>", f"<p>{sentence()} {sentence()}</p>", f"<ul><li>{sentence()}</li><li>{link()}</li></ul>", f"<div class='tags'>{link()} {link()}</div>", f"<div class='part'><p>{sentence()}</p></div>"]))
        return "".join(parts)

    inner = rng.choice([f"<article>{body()}</article>", f"<div class='story'>{body()}</div><div class='more'>{link()}</div>", body()])
    return f"<html><body><nav><ul><li>{link()}</li></ul></nav><div class='ad'>{sentence()}</div>{inner}<footer>{sentence()}</footer></body></html>"


def test_main_text_equals_plain_tag_path_ratios():
    rng = random.Random(4)
    for _ in range(300):
        page = random_page(rng)
        assert html_text.main_text(page) == brute_main_text(page), page


def test_main_text_depends_on_the_scores(monkeypatch):
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(60)]
    before = [html_text.main_text(p) for p in pages]
    noise = random.Random(1)
    monkeypatch.setattr(html_text, "path_ratios", lambda found: {x[0]: noise.random() for x in found})
    assert sum(html_text.main_text(p) != b for p, b in zip(pages, before, strict=True)) > 30


def redacted(text, spans):
    out, at, stop = [], 0, -1
    for a, b in sorted(spans):
        if a < stop:
            stop = max(stop, b)
            at = max(at, b)
            continue
        out += [text[at:a], "[SECRET]"]
        at = stop = b
    return "".join([*out, text[at:]]) if spans else text


def test_each_pipeline_stage_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    kinds = {"en": "the and thing that with there who", "fr": "été les dans où près cœur qui"}
    rows = [(i, prose(RNG.randint(20, 60), kinds[k].split()), k, RNG.choice(["a", "b", None]), 0) for i, k in enumerate(list(kinds) * 60)]
    items = [(1, rows[0][1]), (2, "un deux trois quatre")]
    rows += [(500, None, "en", "a", 0), (501, "1234 !!", None, "b", 0), (502, rows[4][1], None, "b", 0), (503, rows[5][1] + " x", "fr", "a", 0), (504, prose(45, kinds["en"].split()) + " password = hunter22hunter", "en", "a", 0)]
    rows += [(505, rows[7][1], "fr", "b", 0), (505, rows[7][1], "fr", "b", 0), (506, "".join(random.Random(1).choice("bcdfgjkmpqvwxz ") for _ in range(300)), None, "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after.append([tuple(r) for r in docs.collect()])
    key = lambda r: (r[0], r[1])
    assert sorted(map(key, after[0])) == sorted(map(key, [r for r in rows if r[0] not in (500, 501, 506)]))
    prints = [brute_fingerprint(r[1]) for r in after[0]]
    root = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    groups = defaultdict(list)
    for r, g in zip(after[0], root, strict=True):
        groups[g].append(r[0])
    assert sorted(r[0] for r in after[1]) == sorted(min(g) for g in groups.values())
    bad = [x[3] for x in brute_contamination([r[1] for r in after[1]], items)]
    assert any(bad) and sorted(r[0] for r in after[2]) == sorted(r[0] for r, b in zip(after[1], bad, strict=True) if not b)
    texts = {r[0]: r[1] for r in after[3]}
    third = spark.read.parquet(str(tmp_path / "stage2"))
    for r in secrets.scan(third, secrets.train(third)).collect():
        assert sorted((s.start, s.kind, s.stop) for s in [*r.assign, *r.access, *r.hex]) == brute_secrets(r.text)
        assert texts[r.doc_id] == redacted(r.text, [(s.start, s.stop) for s in r.spans])
    assert "[SECRET]" in texts[504] and len(after[3]) == len(after[2])
    # systematic sampling over the order of size, turn and id
    size = {r[0]: len(WORDS.findall(r[1])) for r in after[3]}
    sources = defaultdict(list)
    for r in after[3]:
        sources[r[3]].append(r[0])
    target = {s.source_size: s.target for s in mixing.mixture(docs_of(spark, tmp_path)).select("source_size", "target").distinct().collect()}
    want = Counter()
    for source, ids in sources.items():
        ids.sort(key=lambda i: (size[i], i % mixing.TURNS, i))
        whole = sum(size[i] for i in ids)
        rate = target[whole] / whole
        offset = int(hashlib.md5(b"mix:" + (source or "").encode()).hexdigest()[:8], 16) / 2**32
        for k, i in enumerate(ids, 1):
            want[i] += math.floor(offset + rate * k) - math.floor(offset + rate * (k - 1))
    assert Counter(r[0] for r in after[4]) == Counter({k: v for k, v in want.items() if v})


def docs_of(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "stage3"))


CLASHES = "score letter hex spans t assign access markov tokens llr cut clean copies copy copy_ h w hits places candidate n_hit items part size turn place before first target rank row root fp component_id node label held_out predicted lang_pred found wanted bytes".split()


@pytest.fixture
def odd(spark, tmp_path):
    """Nulls in any column, repeated and null ids, ties, empty and very long texts, clashing names."""
    long = " ".join(prose(2000) for _ in range(400))
    texts = [None, "", " ", "x", prose(40), prose(40), long, "password=abcdefgh " + prose(20), prose(30)]
    texts += [texts[4], texts[4], texts[8]]
    rows = [(None if i in (1, 5) else 3 if i in (9, 10) else i, t, None if i % 3 else "en", None if i % 2 else "s", None, *(["v"] * len(CLASHES))) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(30), "en", "s", 5, *(["v"] * len(CLASHES))) for i in range(30)]
    path = str(tmp_path / "odd.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3).write.parquet(path)
    spark.createDataFrame([(1, prose(30)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return spark.read.parquet(path), str(tmp_path)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, odd, k):
    import corpus_pipeline

    docs, folder = odd
    name, stage = corpus_pipeline.STAGES[k]
    for df, n in ((docs, 42), (docs.limit(0), 0)):
        if not n:
            df.write.parquet(folder + "/empty.parquet")
            df = spark.read.parquet(folder + "/empty.parquet")
        out = stage(spark, df, folder)
        rows = out.collect()
        assert out.columns == docs.columns + (["copy__"] if k == 4 else [])
        assert len(rows) <= 2 * n and (n == 0 or rows) and all(r["hits"] == "v" and r["spans"] == "v" for r in rows), name


def test_operators_on_odd_tables(spark, odd):
    from tallyforge.llm import decontaminate, quality, simhash, suffix_dedup

    docs, folder = odd
    labels = spark.createDataFrame([(None, None, None), (3, 1, 1), (3, 0, 0), (100, 1, 0), (101, None, 1)], "doc_id long, toxic int, quality int")
    benchmark = spark.read.parquet(folder + "/benchmark.parquet")
    results = [
        toxicity.toxicity(docs, labels), quality.quality(docs, labels), secrets.scan(docs, secrets.train(docs)), langid.identify(docs, langid.train(docs), ["doc_id"]), mixing.mixture(docs),
        decontaminate.contamination(docs, benchmark), simhash.near_duplicates(docs), suffix_dedup.dedup(docs),
    ]
    ids = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    for out in results:
        assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == ids
