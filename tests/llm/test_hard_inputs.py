"""Inputs made to break WARC headers, hashed counts and tag parsing."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from tallyforge.llm import html_text, quality, warc
from tallyforge.llm.common import Rolling, chunks, per_text, token_bounds

SEPARATORS = ["\r\n", "\r", "\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "\t", " ", "\xa0", "\r\n\r\n"]


def test_no_url_forges_a_header(spark, tmp_path):
    forged = "WARC-Type: revisit{0}Content-Length: 5{0}WARC-Payload-Digest: sha256:00{0}WARC-Record-ID: <urn:page:7:7>{0}"
    rows = [(i, "http://a" + s + forged.format(s), f"<p>page {i}</p>" * 12) for i, s in enumerate(SEPARATORS)]
    rows += [(50 + i, f"http://b/{s}WARC/1.1{s}x", f"short {i}") for i, s in enumerate(SEPARATORS)] + [(90, "Content-Length: 3", "whole payload"), (91, "ü% %20", "é")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    want = sorted((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response", None) for i, _, h in rows)
    assert sorted(map(tuple, warc.op10(spark, str(tmp_path)).collect())) == want


def test_payloads_that_look_like_headers(spark, tmp_path):
    lines = "Content-Length: 1\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\n"
    rows = [(i, "u", lines * i + " Content-Length: 4\x85" + "z" * i) for i in range(20)] + [(30, "u", "q" * 300), (31, "u", "q" * 300), (32, None, None)]
    # columns with the operator's own names
    table = spark.createDataFrame([(*r, "v", "v", "v") for r in rows], "page_id long, url string, html string, digest string, size string, head string")
    table.repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: tuple(r)[1:] for r in warc.op10(spark, str(tmp_path)).collect()}
    body = {i: (h or "").encode() for i, _, h in rows}
    assert got == {i: (len(b), hashlib.sha256(b).hexdigest(), "revisit" if i == 31 else "response", 30 if i == 31 else None) for i, b in body.items()}


def thue_morse(n, a, b):
    """Two strings of 2**n bytes that no polynomial hash modulo 2**64 with an odd base tells apart."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("pair", [thue_morse(10, "a", "b"), thue_morse(11, "x", "y")])
def test_different_texts_with_equal_hashes_are_different(pair):
    one, two = pair
    texts = ["\n".join(pair), "\n".join([one, two, one, one]), " ".join(["p q r s", one, "p q r s", two, "p"]), " ".join([one, "b c d e", one, "b c d e", two])]
    for text in texts:
        ((_, _, data, offs),) = chunks(pa.array([text]), 1 << 20)
        start, end = token_bounds(data, offs)
        rolling = Rolling(data)
        got = quality.base_counts(data, offs, rolling, start, end, rolling.span(start, end), per_text(start, offs))
        lines, words = text.split("\n"), text.split()
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        cover = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        assert (int(got["n_dup_lines"][0]), int(got["n_repeat_words"][0])) == (len(lines) - len(set(lines)), len(cover))


S = "This sentence is long enough, and has marks, to count as text of the page."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # a quote inside an unquoted value, or in a name, opens nothing
        (f"<article><h1>T</h1><p data-x=don't>{S}</p><p title='it>s'>{S}</p><p \"x>{S}</p></article>", f"T\n{S}\n{S}\n{S}"),
        (f"<article><h1>T</h1><p>{S}</p><p data-x = 'a \" b' y=\"c ' d>\">{S}</p></article>", f"T\n{S}\n{S}"),
        # a list of references is part of the article
        (f"<body><article><h1>T</h1><p>{S}</p><h2>References</h2><ul><li><a href=a>One paper</a></li><li><a href=b>Another one</a></li></ul></article></body>", f"T\n{S}\nReferences\nOne paper\nAnother one"),
        # headings above headings
        (f"<article><h1>T</h1><h2>U</h2><h3>V</h3><h4>W</h4><p>{S}</p><h2>X</h2><h3>Y</h3><p>{S}</p></article>", f"T\nU\nV\nW\n{S}\nX\nY\n{S}"),
        (f"<article><p>{S}</p><dl><dt>k</dt><dd>v</dd></dl></article>", f"{S}\nk\nv"),
        (f"<main><p>{S}</p><table><tr><td>1</td><td>2</td></tr></table><p>end</p></main>", f"{S}\n1\n2\nend"),
        # names that hold a word of other blocks, in the article
        (f"<article><p>{S}</p><div class='story-banner'><p>{S} {S}</p></div><div class='article-menu-review'><p>{S}</p></div><div class='ad'><p>{S}</p></div><div class=post-comments><p>{S}</p></div></article>", f"{S}\n{S} {S}\n{S}"),
        (f"<article><p>{S} {S}</p><div class=keywords>tea, rice</div><div class='post-tags'><a href=a>one</a> <a href=b>two</a></div><ul class=links><li><b>no</b> link</li></ul></article>", f"{S} {S}\ntea, rice\nno link"),
        # comments without a name beside the article
        (f"<body><article><h1>T</h1><p>{S}</p><p>{S}</p></article><div><p>I liked it, thanks.</p><p>Me too, {S}</p></div></body>", f"T\n{S}\n{S}"),
        # a teaser as an article, the text beside it
        (f"<body><article><p>Short teaser here.</p></article><div class=text>{''.join(f'<p>{S}</p>' for _ in range(6))}</div></body>", "\n".join(["Short teaser here."] + [S] * 6)),
    ],
)
def test_whole_article_stays(page, want):
    assert html_text.main_text(page) == want


def test_very_long_page_and_clashing_names(spark, tmp_path):
    body = f"<article><h1>T</h1>{''.join(f'<p>{S} {i}</p>' for i in range(20_000))}</article>"
    rows = [(1, "u", body), (1, "u", body), (None, None, None), (3, "u", ""), (4, "u", "<p" * 50_000), (5, "u", "<div>" * 20_000 + S), (6, "u", "&" * 100_000)]
    spark.createDataFrame([(*r, "v", 3, "v") for r in rows], "page_id long, url string, html string, text string, n_chars long, path string").write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(tuple(r) for r in html_text.op2(spark, str(tmp_path)).collect())
    want = "\n".join(["T"] + [f"{S} {i}" for i in range(20_000)])
    assert got == Counter([(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (3, "u", "", 0), (4, "u", "", 0), (5, "u", S, len(S)), (6, "u", "&" * 100_000, 100_000)])


def test_training_sample_is_bounded_by_whole_texts(spark, documents):
    from tallyforge.llm.sampling import labelled_sample

    texts = ["x" * RNG_SIZES[i % 4] for i in range(40)]
    df = documents([t + str(i) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    whole = {r.doc_id: r.text for r in labelled_sample(df, labels, "toxic", 100, 5, 0, 1 << 30).collect()}
    assert all(whole[i].startswith(texts[i]) for i in whole) and 20 < len(whole) < 40
    one = labelled_sample(df, labels, "toxic", 100, 5, 0, 1).collect()
    some = {r.doc_id: r.text for r in labelled_sample(df, labels, "toxic", 100, 5, 0, 3000).collect()}
    assert len(one) == 1 and 1 < len(some) < len(whole) and all(whole[i] == t for i, t in some.items())
    assert 3000 <= sum(map(len, some.values())) < 3000 + 1100


RNG_SIZES = (10, 1000, 0, 100)
