r"""Main text of HTML pages by tag-path ratios.

A page becomes text segments, each with its root-to-leaf tag path.  Per path: characters of text outside links,
characters inside links, punctuation marks and segments.  The score of a path fuses text a segment and punctuation with the
share outside links, and is smoothed with its neighbours in page order unless most of its text is links.  What elements and
names say is a factor of the score: 0 for blocks that are no part of the article (navigation, header, footer, aside, form; a class or id
that is the name of a menu, advert, notice, sidebar or comment list), ``DOUBT`` where such a word is only part of a name that also has a word for
the article (``story-banner``), else 1; names such as ``has-sidebar`` or ``entry-header`` tell of the page or the article.  A path takes its least
factor.  It is content if it scores at least ``CUT`` of the page's median over text characters.

If the nearest ``article`` and ``main`` elements above content paths hold at least half of the content's text, the article is what stands in
them: every path below them with factor 1, headings, lists of links and short items included (but for blocks whose name says tags or links and that are mostly links), and doubtful ones that are content.  Else it is the content, and
weaker paths below its common ancestor with half their text or more outside links and a segment next to content in page order, as headings and short
list items have, and any ``h1``.

Pages are independent: one pass in Arrow batches, no shuffle; a page is read whole.

Defined cases: null and empty pages give empty text and n_chars 0; an unclosed element ends with its parent;
a page cut inside a tag loses that tag, one cut inside a character reference keeps it as text; unknown
references stay as they are; repeated rows get the same text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.2
SMOOTH = 0.25
DOUBT, LISTED = 0.5, 0.9

# Element and name lists.
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
_NEVER = frozenset(
    "head script style noscript template textarea title iframe object embed canvas svg math nav header footer aside form button select option input label fieldset legend menu dialog audio video map xmp noembed noframes".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
_ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("article aside body div footer form header main nav section table td th ul ol dl blockquote".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|menus?|nav\w*|breadcrumbs?|side-?bar|sidebar\w*|footer\w*|header|masthead|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|comment-\w+|disqus|respond|replies|pagination|pager|toolbar|widget|skip-link|copyright|legal|tracking)(?:$|[\s_-])",
    re.I,
)
# parts of a class name that tell of another block: what follows has-, no-, with- ...; states; an article's own header
_MODIFIER = re.compile(
    r"(?:^|[_-])(?:has|have|no|not|non|with|without|is|hide|show|use|supports)[_-].*|(?:^|[_-])(?:entry|post|article|content|story|section|page|title|main)[_-]+header(?=$|[_-])"
    r"|(?:^|[_-])(?:content|main)[_-]sidebar(?=$|[_-](?:wrap|layout))|(?:^|[_-])[a-z]+[_-](?:open|opened|closed|collapsed|expanded|enabled|disabled|layout|fixed|active)$",
    re.I,
)
# lists of links that belong to the page rather than to the text, if they hold nothing else
_LINKS = re.compile(r"^(?:(?:post|entry|article|story)[_-])?(?:tags?|links?|categor(?:y|ies)|topics|keywords)(?:[_-](?:list|links?|cloud))?$", re.I)
# a word for the article beside one of _NOISE leaves the block in doubt, but for what always stands apart from the text
_ARTICLE_WORD = re.compile(r"(?:^|[_-])(?:article|story|post|entry|review|feature|chapter|essay|lead|intro|summary|abstract|hero)(?:$|[_-])", re.I)
_APART = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adsense|comments?|comment-\w+|disqus|respond|replies|nav\w*|footer\w*|pagination|pager|share|sharing|social|related|recommend\w*|newsletter|subscribe|cookies?|consent|sidebar\w*)(?:$|[_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*["']?\s*([^\s"'>]+)""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？：；]")
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in _RAW}


def _factor(tag: str, attributes: str) -> float:
    """What an element and its names say: 0 no part of the article, ``DOUBT``, ``LISTED`` (tags or links, if it holds nothing else), or 1."""
    if tag in _NEVER:
        return 0.0
    if not attributes or tag in ("html", "body", "article", "main"):
        return 1.0
    least = 1.0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES:
            return 0.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0.0
        if name in ("class", "id"):
            for word in (_MODIFIER.sub("", x) for x in value.split()):
                if _NOISE.search(word):
                    if not _ARTICLE_WORD.search(word) or _APART.search(word):
                        return 0.0
                    least = DOUBT
                elif _LINKS.search(word):
                    least = min(least, LISTED)
    return least


#: The mark at the end of a path's step for each factor.
_MARK = {0.0: "!", DOUBT: "?", LISTED: "~", 1.0: ""}


def _least(path: tuple[str, ...]) -> float:
    marks = {step[-1] for step in path}
    return next((factor for factor, mark in _MARK.items() if mark in marks), 1.0)


def segments(page: str) -> list[tuple[tuple[str, ...], int, str, int]]:
    """(path, block number, text, characters in links) of each text segment, in page order."""
    out: list[tuple[tuple[str, ...], int, str, int]] = []
    stack: list[tuple[str, str]] = []  # tag, path step
    block, at, end = 0, 0, len(page)

    def emit(text: str) -> None:
        if text:
            path = tuple(step for t, step in stack if t not in _INLINE or step[-1] in "!?~")
            linked = len(text) if any(t == "a" for t, _ in stack) else 0
            out.append((path, block, text, linked))

    def drop(tags: tuple[str, ...] | frozenset) -> None:
        """Close the nearest open element of ``tags``, unless a scope lies between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in _SCOPE:
                return

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            emit(page[at:])
            break
        emit(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            emit(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in _INLINE:
            block += 1
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE or tag == "p" and stack[k][0] in _SCOPE:
                    break
            continue
        if tag in _ENDS_P:
            drop(("p",))
        if tag in _CLOSES:
            drop(_CLOSES[tag])
        if tag in _RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.start() if stop else end
            stack.append((tag, f"{tag}!"))
            continue
        if tag in _VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        # a class tells apart containers of the same tag
        named = _CLASS.search(m[3]) if m[3] and tag in ("div", "section", "td") else None
        step = f"{tag}.{named[1].lower()}" if named else tag
        stack.append((tag, step + _MARK[_factor(tag, m[3])]))
    return out


def path_ratios(found: list[tuple[tuple[str, ...], int, str, int]]) -> dict[tuple[str, ...], float]:
    """Fused and smoothed score of each tag path; paths with factor 0 have none and take no part in the others'."""
    total: dict[tuple[str, ...], list[float]] = {}
    order: list[tuple[str, ...]] = []
    smooth: dict[tuple[str, ...], float] = {}
    for path, _, text, linked in found:
        if not _least(path):
            continue
        if path not in total:
            total[path] = [0.0, 0.0, 0.0, 0.0]
            order.append(path)
        t = total[path]
        n = len(text.strip())
        t[0] += n
        t[1] += min(linked, n)
        t[2] += len(_PUNCTUATION.findall(text)) if not linked else 0
        t[3] += 1
    raw = [(t[0] - t[1]) / t[3] * (1 + t[2] / t[3]) * ((t[0] - t[1]) / t[0]) if t[0] else 0.0 for t in (total[p] for p in order)]
    for k, p in enumerate(order):
        near = [raw[j] for j in (k - 1, k + 1) if 0 <= j < len(raw)]
        smooth[p] = (1 - SMOOTH) * raw[k] + SMOOTH * (sum(near) / len(near)) if near and 2 * total[p][1] <= total[p][0] else raw[k]
        smooth[p] *= DOUBT if _least(p) == DOUBT else 1.0
    return smooth


def _common(paths: set[tuple[str, ...]]) -> tuple[str, ...]:
    """The longest path above all of ``paths``."""
    low, high = min(paths), max(paths)
    k = 0
    while k < min(len(low), len(high)) - 1 and low[k] == high[k]:
        k += 1
    return low[:k]


def _article(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path of the nearest article or main above, or none."""
    for k in range(len(path) - 1, -1, -1):
        if path[k] in ("article", "main"):
            return path[: k + 1]
    return ()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    # cut references at the very end stay as text: html.unescape leaves what it does not know
    every = segments(page)
    score = path_ratios([x for x in every if x[2].strip()])
    found = [x for x in every if x[2].strip() and x[0] in score]
    if not found:
        return ""
    typical = median([score[p] for p, _, text, _ in found for _ in range(1 + len(text) // 200)])
    content = {p for p in score if score[p] >= CUT * typical}
    size: dict[tuple[str, ...], list[int]] = {}
    for path, _, text, linked in found:
        t = size.setdefault(path, [0, 0])
        t[0] += len(text.strip())
        t[1] += min(linked, len(text.strip()))
    roots = {r for p in content for r in [_article(p)] if r}
    inside = sum(size[p][0] for p in content if any(p[: len(r)] == r for r in roots))
    if 2 * inside >= sum(size[p][0] for p in content) > 0:
        links = {p for p in score if 2 * size[p][1] > size[p][0]}
        plain = {p for p in score if _least(p) == 1.0 or _least(p) == LISTED and p not in links}
        content = {p for p in content | plain if any(p[: len(r)] == r for r in roots)}
    else:
        top = _common(content) if content else ()
        order, weak = [x[0] for x in found], set()
        for k, p in enumerate(order):
            if p not in content and 2 * size[p][1] <= size[p][0]:
                beside = any(q in content for q in order[max(k - 1, 0) : k + 2])
                if beside and p[: len(top)] == top or p and p[-1] == "h1":
                    weak.add(p)
        content |= weak
    blocks: list[list[str]] = []
    last = None
    # segments of one block are one line, even around inline elements
    for path, block, text, _ in every:
        if path not in content:
            continue
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    lines = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
