"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a stream of words and tags; only what can't be text (head, scripts, styles, media, form controls) is left
out of it. Each word scores ``WORD_SCORE``, each tag a negative weight, and a linear scan (the running sum, restarted
whenever it falls below zero) finds the contiguous region with the best score: the article.

A tag's weight is that of its name or of the words of its class, id and role, whichever is least. Weights are learned from
labelled pages: pages that mark their article (``<article>``, ``<main>`` or an ``articleBody`` property) say of their own
elements which lie inside it and which outside. Outside, only an outermost element counts, by its class words or else its
name, so a menu teaches about ``nav`` and not about lists and links. The weight is the log ratio of the pages that have
a name inside to those that have it outside, where the stated names of menus, notices, adverts and the like start with some
pages outside and all others with some inside (``STRONG_PAGES``, ``WEAK_PAGES``, ``TEXT_PAGES``). At most
``sample_pages`` pages, chosen by hash and no longer than ``sample_chars``, are learned from; every page is extracted whole.

An element of heavy weight is a hole when its words don't outweigh its tags, each at that weight; otherwise it is content
like any other. Where a form or a class word is around the page's article (on pages that mark none: around over half of the
words), it is the page's layout and counts for nothing. A hole costs the scan half a word to cross (``HOLE``), whatever its
size, and one with text of the region before and after it is left out of the text. Holes elsewhere are left out by the
scan or not at all.

Blocks end at block elements and line breaks. Character references are decoded in each piece of text, white space inside a
block becomes one space, blocks are trimmed, empty blocks dropped and the rest joined by one newline. In tags, a quotation
mark opens a value only right after an equals sign.

Defined results: null, empty and tag-only pages have the empty text. A page without tags is its own text. Unclosed
elements end where their parent ends; an unclosed comment or script runs to the end of the page. Without labelled
pages the stated names alone decide. Repeated rows give repeated results, an empty table an empty one; other columns are
never read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SAMPLE_PAGES, SAMPLE_CHARS = 2_000, 200_000
WORD_SCORE = 1.0
#: Words for each unit of log ratio; the least weight; from which weight an element is heavy; the cost of a hole.
WORDS_A_UNIT, LEAST, HEAVY, HOLE = 8.0, -80.0, -5.0, 0.5
STRONG_PAGES, WEAK_PAGES, TEXT_PAGES = 1000.0, 2.0, 20.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>",
    re.DOTALL,
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))", re.IGNORECASE)
_WORDS_OF = re.compile(r"[a-z]+")
_RAW = frozenset("script style textarea title xmp noframes noscript iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What can't be text of a page, wherever it stands.
_NO_TEXT = frozenset(
    "head script style noscript template svg math canvas iframe object audio video button select option textarea title noframes xmp "
    "datalist".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the first ends open elements of the second, up to an element of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_STRONG_TAGS = frozenset("nav header footer aside form dialog menu".split())
_STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar masthead footer cookie cookies consent gdpr popup modal overlay comment comments disqus respond replies "
    "newsletter signup login pagination pager contentinfo complementary".split()
)
_WEAK_WORDS = frozenset(
    "header foot notice notices reply related recommended recommendations share sharing social subscribe subscription alert search "
    "form widget widgets toolbar tags byline copyright legal disclaimer dialog hidden".split()
)
#: Names that speak of the page's layout beside such a word ("has-sidebar") say nothing of the element.
_LAYOUT = frozenset("has no not with without".split())
_WHOLE = frozenset("html body article main".split())
_ARTICLE = frozenset("article main".split())
_PARTS = _STRONG_TAGS - {"form"}  # elements that are never a page's layout


@dataclass
class PageModel:
    """Weights by tag name and, with a dot before it, by word of class, id and role."""

    weights: dict[str, float] = field(default_factory=dict)

    def of(self, name: str) -> float:
        known = self.weights.get(name)
        return _weight(name, 0, 0) if known is None else known


def _weight(name: str, inside: float, outside: float) -> float:
    if name in _ARTICLE:
        return -20.0  # the border of what a page itself calls its article
    word = name[1:] if name[0] == "." else None
    strong = word in _STRONG_WORDS if word else name in _STRONG_TAGS
    weak = word in _WEAK_WORDS if word else False
    inside += 0.5 if strong or weak else TEXT_PAGES
    outside += STRONG_PAGES if strong else WEAK_PAGES if weak else 0.5
    ceiling = -0.5 if name == "a" else -0.2 if name in ("li", "ul", "ol", "div") else 0.0 if word else -0.05
    return max(LEAST, min(ceiling, WORDS_A_UNIT * math.log(inside / outside)))


def _marks(attrs: str) -> list[str]:
    """Words of class, id, role and the like, without names that speak of layout."""
    if "=" not in attrs:
        return []
    values = " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)).lower().split()
    found = [_WORDS_OF.findall(v) for v in values]
    return ["." + w for words in found if _LAYOUT.isdisjoint(words) for w in words]


@dataclass
class Page:
    """Tokens in page order: text, or a tag's name (None for text) with the element it opens or closes. Elements: name,
    marks, first token, token after the last, parent."""

    texts: list[str] = field(default_factory=list)
    tags: list[str | None] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    elements: list[list] = field(default_factory=list)


def parse(source: str) -> Page:
    page, stack, cut = Page(), [], []  # cut: open elements inside one that can't be text, that one first
    at, end = 0, len(source)

    def add(tag: str | None, text: str = "", element: int = -1) -> None:
        page.tags.append(tag)
        page.texts.append(text)
        page.of.append(element)

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            element = stack.pop()
            add(page.elements[element][0], "", element)
            page.elements[element][3] = len(page.tags)

    def open_place(names: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> int | None:
        for place in range(len(stack) - 1, -1, -1):
            if (name := page.elements[stack[place]][0]) in names:
                return place
            if name in stop:
                return None
        return None

    while at < end:
        m = _TOKEN.search(source, at)
        before = source[at : m.start() if m else end]
        if before and not cut:
            add(None, html.unescape(before))
        if m is None:
            break
        at = m.end()
        if m["cdata"] is not None and not cut:
            add(None, m["cdata"])
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if cut:
                if name in cut:
                    while cut.pop() != name:
                        pass
                elif name in _WHOLE:
                    cut.clear()
            if not cut and (place := open_place({name})) is not None:
                close(place)
            elif not cut and name in _BLOCKS:
                add(name)
            continue
        if name in _RAW:
            ending = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
            at = ending.end() if ending else end
            continue
        if name in _VOID:
            if not cut:
                add(name)
            continue
        if cut:
            if name == "body" and cut[0] == "head":
                cut.clear()
            else:
                if name in _NO_TEXT:
                    cut.append(name)
                continue
        if name in _NO_TEXT:
            if not m["attrs"].endswith("/"):
                cut.append(name)
            continue
        if name in _BLOCKS and (place := open_place({"p"}, {"button", "table", "td", "th"})) is not None:
            close(place)
        if name in _ENDS and (place := open_place(*_ENDS[name])) is not None:
            close(place)
        marks = _marks(m["attrs"]) if name not in _WHOLE or "articlebody" in m["attrs"].lower() else []
        page.elements.append([name, marks, len(page.tags), end, stack[-1] if stack else -1])
        stack.append(len(page.elements) - 1)
        add(name, "", stack[-1])
    close(0)
    return page


def _scores(page: Page, model: PageModel) -> tuple[list[float], list[tuple[int, int]]]:
    """The scan's score of each token, and the outermost holes."""
    words = [len(t.split()) if tag is None else 0 for t, tag in zip(page.texts, page.tags)]
    so_far = [0]
    for n in words:
        so_far.append(so_far[-1] + n)
    tags_so_far = [0]
    for tag in page.tags:
        tags_so_far.append(tags_so_far[-1] + (tag is not None))
    weights: list[float] = []
    holes: list[tuple[int, int]] = []
    articles = [first for name, _, first, _, _ in page.elements if name in _ARTICLE]
    for name, marks, first, after, _ in page.elements:
        own = min([model.of(name), *map(model.of, marks)])
        if own <= HEAVY and name not in _ARTICLE:
            held = so_far[after] - so_far[first]
            around = any(first < a < after for a in articles) if articles else 2 * held > so_far[-1]
            if name not in _PARTS and around or WORD_SCORE * held + own * (tags_so_far[after] - tags_so_far[first]) >= 0:
                own = model.of("div")
            elif not holes or first >= holes[-1][1]:
                holes.append((first, after))
        weights.append(own)
    scores = [
        WORD_SCORE * n if tag is None else weights[e] if e >= 0 else model.of(tag)
        for n, tag, e in zip(words, page.tags, page.of)
    ]
    for first, after in holes:
        scores[first:after] = [-HOLE] + [0.0] * (after - first - 1)
    return scores, holes


def region(scores: list[float]) -> tuple[int, int]:
    """Ends of the best-scoring run, by one scan; the first of equals."""
    best, best_start, best_end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_start, best_end = total, start, i + 1
    return best_start, best_end


def extract(source: str, model: PageModel) -> str:
    page = parse(source)
    scores, holes = _scores(page, model)
    start, end = region(scores)
    with_text = [i for i in range(start, end) if page.tags[i] is None and page.texts[i].strip()]
    blocks: list[list[str]] = [[]]
    inner = [h for h in holes if with_text and with_text[0] < h[0] and h[1] <= with_text[-1]]
    i, skipped = start, iter(inner)
    hole = next(skipped, None)
    while i < end:
        if hole and i == hole[0]:
            blocks.append([])
            i, hole = hole[1], next(skipped, None)
            continue
        if page.tags[i] is None:
            blocks[-1].append(page.texts[i])
        elif page.tags[i] in _BLOCKS:
            blocks.append([])
        i += 1
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def learn_counts(source: str) -> tuple[Counter, Counter] | None:
    """Names inside the marked article of a labelled page, and those of the outermost elements outside it, once each."""
    page = parse(source)
    marked = [e for e in page.elements if e[0] in _ARTICLE or ".articlebody" in e[1]]
    if not marked:
        return None
    article = max(marked, key=lambda e: (e[0] != "main", sum(len(t.split()) for t in page.texts[e[2] : e[3]])))
    inside, outside, done = Counter(), Counter(), 0
    for name, marks, first, after, _ in page.elements:
        if article[2] < first < article[3]:
            inside.update({name: 1} | dict.fromkeys(marks, 1))
        elif first >= done and (after <= article[2] or first >= article[3]):
            outside.update(marks or [name])
            done = after
    return Counter(dict.fromkeys(inside, 1)), Counter(dict.fromkeys(outside, 1))


def fit(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS
) -> PageModel:
    """Weights from at most ``sample_pages`` labelled pages of at most ``sample_chars`` characters."""
    source = text_or_empty(html_col)
    labelled = F.lower(source).rlike(r"<article|<main|articlebody") & (F.length(source) <= sample_chars)
    # the chosen pages' ids and hashes are what the driver's sort and the broadcast hold: sample_pages rows
    ids = pages.where(labelled).select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample_pages)
    sample = pages.where(labelled).select(F.col(id_col).alias("id"), source.alias("html")).join(F.broadcast(ids), "id", "left_semi")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in rows:
            for page in batch.column(0).to_pylist():
                if counts := learn_counts(page):
                    inside.update(counts[0])
                    outside.update(counts[1])
        names = sorted(inside | outside)
        columns = [pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (inside, outside))]
        yield pa.RecordBatch.from_arrays(columns, names=["name", "n_in", "n_out"])

    counted = sample.select("html").mapInArrow(batches, "name string, n_in long, n_out long")
    rows = counted.groupBy("name").agg(F.sum("n_in").alias("a"), F.sum("n_out").alias("b")).collect()  # names of the sample
    return PageModel({r["name"]: _weight(r["name"], r["a"], r["b"]) for r in rows})


def main_text(
    pages: DataFrame, model: PageModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [extract(page.as_py(), model) for page in batch.column(2)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(batches, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
