"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one for each stretch between edges of block elements. A line's length counts its text
without that of links (half of it in a paragraph), times the weight of its place. The lengths are summed over windows of
``window`` lines. A surge point is where the sum rises over a threshold, a dive point where it falls to it again; the text
between them is kept, but for lines of length zero. The threshold is ``least`` or, outside boilerplate, a quarter of the
page's largest sum if that is lower, so that short pages have their text. No line is lifted by neighbours of other
places: for the lines of a weight the sums run over lines of that weight.

Weights: 1 in general. In an element marked as the article (by its name, role or class) up to ``MARKED``, by the square
of its share of the page's text outside boilerplate, and the text of links counts by that share; small articles, such as
teasers, thus weigh about as much as any text. In boilerplate (elements such as nav, footer, aside or form, and elements
whose class, id or role says so by a whole word) ``BOILERPLATE``; headers inside an article are its own and aren't. An article inside an element that only its class, id or role calls
boilerplate isn't in boilerplate. An element marked as both is an article if it holds over half of the page's text, else
boilerplate. Boilerplate with over nine tenths of the text is a wrapper and ignored if no text outside it is in a marked
article.

Character references are decoded, white space inside a line becomes one space, lines are trimmed and joined in page order
by an empty line.

Defined cases: a null or empty page has the empty text, as one without text; unclosed, stray and badly nested tags are
followed as far as they go; very long pages and lines are whole; rows that repeat a page_id are pages of their own; null
ids and urls stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST, MARKED, BOILERPLATE = 3, 80, 32.0, 1 / 16
#: Fixed values of HTML: elements whose content is no text, elements that break lines, elements without an end tag.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option datalist textarea button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCK - {"body", "html", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}
BOILER = frozenset("nav footer aside form menu dialog header search".split())
SAYS_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adbox|adslot|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-?bar|comments?|disqus|respond|repl(?:y|ies)|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|login|breadcrumbs?|pagination|pager|menu|nav(?:bar|igation)?|topbar|toolbar|masthead|header|footer|related|recommend(?:ed|ations)?|shar(?:e|ing)|social|widgets?|tags?|toc|skip-?link|copyright|disclaimer|legal|contentinfo|complementary)(?:$|[\s_-]|\d)",
    re.I,
)
HEADS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
SAYS_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|post-?(?:body|content)|entry-?content|main-?content)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.I) for t in ("script", "style", "textarea", "title", "template", "noscript", "iframe")}


class _Line:
    __slots__ = ("parts", "plain", "place")

    def __init__(self, place: tuple):
        self.parts, self.plain, self.place = [], 0, place


def lines(page: str) -> list[tuple[str, int, tuple[tuple[int, ...], int, int]]]:
    """Text, length without links, and place: the open elements of boilerplate, the outermost open article and the
    innermost open element marked as both (0: none)."""
    out: list[_Line] = []
    stack: list[tuple[str, bool, tuple, tuple]] = []  # element, whether it hides, and the place before it
    hidden = links = count = 0
    place, by_name = ((), 0, 0), ()  # by_name: the open boilerplate by element name, not by class, id or role
    line = _Line(place)

    def cut() -> None:
        nonlocal line
        if line.parts:
            out.append(line)
        line = _Line(place)

    def text(raw: str) -> None:
        if raw and not hidden:
            line.parts.append(raw)
            if not links:
                line.plain += len(raw)
            elif any(e[0] == "p" for e in stack):
                line.plain += (len(raw) + 1) // 2

    def close(tag: str) -> None:
        nonlocal hidden, links, place, by_name
        while stack:
            name, h, place, by_name = stack.pop()
            hidden, links = hidden - h, links - (name == "a")
            if name == tag:
                break

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if tag == "br":
            text(" ")
            continue
        if m[1]:
            if any(e[0] == tag for e in stack):
                close(tag)
            if tag in BLOCK:
                cut()
            continue
        if tag in VOID:
            if tag in BLOCK:
                cut()
            continue
        if tag in _RAW and not m[3].rstrip().endswith("/"):
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "p" or tag in ENDS_P:  # a block ends an open paragraph
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in ("div", "article", "section", "td", "body", "main", "blockquote", "li")), None)
            if k is not None and stack[k][0] == "p":
                close("p")
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        said = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])}
        names = " ".join(said.get(k, "") for k in ("class", "id", "role", "itemprop")).strip()
        marked = tag in ("article", "main") or said.get("role", "").lower() in ("main", "article") or bool(names and SAYS_ARTICLE.search(names))
        away = tag in HIDDEN or "hidden" in re.sub(r"\"[^\"]*\"|'[^']*'", "", m[3]).lower().split() or said.get("aria-hidden", "").lower() == "true"
        own = place[1] > 0  # inside an article, whose headers are its own
        said_bad = bool(names and SAYS_BOILER.search(HEADS.sub(" ", names) if own else names))
        by_tag = tag in BOILER and not (own and tag == "header")
        bad = tag not in ("html", "body") and (by_tag or said_bad)
        stack.append((tag, away, place, by_name))
        hidden, links = hidden + away, links + (tag == "a")
        if bad or marked:
            count += 1
            boiler, article, both = place
            if marked:
                place = by_name, article or count, count if bad else 0
            else:
                place = (*boiler, count), article, both
            if by_tag:
                by_name = (*by_name, count)
        if tag in BLOCK or bad or marked:
            cut()
    cut()
    return [(" ".join(html.unescape("".join(x.parts)).split()), x.plain, x.place) for x in out]


def weighted(found: list[tuple]) -> list[tuple[float, float]]:
    """Weight and weighted length of each line."""
    plain = [min(n, len(t)) for t, n, _ in found]
    total = sum(plain)
    held: Counter = Counter()  # text by element
    for n, (_, _, (boiler, article, both)) in zip(plain, found):
        for e in {*boiler, article, both}:
            held[e] += n
    wraps = {e for e in held if 10 * held[e] > 9 * total}
    for n, (_, _, (boiler, article, _)) in zip(plain, found):
        if n and article:
            wraps.intersection_update(boiler)  # not those that the text of an article is outside of
    places = [(tuple(e for e in boiler if e not in wraps) + ((both,) if both and 2 * held[both] <= total else ()), article) for _, _, (boiler, article, both) in found]
    main = Counter()
    for n, (boiler, article) in zip(plain, places):
        if not boiler:
            main[article] += n
    out = []
    for n, (t, *_), (boiler, article) in zip(plain, found, places):
        share = main[article] / max(main.total(), 1) if article else 0.0
        weight = BOILERPLATE if boiler else 1 + (MARKED - 1) * share**2
        out.append((weight, weight * (n if boiler else n + (len(t) - n) * share)))
    return out


def main_text(page: str | None, window: int = WINDOW, least: int = LEAST) -> str:
    found = [x for x in lines(page or "") if x[0]]
    length = weighted(found)
    keep, sums = [False] * len(found), {}
    for level in {w for w, _ in length}:
        seen = [n if w == level else 0 for w, n in length]
        sums[level] = [sum(seen[k : k + window]) for k in range(len(seen))]
    highest = max((x for level, own in sums.items() if level != BOILERPLATE for x in own), default=0)
    for k, (level, n) in enumerate(length):
        # a line is between surge and dive if a window with it is over the threshold
        over = least if level == BOILERPLATE else min(least, highest / 4)
        keep[k] = n > 0 and max(sums[level][max(0, k - window + 1) : k + 1]) > over
    return "\n\n".join(t for (t, *_), k in zip(found, keep) if k)


ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window, least) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=ROWS)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
