"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block; what stands in menus, forms, notices and
the like, and blocks that are mostly links, count as lines without text. The text lengths
of each window of consecutive lines are summed: where the sum surges the main text
begins, where it dives to nothing it ends, and the lines between are kept.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_words = lambda s: frozenset(s.split())
BLOCKS = _words("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
SPACED = _words("br td th option img wbr")
#: Their content is text to the end tag, never markup.
RAW = _words("script style title textarea xmp noembed noframes iframe noscript template")
#: Elements that never hold main text.
DROPPED = _words("nav aside footer form script style title textarea noscript template iframe noembed noframes button select svg canvas audio video object dialog menu datalist xmp")
ROLES = _words("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status")
#: Parts of class and id names that mark what is not main text.
MARKS = _words("""ad ads adv advert adverts advertisement advertising adsense banner promo promos promotion sponsor sponsored sponsors nav navbar navigation
menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay
newsletter subscribe subscription signup comment comments disqus reply replies respond related recommended recommendations share sharing social toolbar
pagination pager login signin copyright disclaimer topbar""")
#: Names of page headers; an article's own has the title.
PAGE_HEADERS = _words("header site-header page-header main-header top-header global-header siteheader pageheader site_header page_header")
#: Of these, what also marks an article element: readers' comments and teasers are often articles of their own.
ARTICLE_MARKS = _words("ad ads advert comment comments reply replies related recommended sponsored promo")
#: Beside a mark these leave a name as it was; any other part makes it the name of something else.
NEUTRAL = _words("section box container wrapper block list area bar widget link links button buttons panel inner outer item items group slot unit top bottom left right posts articles stories content title head body icons media text js")
#: Blocks of text: what they are named after is seldom what they are, unless it is the whole name.
TEXTUAL = _words("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption table tbody thead tr td th")
_NEGATED = _words("has with no without hide show")
LANDMARKS = _words("article main header footer nav aside form")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: An end tag of one of these, or its like, is implied by these start tags.
_CLOSES = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option")}
_SCOPE = {"li": _words("ul ol menu"), "dt": _words("dl"), "dd": _words("dl"), "tr": _words("table"), "td": _words("tr table"), "th": _words("tr table"), "option": _words("select")}


def _named(value: str, marks: frozenset, whole: bool) -> bool:
    """Does a class or id name a mark? ``whole``: only if all parts of the name are marks or neutral."""
    for name in value.split():
        if name.lower() in PAGE_HEADERS:
            return True
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        if whole and not all(p in marks or p in NEUTRAL or p.isdigit() for p in parts):
            continue
        if any(p in marks and not (k and parts[k - 1] in _NEGATED) for k, p in enumerate(parts)):
            return True
    return False


def _drops(name: str, attributes: str, in_article: bool, whole: bool = False) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    marks = ARTICLE_MARKS if name == "article" else MARKS
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            if (name in BLOCKS or name == "td") and _named(value, marks, whole or in_article or name in TEXTUAL):  # an inline element's names are about its looks
                return True
        elif key == "role":
            if value.strip().lower() in ROLES and not (in_article and name == "header"):
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def lines_of(html: str, whole: bool = False) -> list[tuple[str, int, int]]:
    """``(text, weight, article)`` of each block in page order, with the number of the article or main element around it, or 0.

    Outside of articles a line of no text stands for a dropped element, and three stand
    between landmarks. Of an article's own header headings and whole sentences stay. With
    ``whole`` a name marks only if all of it is a mark, so that "social-policy" holds text.
    """
    lines: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped here, link
    buffer: list[str] = []
    linked = dropped = links = inside = heads = headings = articles = paragraphs = 0
    end = len(html)
    lowered = None

    def text(s: str) -> None:
        nonlocal linked
        if dropped:
            return
        buffer.append(s)
        if links:
            linked += len(s)

    def flush() -> None:
        nonlocal linked
        if buffer:
            whole = " ".join(unescape("".join(buffer)).split())
            if whole and (not heads or headings or whole.rstrip("\"'”’»)").endswith((".", "!", "?", "…", "。"))):
                lines.append((whole, 0 if linked * 5 >= len(whole) * 3 else len(whole), articles if inside else 0))
            buffer.clear()
        linked = 0

    def gap(n: int) -> None:
        lines.extend([("", 0, 0)] * (0 if inside else n))

    def close(k: int) -> None:
        nonlocal dropped, links, inside, heads, headings, paragraphs
        while len(stack) > k:
            name, drop, kind = stack.pop()
            if name in BLOCKS:
                flush()
            if drop:
                flush()
                dropped -= drop == 1 and 1
                if not dropped:
                    gap(1)
            links -= name == "a"
            paragraphs -= name == "p"
            headings -= name in HEADINGS
            if name in ("article", "main") and kind:
                inside -= 1
            heads -= name == "header" and kind
            if name in LANDMARKS and not dropped and not inside:
                gap(3)

    at = 0
    find = _TAG.search
    while at < end:
        m = find(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:  # end tag
            if name == "p" and not paragraphs:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break
            if name in BLOCKS:
                flush()
            continue
        attributes = m[3] if m[2] else m[6]
        if name in BLOCKS:
            flush()
            for k in range(len(stack) - 1 if paragraphs else -1, -1, -1):  # a paragraph ends where a block begins
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        elif name in SPACED:
            text(" ")
        if name in VOID:
            continue
        if name in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SCOPE[name]:
                    break
                if stack[k][0] in _CLOSES[name]:
                    close(k)
                    break
        drop = _drops(name, attributes, inside > 0, whole)
        if name in RAW:
            if lowered is None:
                lowered = html.lower() if len(html.lower()) == end else "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
            stop = lowered.find(f"</{name}", at)
            at = end if stop < 0 else stop
            if stop >= 0:
                stop = html.find(">", at)
                at = end if stop < 0 else stop + 1
            if name not in ("title",):
                text(" ")
            continue
        if name in ("article", "main") and not drop:
            flush()
            # What a name marks may still hold the article itself; what an element marks may not.
            if not any(x[1] and x[0] in DROPPED for x in stack):
                for k, x in enumerate(stack):
                    if x[1]:
                        stack[k] = (x[0], False, x[2])
                        dropped -= 1
            if not dropped and not inside:
                gap(3)
            if not dropped:
                articles += not inside
                inside += 1
            stack.append((name, False, not dropped))
            continue
        if name == "header" and not drop:
            if inside:
                heads += 1  # of an article's header only the headings stay
            else:
                drop = True
        if drop:
            flush()
            if not dropped and not inside:
                gap(1)
            dropped += 1
        elif name in LANDMARKS and not inside and not dropped:
            gap(3)
        elif name in ("div", "section", "table") and not inside and not dropped and stack and stack[-1][0] == "body":
            gap(3)
        links += name == "a"
        paragraphs += name == "p"
        headings += name in HEADINGS
        stack.append((name, drop, name == "header" and inside > 0 and not drop))
    close(0)
    flush()
    return lines


def main_lines(lines: list[tuple[str, int, int]], width: int = 3, surge: int = 86) -> list[str]:
    """Lines between each surge and dive of the text in windows of ``width`` lines.

    Where articles hold text, each is looked at alone and what is outside of them is not.
    Where the fullest window is below ``surge``, that window is the surge. Lines without
    weight that stand alone between two kept stretches, such as a list of links, stay too.
    """
    numbers = sorted({article for _, w, article in lines if w and article})
    if numbers:
        return [x for number in numbers for x in _stretches([line for line in lines if line[2] == number], width, surge)]
    return _stretches(lines, width, surge)


def _stretches(lines: list[tuple[str, int, int]], width: int, surge: int) -> list[str]:
    total = [0]
    for _, w, _ in lines:
        total.append(total[-1] + w)
    n = len(lines)
    windows = [total[min(n, i + width)] - total[i] for i in range(n)]
    surge = min(surge, max(windows, default=0))
    kept: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if not windows[i]:
            i += 1
            continue
        j = i
        while j < n and windows[j]:
            j += 1
        if max(windows[i:j]) >= surge:
            weighty = [m for m in range(i, min(n, j + width - 1)) if lines[m][1]]
            first, last = weighty[0], weighty[-1]
            if lines[first][2]:  # in an article, from where the last stretch ended
                first = i
            if kept and all(lines[m][0] for m in range(kept[-1][1] + 1, first)):
                first = kept.pop()[0]
            kept.append((first, last))
        i = j
    if kept and lines[kept[-1][1]][2]:
        kept[-1] = kept[-1][0], n - 1
    return [lines[m][0] for first, last in kept for m in range(first, last + 1) if lines[m][0]]


def surges(lines: list[tuple[str, int, int]], width: int = 3, surge: int = 86) -> bool:
    """Does any window of lines hold as much text as a surge?"""
    weights = [w for _, w, _ in lines]
    return any(sum(weights[i : i + width]) >= surge for i in range(len(weights)))


def main_text(html: str | None) -> str:
    """The kept lines of a page. Where nothing surges, what a part of a name marked is read as text, if it then does."""
    if not html:
        return ""
    lines = lines_of(html)
    if not surges(lines) and surges(again := lines_of(html, True)):
        lines = again
    return "\n\n".join(main_lines(lines))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    Null, empty and textless pages give an empty text. Repeated rows repeat, null ids and
    addresses stay null, other columns are ignored, an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(pages, run, "page_id long, url string, text string, n_chars long", "html")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    """extract() of the whole pages table."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
