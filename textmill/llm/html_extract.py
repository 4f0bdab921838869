"""Main text of web pages by the distribution of text over lines.

A page is taken apart into lines (blocks).  Lines inside menus, headers, footers, side bars,
notices, adverts, forms and comments are left out, and linked text weighs nothing but in headings.
Weights are summed over sliding windows of lines; a main passage begins where the sums surge above
a threshold and ends where they dive to nothing, and all lines from the first passage to the last
are kept.  If no window surges, the heaviest one is the passage.  Where a page marks its article,
every line of the article is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80  # characters in a window, where nothing marks the article

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_RAW = frozenset("script style template iframe svg canvas textarea title".split())
_DROP = frozenset("nav footer aside form header menu dialog button select fieldset head".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
_WORDS = (
    r"ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|"
    r"widget\w*|footer\w*|masthead|comment\w*|disqus\w*|replies|respond|cookie\w*|consent\w*|notice\w*|gdpr|"
    r"popup\w*|modal\w*|newsletter\w*|subscribe\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|"
    r"pagination|pager|toolbar|skip\w*|copyright|legal|disclaimer"
)
_BOILER = re.compile(rf"(?:^|[\s_-])(?:{_WORDS}|header)(?=$|[\s_-])", re.I)
# In an article: whole names, or qualified ones (reader-comments), of elements that hold others.
_BOILER_NAME = re.compile(rf"(?:^|\s)(?:[\w-]*[_-])?(?:{_WORDS})(?=$|\s)", re.I)
_BOILER_ID = re.compile(rf"\s*(?:{_WORDS})\s*", re.I)
_HOLDERS = frozenset("div section ul ol dl table".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag of the key closes an open element of these names.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SPACE = re.compile(r"[\s​]+")


class _Line:
    __slots__ = ("parts", "linked", "dropped", "article")

    def __init__(self, dropped: bool, article: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.dropped, self.article = dropped, article


def _boilerplate(name: str, attributes: str, article: bool = False) -> bool:
    if name in _DROP:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if article:
            if name in _HOLDERS and key == "class" and _BOILER_NAME.search(value):
                return True
            if name in _HOLDERS and name != "section" and key == "id" and _BOILER_ID.fullmatch(value):
                return True
        elif key in ("class", "id") and _BOILER.search(value):
            return True
        if key == "role" and value.lower() in _DROP_ROLES:
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "hidden":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))


def page_lines(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """Lines as ``(text, weight, dropped)``, and whether the page marks its article."""
    lines: list[_Line] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, in an article; each including what is around
    links = 0
    dropped = article = marked = False
    line = _Line(False, False)
    at, n = 0, len(page)

    def new_line() -> _Line:
        nonlocal line
        if line.parts:
            lines.append(line)
        line = _Line(dropped, article)
        return line

    def add(text: str) -> None:
        if text:
            line.parts.append(text)
            if links and not any(x[0] in _HEADINGS for x in stack):
                line.linked += len(_SPACE.sub("", text))

    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == "a":
                links = max(0, links - 1)
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in _BLOCK and name != "p" or name == "p":
                if depth is not None:
                    del stack[depth:]
                    dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    links = 0
                new_line()
            continue
        if name in _RAW:
            if _SELF_CLOSED.search(found[3]):
                continue
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            links += 1
            continue
        if name in _BLOCK or (name == "span" and _boilerplate(name, found[3], article)):
            closing = _CLOSES.get(name, ())
            while stack and (stack[-1][0] == "p" or stack[-1][0] in closing):
                stack.pop()
            dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if name not in _VOID and not found[3].rstrip().endswith("/"):
                inside = article or name in ("article", "main")
                marked = marked or (inside and not dropped)
                header = name == "header" and article  # an article's own header is judged by what it holds
                dropped = dropped or (not header and _boilerplate(name, found[3], article))
                article = inside
                stack.append((name, dropped, article))
                links = 0 if name != "span" else links
            new_line()
    new_line()
    out = []
    for x in lines:
        text = _SPACE.sub(" ", html.unescape("".join(x.parts))).strip(" ")
        if text:
            weight = 0 if x.dropped or (marked and not x.article) else max(0, len(text.replace(" ", "")) - x.linked)
            out.append((text, weight, x.dropped or (marked and not x.article)))
    return out, marked


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """Kept lines of a page, joined by an empty line."""
    lines, marked = page_lines(page)
    if marked:
        return "\n\n".join(t for t, _, gone in lines if not gone)
    weights = [w for _, w, _ in lines]
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    # Bare text without any element is no page and has no passage below the threshold.
    need = min(surge, max([1, *sums])) if _TOKEN.search(page) else surge
    kept = []
    i = 0
    while i < n:
        if sums[i] < need:
            i += 1
            continue
        # Surge: the first line of the window that has weight.  Dive: a window without weight.
        while not weights[i]:
            i += 1
        while i < n and sums[i] > 0:
            kept.append(i)
            i += 1
    between = lines[kept[0] : kept[-1] + 1] if kept else []
    return "\n\n".join(t for t, _, gone in between if not gone)


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    A null page is an empty page; a page without main text gives an empty text.  Every page is
    handled on its own, whole; repeated rows give repeated results.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    named = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html"))
    return named.mapInArrow(run, "page_id long, url string, text string, n_chars long")
