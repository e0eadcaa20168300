"""Layout-aware rendering of HTML to text (operator 9)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import table

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = set("head script style template noscript iframe canvas audio video datalist title meta link base noembed noframes".split())
#: The text of these controls is their value.
WITH_VALUE = set("button email number reset search submit tel text url".split())
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section option optgroup select summary table tbody tfoot thead tr ul caption".split()
)
#: Blocks with an empty line around them.
APART = set("article blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre section table ul".split())
ENDS_P = BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr", "caption", "li", "dt", "dd"} | {"li", "dt", "dd"}
#: An opening tag closes these open elements first, up to the nearest one of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: A closing tag doesn't reach beyond these.
SCOPE = {"table", "td", "th", "caption", "html"}

#: A comment, a CDATA section, a declaration, or a tag. Each ends with the page at the latest, so no part of a page is read twice;
#: quotes count in a tag only after an equals sign, as in browsers.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(\w+)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Element:
    """An element of the tree; ``kids`` are elements and strings."""

    __slots__ = ("tag", "kids", "attrs", "lines")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.lines: list[str] = []  # of a table, when it is laid out

    def get(self, name: str) -> str | None:
        if name in self.attrs.lower():
            for key, value in ATTRIBUTE.findall(self.attrs):
                if key.lower() == name:
                    return html.unescape(value.strip("\"'"))
        return None


class Open:
    """The open elements, and where in their stack those of each tag are."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()

    def nearest(self, tags: set[str]) -> int:
        """The place of the innermost open element with one of the tags; 0 if there is none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def imply(self, ends: set[str], stop: set[str]) -> None:
        """Close the elements that an opening tag ends: the outermost in a row of these, below the nearest stop."""
        k = self.nearest(ends)
        if k == 0 or k < self.nearest(stop):
            return
        while k > 1 and self.stack[k - 1].tag in ends:
            k -= 1
        self.cut(k)

    def close(self, tag: str) -> None:
        k = self.nearest({tag})
        if k and (k >= self.nearest(SCOPE) or tag in ("table", "tr", "tbody", "thead", "tfoot", "body")):
            self.cut(k)


def tree(source: str) -> Element:
    """The element tree, with implied end tags; wrong end tags are ignored, open elements end with the page.

    A tag that doesn't end takes the rest of the page with it. Time is linear in the page, however broken.
    """
    root = Element("html")
    held = Open(root)
    at = 0
    n = len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            held.stack[-1].kids.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            held.stack[-1].kids.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            held.stack[-1].kids.append(m[1])
        if m[3] is None or not m[5]:
            continue
        tag = m[3].lower()
        if m[2]:
            held.close(tag)
            continue
        if tag in IMPLIED:
            held.imply(*IMPLIED[tag])
        if tag in ENDS_P:
            held.imply({"p"}, SCOPE | {"button"})
        if tag == "html":
            continue
        e = Element(tag, m[4])
        held.stack[-1].kids.append(e)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            inside = source[at : end.start() if end else n]
            e.kids.append(html.unescape(inside) if tag in ("textarea", "title") else inside)
            at = end.end() if end else n
        elif tag not in VOID:
            held.push(e)
    return root


def displayed(e: Element) -> bool:
    """Whether an element takes part in the layout; what is only hidden from assistive tools does."""
    if e.tag in HIDDEN or (e.tag == "dialog" and e.get("open") is None):
        return False
    return not e.attrs or e.get("hidden") is None and not NOT_SHOWN.search(e.get("style") or "")


def visibility(e: Element, inherited: bool) -> bool:
    found = VISIBILITY.findall((e.get("style") or "") if e.attrs else "")
    return inherited if not found else found[-1].lower() not in ("hidden", "collapse")


def shown_kids(e: Element) -> list:
    """All kids, but of a closed ``details`` its summary alone."""
    if e.tag != "details" or e.get("open") is not None:
        return e.kids
    return [kid for kid in e.kids if not isinstance(kid, str) and kid.tag == "summary"][:1]


class Page:
    """Lines of the rendered text: a blank is kept until text follows it, and so are line breaks."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.breaks = 0
        self.space = False
        self.begun = False
        self.prefix = ""

    def text(self, s: str, keep: bool = False) -> None:
        if keep:
            for k, part in enumerate(s.split("\n")):
                if k:
                    self.out.append("\n")
                if part:
                    self._put(part)
            return
        s = SPACES.sub(" ", s)
        if s[:1] == " ":
            self.space, s = True, s[1:]
        if s:
            end = s[-1] == " "
            self._put(s[:-1] if end else s)
            self.space = end

    def _put(self, s: str) -> None:
        if self.begun:
            if self.breaks:
                self.out.append("\n" * self.breaks)
            elif self.space:
                self.out.append(" ")
        if self.prefix:
            self.out.append(self.prefix)
            self.prefix = ""
        self.out.append(s)
        self.breaks, self.space, self.begun = 0, False, True

    def line(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False


def render(source: str | None) -> str:
    """All visible text of a page.

    Blocks start lines of their own and paragraphs, headings, lists and tables
    have an empty line around them; list items have a mark or a number and
    are indented by level. A table's cells stand in their columns, row and column spans
    counted, padded to the width of the column, two blanks between; a cell of
    several lines makes a row of several lines. Head rows come first and foot rows
    last, and what isn't in a row comes before them, as browsers show it. ``pre``
    keeps its blanks, without a line feed right after the tag. Options of a list,
    values of controls and alternatives of images are text. Visibility is inherited: what is
    visible within a hidden element is shown, but for tables within one. A
    closed ``details`` shows its summary. A null page is "".
    """
    page = Page()
    if source:
        root = tree(source)
        tables, todo = [], [root]
        while todo:
            e = todo.pop()
            if e.tag == "table":
                tables.append(e)
            todo.extend(kid for kid in e.kids if not isinstance(kid, str))
        for e in reversed(tables):  # those inside others first
            e.lines = _table(e)
        _render(root, page, 0)
    return "\n".join(x.rstrip() for x in "".join(page.out).split("\n"))


def _render(root: Element, page: Page, level: int, seen: bool = True) -> None:
    # a stack of our own: pages may nest as deep as they like
    todo: list[tuple] = [("open", root, level, False, seen)]
    counts: list[int | None] = []
    while todo:
        what, e, level, pre, seen = todo.pop()
        if what == "text":
            if seen:
                page.text(e, pre)
        elif what == "close":
            page.line(2 if e.tag in APART and not (e.tag in ("ul", "ol") and level) else 1)
            if e.tag in ("ul", "ol", "menu"):
                counts.pop()
            if e.tag == "li":
                page.prefix = ""
        elif displayed(e):
            around, seen = seen, visibility(e, seen)
            if e.tag == "br":
                page.line(page.breaks + 1 if page.breaks < 2 else 2)
                continue
            if e.tag in ("img", "input", "optgroup"):
                page.text(_own_text(e) if seen else "")
                if e.tag != "optgroup":
                    continue
            if e.tag == "table":
                page.line(2)
                for k, row in enumerate(e.lines if around else []):
                    page.line(1 if k else 2)
                    page.text(row, True)
                page.line(2)
                continue
            if e.tag in BLOCK:
                page.line(2 if e.tag in APART and not (e.tag in ("ul", "ol") and level) else 1)
                todo.append(("close", e, level, pre, seen))
            inner = level
            if e.tag in ("ul", "ol", "menu"):
                start = e.get("start") or "1"
                counts.append(int(start) if e.tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if e.tag == "ol" else None)
                inner = level + 1
            elif e.tag == "li":
                mark = "-"
                if counts and counts[-1] is not None:
                    mark = f"{counts[-1]}."
                    counts[-1] += 1
                page.prefix = "  " * max(level - 1, 0) + mark + " " if seen else ""
            keep = pre or e.tag in ("pre", "textarea")
            kids = shown_kids(e)
            if e.tag in ("pre", "textarea") and kids and isinstance(kids[0], str):
                kids = [re.sub(r"^\r?\n", "", kids[0]), *kids[1:]]
            todo.extend(("text" if isinstance(kid, str) else "open", kid, inner, keep, seen) for kid in reversed(kids))


def _own_text(e: Element) -> str:
    """The text that an element shows by its attributes."""
    if e.tag == "img":
        return e.get("alt") or ""
    if e.tag == "optgroup":
        return e.get("label") or ""
    return (e.get("value") or e.get("placeholder") or "") if (e.get("type") or "text").lower() in WITH_VALUE else ""


PARTS = {"thead": 1, "tbody": 2, "tfoot": 3}


def _rows(e: Element) -> list[Element]:
    """The rows of a table as they are shown: what is in no row and captions, head, body, foot."""
    found: list[tuple[int, Element]] = []
    todo: list[tuple[int, object]] = [(2, kid) for kid in reversed(e.kids)]
    while todo:
        part, kid = todo.pop()
        if isinstance(kid, str):
            if not kid.strip():
                continue
        elif not displayed(kid):
            continue
        elif kid.tag in PARTS:
            todo.extend((PARTS[kid.tag], x) for x in reversed(kid.kids))
            continue
        elif kid.tag in ("tr", "caption"):
            found.append((part if kid.tag == "tr" else 0, kid))
            continue
        stray = Element("caption")
        stray.kids = [kid]
        found.append((-1, stray))
    return [row for _, row in sorted(found, key=lambda x: x[0])]


def _span(e: Element, name: str, most: int) -> int:
    n = e.get(name) or "1"
    return max(1, min(int(n), most)) if n.isascii() and n.isdecimal() else 1


def _table(e: Element) -> list[str]:
    """The lines of a table whose inner tables are laid out."""
    rows: list[dict[int, tuple[list[str], int]]] = []  # lines and width in columns, by column
    held: dict[int, int] = {}  # rows for which a column is taken from above
    for row in _rows(e):
        cells: dict[int, tuple[list[str], int]] = {}
        at = 0
        alone = row.tag == "caption"
        taken = {} if alone else {k: n - 1 for k, n in held.items() if n > 1}
        for kid in [row] if alone else row.kids:
            if isinstance(kid, str):
                if not kid.strip():
                    continue
                wide, high, lines = 1, 1, [SPACES.sub(" ", kid).strip()]
            elif not displayed(kid):
                continue
            else:
                page, inner = Page(), Element("div")
                inner.kids = kid.kids if kid.tag in ("td", "th", "caption") else [kid]
                seen = visibility(kid, visibility(row, visibility(e, True)))
                _render(inner, page, 0, seen)
                lines = [x.rstrip() for x in "".join(page.out).split("\n")]
                lines = [x for x in lines if x]
                wide, high = _span(kid, "colspan", MAX_COLSPAN), _span(kid, "rowspan", MAX_ROWSPAN)
            while not alone and at in held:
                at += 1
            cells[at] = lines, wide
            if high > 1 and not alone:
                taken.update({k: high for k in range(at, at + wide)})
            at += wide
        if not alone:
            held = {k: n for k, n in taken.items() if n > 1}
        if any(lines for lines, _ in cells.values()):
            rows.append(cells)
    widths: dict[int, int] = {}
    for over in (False, True):  # cells over several columns widen the last of these at need
        for cells in rows:
            for k, (lines, wide) in cells.items():
                if (wide > 1) == over and (k < max(cells) or len(cells) > 1):
                    rest = sum(widths.get(c, 0) + 2 for c in range(k, k + wide - 1))
                    widths[k + wide - 1] = max(widths.get(k + wide - 1, 0), *(len(x) - rest for x in lines), 0)
    out: list[str] = []
    for cells in rows:
        last = max(cells)
        for n in range(max(len(lines) for lines, _ in cells.values())):
            line, k = [], 0
            while k <= last:
                lines, wide = cells.get(k, ([], 1))
                text = lines[n] if n < len(lines) else ""
                line.append(text.ljust(sum(widths.get(c, 0) + 2 for c in range(k, k + wide)) - 2) if k < last else text)
                k += wide
            out.append("  ".join(line).rstrip())
    return out


def rendered(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the rendered text in place of the markup (a column ``text_col`` of theirs is replaced).

    Each page is rendered by itself, batch by batch, so memory is bounded by
    the largest page. Null and empty pages give an empty text; broken markup
    gives the text that can be seen. Repeated rows give equal texts.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(render)

    text = F.pandas_udf(run, "string")(F.coalesce(F.col(f"`{html_col}`"), F.lit("")))
    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (html_col, text_col)], text.alias(text_col))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "pages")).select("page_id", "url", "text")
