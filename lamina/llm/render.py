"""HTML pages as the text a reader sees (operator 6).

A tokenizer and a tree builder with implied tags make a tree: an open paragraph ends before a block, list items,
table parts, options and terms end at the next of their kind, void elements have no content, and end tags without
an open element are ignored. Elements that are not shown (head, scripts, styles, templates, the hidden attribute, display:none,
visibility:hidden unless a part is made visible again, what closed details hide, what stands in for media) are left out; formulas, labels of drawings, options and
what is typed in text areas are shown. The rest is laid out: white space
collapses outside pre, blocks start on new lines with an empty line around paragraphs, headings, lists, tables and
quotes, list items have bullets or numbers and are indented, and table cells are padded to columns, spanned columns and rows included.

Time and output are linear in the page: it is scanned once, what is known not to come again is not looked for again, indents end at
``DEEPEST`` columns, and a table whose padding would exceed ``GROWTH`` times its text pads to ``WIDEST`` at most.

Edge cases: null pages give null, empty ones an empty text; text outside any tag is shown; unclosed comments and
tags at the end run to the end; a quote that is never closed does not hide the end of its tag; depth is not limited (no recursion); other columns pass through, and
a column named as the result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never shown.
UNSEEN = frozenset("head script style template noscript title datalist iframe audio video canvas defs desc metadata annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul tr td th thead tbody tfoot caption option optgroup text".split())
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: A start tag ends the first open element on the left, unless one on the right is open inside it.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: End tags do not reach out of these.
SCOPE = frozenset(["table", "td", "th", "caption", "html"])
_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_STOP = re.compile(r">|=[ \t\n\r\f]*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VEIL = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_GAP = re.compile(r"[ \t\n\r\f\v]+")
#: Columns of the deepest indent; padding of a table for each character of it, and what small tables may have; widest cell that is padded to in a table beyond that.
DEEPEST, GROWTH, FREE, WIDEST = 60, 8, 1 << 16, 60


def tokens(html: str):
    """("text", s), ("start", tag, attributes, closed) and ("end", tag), in one pass."""
    at, n = 0, len(html)
    absent: set[str] = set()

    def find(what: str, start: int) -> int:
        k = -1 if what in absent else html.find(what, start)
        if k < 0:
            absent.add(what)
        return k

    def tag_end(start: int) -> int:
        while (m := _STOP.search(html, start)) is not None:
            if m[1] is None:
                return m.start()
            k = find(m[1], m.end())
            if k < 0:  # the quote is never closed
                return find(">", m.end())
            start = k + 1
        return -1

    while at < n and (m := _OPEN.search(html, at)) is not None:
        if m.start() > at:
            yield "text", html[at : m.start()]
        if m[3] is None:
            k = find("-->", m.start() + 2) if m[1] else find(">", m.end())
            at = n if k < 0 else k + (3 if m[1] else 1)
            continue
        k = tag_end(m.end())
        if k < 0:
            return
        tag, at = m[3].lower(), k + 1
        if m[2]:
            yield "end", tag
            continue
        rest = html[m.end() : k]
        yield "start", tag, rest, rest.endswith("/")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else n
            if stop > at:
                yield "text", html[at:stop]
            at = stop
    if at < n:
        yield "text", html[at:]


def attributes(rest: str) -> dict:
    """Attributes of a start tag; the first of a name counts."""
    out: dict = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class Layout:
    """Lines of text with collapsing white space and margins."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.prefix: list[int] = []
        self.inset = 0
        self.bullet = ""

    def deeper(self, by: int) -> None:
        self.prefix.append(by)
        self.inset += by

    def back(self) -> None:
        self.inset -= self.prefix.pop()
        self.bullet = ""

    def put(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.split("\n")
            self._add(first)
            for x in more:
                self.end_line(True)
                self._add(x)
            return
        words = _GAP.sub(" ", text)
        if words == " ":
            self.space = True
            return
        if words[0] == " ":
            self.space, words = True, words[1:]
        after = words.endswith(" ")
        self._add(words[:-1] if after else words)
        self.space = after

    def _add(self, text: str) -> None:
        if not text:
            return
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line.append(" " * (min(self.inset, DEEPEST) - len(self.bullet)) + self.bullet)
            self.bullet = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def end_line(self, keep: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif keep and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


class Table:
    """Rows of (text, columns spanned, rows spanned)."""

    def __init__(self, outer: Layout):
        self.outer, self.rows = outer, []

    def placed(self) -> list[list[tuple]]:
        """Per row its cells as (column, lines, columns spanned); columns that a cell above spans are left free."""
        out, taken = [], {}
        for row in self.rows:
            at, cells, after = 0, [], {c: k - 1 for c, k in taken.items() if k > 1}
            for text, span, deep in row:
                while at in taken:
                    at += 1
                span = span if at < 10_000 else 1
                cells.append((at, text.split("\n"), span))
                if deep > 1:
                    after |= dict.fromkeys(range(at, at + span), deep - 1)
                at += span
            out.append(cells)
            taken = after
        return out

    def lines(self) -> list[str]:
        grid, width = self.placed(), {}
        for cells in grid:
            for at, lines, span in cells:
                if span == 1:
                    width[at] = max(width.get(at, 0), max(map(len, lines)))
        size = sum(len(text) for row in self.rows for text, _, _ in row)
        if len(grid) * sum(width.values()) > GROWTH * size + FREE:
            width = {c: min(w, WIDEST) for c, w in width.items()}
        offset, total = [], 0
        for c in range(max((at for cells in grid for at, _, _ in cells), default=-1) + 1):
            offset.append(total)
            total += width.get(c, 0) + 2
        out = []
        for cells in grid:
            for i in range(max((len(lines) for _, lines, _ in cells), default=0)):
                line = ""
                for at, lines, _ in cells:
                    if i < len(lines) and lines[i]:
                        line = max(line.ljust(offset[at]), line and line + "  ", key=len) + lines[i]
                out.append(line.rstrip())
        return [x for x in out if x]


def render(html: str) -> str:
    """The visible text of a page."""
    page = Layout()
    lay, stack = page, []  # open elements: (tag, hidden before, state to restore, veiled before)
    hidden, veiled, pre, tables = 0, False, 0, []
    opened: Counter = Counter()

    def close(down_to: int) -> None:
        nonlocal lay, hidden, veiled, pre
        while len(stack) > down_to:
            tag, was_hidden, state, veiled = stack.pop()
            opened[tag] -= 1
            unseen = hidden
            hidden = was_hidden
            if unseen:
                continue
            if tag in ("pre", "textarea"):
                pre -= 1
            if tag in ("td", "th") and state:
                table, span, deep, outer = state
                if table.rows:
                    table.rows[-1].append((lay.text(), span, deep))
                lay = outer
            elif tag == "table":
                table = tables.pop()
                lay = table.outer
                made = table.lines()
                if made:
                    lay.block(True)
                    for x in made:
                        lay._add(x)
                        lay.end_line()
                lay.block(True)
            else:
                if tag in ("li", "dd", "blockquote") and state:
                    lay.block(False)
                    lay.back()
                if tag in BLOCK and tag not in ("tr", "thead", "tbody", "tfoot"):
                    # a list inside a list has no empty line around it
                    lay.block(tag in SPACED and not (tag in ("ul", "ol") and (opened["ul"] or opened["ol"])))

    def last(tags, stop=frozenset()) -> int | None:
        if not any(opened[x] for x in tags):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                return None
        return None

    for t in tokens(html):
        kind = t[0]
        if kind == "text":
            if not (hidden or veiled):
                text = unescape(t[1]) if "&" in t[1] else t[1]
                if tables and lay is tables[-1].outer and not text.strip():
                    continue
                lay.put(text, pre > 0)
            continue
        tag = t[1]
        if kind == "end":
            if tag == "br":
                if not hidden:
                    lay.end_line(True)
            elif (i := last((tag,), SCOPE if tag not in SCOPE and tag not in ("tr", "tbody", "thead", "tfoot", "body") else frozenset() if tag in ("table", "html", "body") else frozenset(["table"]))) is not None:
                close(i)
            continue
        if tag in ENDS_P and (i := last(("p",), SCOPE | {"button"})) is not None:
            close(i)
        if tag in IMPLIED:
            closes, stop = IMPLIED[tag]
            if (i := last(closes, stop)) is not None:
                close(i)
        elif stack and stack[-1][0] == "head" and tag not in UNSEEN and tag not in VOID:
            close(len(stack) - 1)
        if tag == "tr" and (i := last(("td", "th", "tr"), frozenset(["table"]))) is not None:
            close(last(("tr",), frozenset(["table"])) if last(("tr",), frozenset(["table"])) is not None else i)
        if tag in VOID:
            if hidden:
                continue
            if tag == "br":
                lay.end_line(True)
            elif tag == "hr":
                lay.block(True)
            continue
        attrs = attributes(t[2]) if t[2] and not t[2].isspace() and not hidden else {}
        unseen = tag in UNSEEN or "hidden" in attrs or ("style" in attrs and _GONE.search(attrs["style"]) is not None) or (tag != "summary" and bool(stack) and stack[-1][0] == "details" and stack[-1][2] is False)
        was_veiled = veiled
        if "style" in attrs and (seen := _VEIL.findall(attrs["style"])):
            veiled = seen[-1].lower() != "visible"
        state = None
        if not (hidden or unseen):
            if tag in ("pre", "textarea"):
                pre += 1
            if tag == "table":
                tables.append(Table(lay))
                lay.end_line()
            elif tag == "tr":
                if tables:
                    tables[-1].rows.append([])
            elif tag in ("td", "th"):
                if tables:
                    if not tables[-1].rows or last(("tr",), frozenset(["table"])) is None:
                        tables[-1].rows.append([])
                    span, deep = (int(x) if re.fullmatch(r"[0-9]{1,5}", x) else 1 for x in (attrs.get("colspan", "1"), attrs.get("rowspan", "1")))
                    # a row span of 0 goes on to the end of the table
                    state = (tables[-1], min(1000, max(1, span)), deep or 65_534, lay)
                    lay = Layout()
            elif tag == "details":
                state = "open" in attrs
                lay.block(False)
            elif tag == "li":
                lay.block(False)
                i = last(("ol", "ul", "menu", "dir"))
                if i is not None and stack[i][0] == "ol" and isinstance(stack[i][2], list):
                    count = stack[i][2]
                    count[0] = int(attrs["value"]) if re.fullmatch(r"-?\d{1,9}", attrs.get("value", "")) else count[0] + 1
                    bullet = f"{count[0]}. "
                else:
                    bullet = "- "
                lay.deeper(len(bullet))
                lay.bullet, state = "" if veiled else bullet, True
            elif tag in BLOCK:
                nested = tag in ("ul", "ol") and last(("ul", "ol")) is not None
                lay.block(tag in SPACED and not nested)
                if tag == "ol":
                    state = [int(attrs["start"]) - 1 if re.fullmatch(r"-?\d{1,9}", attrs.get("start", "")) else 0]
                elif tag in ("dd", "blockquote"):
                    lay.deeper(2)
                    state = True
        stack.append((tag, hidden, state, was_veiled))
        opened[tag] += 1
        hidden = 1 if hidden or unseen else 0
        if t[3] and (tag in ("svg", "math", "iframe", "script", "canvas") or opened["svg"] or opened["math"]):
            close(len(stack) - 1)
    close(0)
    return page.text()


def extract(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` without its pages and with their visible text in ``out``."""
    base = df.drop(out) if out != html_col else df
    names = [c for c in base.columns if c != html_col]
    fields = [f"`{c}` {t}" for c, t in base.dtypes if c != html_col]

    def run(batches):
        for b in batches:
            html = b.column(b.schema.get_field_index(html_col))
            texts = pa.array([None if x is None else render(x) for x in (v.as_py() for v in html)], pa.string())
            yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in names], texts], names=[*names, out])

    return base.mapInArrow(run, ", ".join([*fields, f"`{out}` string"]))


def op6_render(spark, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text")
