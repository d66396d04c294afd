"""Layout-aware text of HTML pages.

A tokeniser feeds a tree builder that closes and opens tags as HTML implies; the tree reaches the renderer as opens,
texts and closes in document order, so deep nesting needs no recursion. The renderer skips what is not visible and
writes blocks on lines of their own, margins as blank lines, list items with markers and indents, and table cells in
columns of equal width.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

#: Quotes count after = only; one that is never closed, like a tag that is not, runs to the end of the page.
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\s*(?:!\s*important\s*)?(?=;|$)", re.I)


def _names(x: str) -> frozenset[str]:
    return frozenset(x.split())


#: Classes of elements as the HTML standard has them.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
RAW = _names("script style xmp iframe noembed noframes noscript textarea title plaintext")
UNSEEN = _names("head script style template title noscript iframe noembed noframes object audio video canvas datalist meta link base col colgroup rp area param source track desc metadata defs symbol annotation annotation-xml")
MARGIN = _names("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre listing xmp figure table fieldset form hr")
BLOCK = MARGIN | _names("html body address article aside center details dialog div dd dt figcaption footer header hgroup legend li main nav section summary caption optgroup option search tr td th thead tbody tfoot text foreignobject")
ENDS_P = _names("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre listing section summary table ul search xmp plaintext li dd dt")
HEADINGS = _names("h1 h2 h3 h4 h5 h6")
SCOPE = _names("html body table td th caption template object marquee applet")
CELLS = _names("td th")
GROUPS = _names("thead tbody tfoot")
FORMATTING = _names("a b big code em font i nobr s small strike strong tt u")
IN_HEAD = _names("base link meta title style script noscript template")
#: What a start tag closes, and the elements beyond which it does not look.
IMPLIED = {
    "li": (_names("li"), _names("ul ol menu dir") | SCOPE), "dt": (_names("dt dd"), _names("dl") | SCOPE), "dd": (_names("dt dd"), _names("dl") | SCOPE),
    "option": (_names("option"), _names("select optgroup datalist") | SCOPE), "optgroup": (_names("optgroup option"), _names("select") | SCOPE),
    "td": (CELLS | {"caption", "colgroup"}, _names("tr table template")), "th": (CELLS | {"caption", "colgroup"}, _names("tr table template")),
    "tr": (_names("tr td th caption colgroup"), GROUPS | _names("table template")),
    "thead": (GROUPS | _names("tr td th caption colgroup"), _names("table template")), "tbody": (GROUPS | _names("tr td th caption colgroup"), _names("table template")), "tfoot": (GROUPS | _names("tr td th caption colgroup"), _names("table template")),
    "caption": (GROUPS | _names("tr td th caption colgroup"), _names("table template")), "rt": (_names("rt rp"), _names("ruby") | SCOPE), "rp": (_names("rt rp"), _names("ruby") | SCOPE),
}


class Out:
    """Lines of one flow: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = 0
        self.indents: list[str] = []
        self.marker = ""

    def end_line(self, keep: bool = False) -> None:
        if self.now or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = 0
            head = "".join(self.indents)
            if self.marker:
                head, self.marker = head[: max(0, len(head) - len(self.marker))] + self.marker, ""
            self.lines.append((head + "".join(self.now)).rstrip() if self.now else "")
        self.now, self.space = [], False

    def margin(self) -> None:
        self.end_line()
        self.blank = 1

    def put(self, text: str) -> None:
        if text[0] in " \t\n\r\f":
            self.space = self.space or bool(self.now)
        words = SPACE.split(text.strip(" \t\n\r\f"))
        if words != [""]:
            self.now.append((" " if self.space and self.now else "") + " ".join(words))
            self.space = text[-1] in " \t\n\r\f"

    def put_pre(self, text: str) -> None:
        first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if self.space and self.now and first:
            self.now.append(" ")
        self.space = False
        if first:
            self.now.append(first)
        for x in more:
            self.end_line(keep=True)
            if x:
                self.now.append(x)

    def put_lines(self, lines: list[str]) -> None:
        for x in lines:
            self.now = [x]
            self.end_line()

    def text(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}  # column: rows that a cell above still spans

    def row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.rows.append([])

    def cell(self, lines: list[str], wide: int, high: int) -> None:
        if not self.rows:
            self.rows.append([])
        row = self.rows[-1]
        at = row[-1][0] + row[-1][1] if row else 0
        while at in self.taken:
            at += 1
        row.append((at, wide, lines))
        if high > 1:
            self.pending = [(c, high) for c in range(at, at + wide)]
            self.taken |= {c: high for c, high in self.pending}

    def lines(self) -> list[str]:
        """Cells padded to the width of their column; a cell over several columns widens the last if it must."""
        width: dict[int, int] = {}
        for many in (False, True):
            for row in self.rows:
                for at, wide, lines in row:
                    if (wide > 1) == many:
                        need = max(map(len, lines), default=0) - sum(width.get(c, 0) + 2 for c in range(at, at + wide - 1))
                        width[at + wide - 1] = max(width.get(at + wide - 1, 0), need)
        start, x = {}, 0
        for c in range(max(width, default=-1) + 1):
            start[c] = x
            x += width.get(c, 0) + 2 * (c in width)
        out = []
        for row in self.rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for at, _, lines in row:
                    line = line.ljust(start[at]) + (lines[i] if i < len(lines) else "")
                out.append(line.rstrip())
        return out


class Renderer:
    """items: of each reversed list without a start, in order, how many items it has, as an earlier pass has found."""

    def __init__(self, items: list[int] | None = None) -> None:
        self.out = Out()
        self.hidden = 0
        self.unseen = False  # by visibility, which what is inside can take back
        self.pre = 0
        self.items, self.reversed = items, []
        self.flows: list[Out] = []
        self.tables: list[Table] = []
        self.lists: list[list] = []
        self.shut: list[bool] = []  # of each open element, whether it shows its summary alone

    def open(self, name: str, attrs: dict[str, str]) -> dict:
        """What close needs. attrs: only asked for if there are any."""
        state = {"name": name, "hidden": self.hidden, "unseen": self.unseen}
        style = attrs.get("style")
        if style and (said := VISIBILITY.findall(style)):
            self.unseen = said[-1].lower() != "visible"
        closed = name == "details" and "open" not in attrs
        if name == "summary" and self.shut and self.shut[-1]:
            self.hidden -= 1
        elif name in UNSEEN or "hidden" in attrs and attrs["hidden"] != "until-found" or style and HIDING.search(style) or name == "dialog" and "open" not in attrs:
            self.hidden += 1
        self.shut.append(closed)
        state["seen"] = not self.hidden
        self.hidden += closed
        if not state["seen"]:
            return state
        out = self.out
        if name == "br":
            out.end_line(keep=not self.unseen)
        elif name in CELLS and self.tables:
            self.flows.append(out)
            self.out = Out()
            state["spans"] = tuple(max(1, _number(attrs.get(x), 1, most)) for x, most in (("colspan", 1000), ("rowspan", 65534)))
        elif name in BLOCK:
            nested = name in ("ul", "ol", "menu", "dir") and self.lists
            (out.margin if name in MARGIN and not nested else out.end_line)()
            if name == "table":
                self.flows.append(out)
                self.out = Out()
                self.tables.append(Table())
                state["caption"] = self.out
            elif name == "tr" and self.tables:
                self.tables[-1].row()
            elif name in ("ul", "ol", "menu", "dir"):
                back, first, place = name == "ol" and "reversed" in attrs, 1, -1
                if back:
                    place = len(self.reversed)
                    first = self.items[place] if self.items else 1
                    self.reversed.append(0)
                self.lists.append([name == "ol", _number(attrs.get("start"), first, 10**9), -1 if back else 1, place])
            elif name == "li":
                kind = self.lists[-1] if self.lists else [False, 1, 1, -1]
                if kind[3] >= 0:
                    self.reversed[kind[3]] += 1
                if kind[0]:
                    at = _number(attrs.get("value"), kind[1], 10**9)
                    kind[1] = at + kind[2]
                mark = f"{at}. " if kind[0] else "- "
                out.indents.append(" " * len(mark))
                out.marker = mark
                state["indented"] = True
            elif name in ("dd", "blockquote"):
                out.indents.append("    ")
                state["indented"] = True
            elif name in ("pre", "listing", "xmp"):
                self.pre += 1
        elif name == "textarea":
            self.pre += 1
        elif name == "q" and not self.unseen:
            out.put('"')
        return state

    def close(self, state: dict) -> None:
        name = state["name"]
        unseen, self.unseen = self.unseen, state["unseen"]
        self.hidden = state["hidden"]
        self.shut.pop()
        if not state["seen"]:
            return
        if "spans" in state:
            lines, self.out = self.out.text(), self.flows.pop()
            self.tables[-1].cell(lines, *state["spans"])
        elif name in BLOCK:
            if name == "table":
                table, own, self.out = self.tables.pop(), state["caption"], self.flows.pop()
                self.out.put_lines([x for x in own.text() if x])
                self.out.put_lines(table.lines())
            out = self.out
            nested = name in ("ul", "ol", "menu", "dir") and len(self.lists) > 1
            (out.margin if name in MARGIN and not nested else out.end_line)()
            if name in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
            elif name in ("pre", "listing", "xmp"):
                self.pre -= 1
            if state.get("indented"):
                out.indents.pop()
                out.marker = ""
        elif name == "textarea":
            self.pre -= 1
        elif name == "q" and not unseen:
            self.out.space = False
            self.out.now.append('"')

    def text(self, text: str) -> None:
        if not self.hidden and not self.unseen and text:
            (self.out.put_pre if self.pre else self.out.put)(text)


def _number(x: str | None, default: int, most: int) -> int:
    m = re.match(r"\s*(-?[0-9]{1,9})", x or "")
    return min(int(m[1]), most) if m else default


def _attrs(x: str) -> dict[str, str]:
    if not x or x.isspace():
        return {}
    out: dict[str, str] = {}
    for m in ATTR.finditer(x):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class TreeBuilder:
    """Open elements are numbered as they open, and listed by name, so that no question about them walks the stack."""

    def __init__(self, items: list[int] | None = None) -> None:
        self.stack: list[dict] = []
        self.to = Renderer(items)
        self.named: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.opened = 0

    def _push(self, state: dict) -> None:
        self.opened += 1
        state["no"], name = self.opened, state["name"]
        self.stack.append(state)
        for own in self._lists(name):
            own.append(self.opened)

    def _lists(self, name: str) -> list[list[int]]:
        return [self.named[name]] + [self.blocks] * (name in BLOCK) + [self.scopes] * (name in SCOPE)

    def _pop(self) -> None:
        state = self.stack.pop()
        for own in self._lists(state["name"]):
            own.pop()
        self.to.close(state)

    def _last(self, names: frozenset[str]) -> int:
        """The number of the innermost open element of these names; 0 without."""
        return max([own[-1] for x in names if (own := self.named.get(x))], default=0)

    def _within(self, names: frozenset[str], bounds: frozenset[str]) -> bool:
        at = self._last(names)
        return at > 0 and at >= self._last(bounds)

    def _close(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        while self._within(names, bounds):
            while self.stack[-1]["name"] not in names:
                self._pop()
            self._pop()

    def _past_blocks(self, name: str) -> bool:
        """Whether an inline element's end stands inside a block that began in it. The block stays open; a formatting
        element that shows is taken out from under it, any other stays too."""
        own = self.named.get(name) or [0]
        block = self.blocks[-1] if self.blocks else 0
        if own[-1] > block:
            return False
        if own[-1] and name in FORMATTING:
            below = bisect_left(self.scopes, block) - 1
            if below < 0 or self.scopes[below] < own[-1]:
                at = bisect_left(self.stack, own[-1], key=lambda x: x["no"])
                if self.stack[at]["seen"]:
                    del self.stack[at], self.to.shut[at]
                    own.pop()
        return True

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "body", "head"):
            if name != "html":
                self._close(frozenset(["head"]), frozenset())
            if self.named.get(name) or self.named.get("body"):
                return
        elif self.stack and self.stack[-1]["name"] == "head" and name not in IN_HEAD:
            self._pop()
        if name == "image":
            name = "img"
        if name in ENDS_P:
            self._close(frozenset(["p"]), SCOPE | {"button"})
        if name in HEADINGS and self.stack and self.stack[-1]["name"] in HEADINGS:
            self._pop()
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        if name in CELLS and not self._within(frozenset(["tr"]), _names("table template")) and self._within(frozenset(["table"]), frozenset(["template"])):
            self.start("tr", {})
        if name == "tr" and self.stack and self.stack[-1]["name"] == "table":
            self.start("tbody", {})
        state = self.to.open(name, attrs)
        if name in VOID:
            self.to.close(state)
        else:
            self._push(state)

    def end(self, name: str) -> None:
        if name == "p" and not self._within(frozenset(["p"]), SCOPE | {"button"}):
            self.start("p", {})
        if name == "br":
            self.start("br", {})
        elif name in HEADINGS:
            self._close(HEADINGS, SCOPE) if self._within(HEADINGS, SCOPE) else None
        elif name not in ("html", "body"):
            if name not in BLOCK and self._past_blocks(name):
                return
            bounds = _names("html table template") if name in CELLS | GROUPS | {"tr", "caption"} else _names("html template") if name == "table" else SCOPE - {name}
            if self._within(frozenset([name]), bounds):
                while self.stack[-1]["name"] != name:
                    self._pop()
                self._pop()

    def text(self, text: str) -> None:
        if self.stack and self.stack[-1]["name"] == "head" and not text.isspace():
            self._pop()
        self.to.text(text)

    def done(self) -> str:
        while self.stack:
            self._pop()
        return "\n".join(self.to.out.text())


def page_text(page: str | None) -> str | None:
    """Visible text of a page; null for null, empty for a page without any."""
    if page is None:
        return None
    build = _built(page, None)
    if build.to.reversed:  # numbered from how many items they have
        build = _built(page, build.to.reversed)
    return build.done()


def _built(page: str, items: list[int] | None) -> TreeBuilder:
    build, at, n = TreeBuilder(items), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        m = TOKEN.match(page, lt) if lt >= 0 else None
        while lt >= 0 and not m:  # a stray < is text
            lt = page.find("<", lt + 1)
            m = TOKEN.match(page, lt) if lt >= 0 else None
        stop = lt if lt >= 0 else n
        if stop > at:
            part = page[at:stop]
            build.text(html.unescape(part) if "&" in part else part)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:  # a tag that the page ends in
            break
        name = m[2].lower()
        if m[1]:
            build.end(name)
            continue
        attrs = _attrs(m[3])
        build.start(name, attrs)
        if name in ("pre", "listing", "textarea") and page.startswith("\n", at):
            at += 1
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at) if name != "plaintext" else None
            stop = end.start() if end else n
            raw = page[at:stop]
            if raw:
                build.text(html.unescape(raw) if name in ("textarea", "title") else raw)
            at = stop
    return build


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textkit.tables(batches, 512):
        texts = pa.array([page_text(x) for x in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["key", "text"])


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``column``, and ``text``: the visible text (a column of that name is replaced).

    Null pages have null text; empty pages and pages without visible text have an empty one. Repeated rows get a
    result each; no rows give none. Broken markup gives what the builder makes of it, never an error.
    """
    others = [c for c in pages.columns if c not in (column, "text")]
    packed = pages.select(F.struct(*others).alias("key") if others else F.lit(0).alias("key"), F.col(column).cast("string").alias("html"))
    kind = packed.schema["key"].dataType.simpleString()
    out = packed.mapInArrow(_texts, f"key {kind}, text string")
    return out.select(*[F.col("key")[c].alias(c) for c in others], "text")
