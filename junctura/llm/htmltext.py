"""Layout-aware text of HTML pages.

A tree builder reads tags with implied ends (paragraphs, list items, table parts,
options, definition terms), raw text elements and void elements; text that the
page hides (hidden, display:none, visibility, closed details, head matter,
scripts, templates) is left out, by attributes and by style rules for a
tag, class or id, whose cascade goes by importance, specificity and order; rules for
print, for narrow screens and in other at-blocks don't hold. A renderer then lays out what is visible: white space is
collapsed but in preformatted text, blocks start on their own lines, paragraphs
and headings are set off by an empty line, list items are marked and indented,
and table cells are padded to columns two spaces apart, over column and row
spans.

Scale: a page is one row and is read and laid out by itself, without recursion.
Time is linear in the page's length and in the text's, but that the lines of a
table within tables are copied once for each table around it. Indents stop at
``MOST_INDENT`` columns, so that deep nesting does not blow up the text; no text
is ever cut.

Defined cases: null or empty html gives an empty text; broken markup never
fails: a lone "<" is text, unknown tags are inline, unclosed elements end with
the page, an end tag without a start is ignored (``</p>`` and ``</br>`` stand for
an element). Attributes and nesting have no limit. Very long pages are read whole.
Null ids and repeated rows pass through; equal pages have equal texts, an empty table
gives no rows; columns besides id and html are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("area base head link meta title script style template noscript iframe noembed noframes object audio video canvas datalist param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption tbody tfoot thead tr td th ul xmp".split()
)
RUN = "#run"  # a block that is no element of the page
BLOCK |= {RUN}
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir xmp".split())
ENDS_P = BLOCK - frozenset("body html option optgroup caption tbody tfoot thead tr td th legend".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title script style template noscript head html".split())
#: tag: (open elements that it ends, elements that bound the search)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
CELL = frozenset({"td", "th", "caption"})

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*+>?+|</([A-Za-z][^\s/>]*+)[^>]*+>?+|<([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|(?=[\"'])[^>]*+>?+|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CSS_COMMENT, CSS_PART = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile(r"([^{};]*+)([{};])")
SAID = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*")
INLINE_IMPORTANT = re.compile(r"[^;]*!\s*important[^;]*")
WIDTH, VIEW = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)(px|em|rem)\s*\)"), 1280
SIMPLE = re.compile(r"(?:([A-Za-z][\w-]*)|\*)?(?:([.#])([\w-]+))?")
DISPLAY, VISIBILITY = re.compile(r"(?<![\w-])display\s*:\s*([a-z-]+)"), re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)")
PRE = re.compile(r"white-space\s*:\s*pre")
SPACES, MOST_INDENT = re.compile(r"[ \t\n\r\f]+"), 200


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str) -> tuple[Node, list[tuple[str, str, str, str]]]:
    """The tree and its style sheet."""
    root = Node("html", {})
    stack, at, n, rules = [root], 0, len(html), _Sheet()
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open

    def pop_to(i: int) -> None:
        for node in stack[i:]:
            places[node.tag].pop()
        del stack[i:]

    def last(names: set[str] | frozenset[str]) -> int:
        """The innermost open element of ``names``; 0 if there is none."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def end(names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Close up to the outermost open element of ``names`` above the nearest bound."""
        bound = last(bounds)
        hits = [p[i] for x in names if (p := places.get(x)) and (i := bisect_right(p, bound)) < len(p)]
        if hits:
            pop_to(min(hits))

    def text(s: str) -> None:
        if stack[-1].tag == "head" and not s.isspace():
            pop_to(len(stack) - 1)
        stack[-1].children.append(unescape(s) if "&" in s else s)

    while at < n:
        low = html.find("<", at)
        if low < 0:
            text(html[at:])
            break
        m = TOKEN.match(html, low)
        while m is None and low >= 0:
            low = html.find("<", low + 1)
            m = TOKEN.match(html, low) if low >= 0 else None
        if low > at or low < 0:
            text(html[at : low if low >= 0 else n])
        if low < 0:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            bound = {"table"} if tag in CELL or tag == "tr" else set() if tag == "table" else CELL
            hit = last(HEADING if tag in HEADING else {tag})
            if hit > last(bound):
                pop_to(hit)
            elif tag == "p":
                stack[-1].children.append(Node("p", {}))
            continue
        if not m[2]:
            continue
        tag, given = m[2].lower(), _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if tag == "html":
            root.attributes = given | root.attributes
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in ENDS_P:
            end({"p"}, CELL | {"button"})
        if tag in HEADING and stack[-1].tag in HEADING:
            pop_to(len(stack) - 1)
        if tag in IMPLIED:
            end(*IMPLIED[tag])
        node = Node(tag, given)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            inside = html[at : close.start() if close else n]
            at = close.end() if close else n
            if tag == "style":
                rules.add(inside, given.get("media", ""))
            node.children.append(unescape(inside) if tag in ("textarea", "title") else inside)
            continue
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "path", "use", "circle", "rect", "g"):
            places[tag].append(len(stack))
            stack.append(node)
    return root, rules


class _Page:
    """Lines of laid-out text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # a collapsed space is due
        self.margin = 0  # empty lines due before the next line
        self.indents: list[str] = []  # each with those before it
        self.mark = ""

    def text(self, s: str, preformatted: bool) -> None:
        if preformatted:
            first, *rest = s.split("\n")
            self._add(first)
            for line in rest:
                self.line(force=True)
                self._add(line)
            return
        words = SPACES.sub(" ", s)
        if not words:
            return
        if words[0] == " ":
            self.gap = self.gap or bool(self.now)
            words = words[1:]
        if words:
            if words[-1] == " ":
                self._add(words[:-1])
                self.gap = True
            else:
                self._add(words)

    def _add(self, s: str) -> None:
        if s:
            if self.gap and self.now:
                self.now.append(" ")
            self.gap = False
            self.now.append(s)

    def line(self, force: bool = False) -> None:
        if self.now or force:
            if self.lines:
                self.lines += [""] * self.margin
            self.margin = 0
            before = self.indents[-1] if self.indents else ""
            self.lines.append((before + self.mark + "".join(self.now)).rstrip())
            if self.mark:
                self.indent(len(self.mark))
                self.mark = ""
        self.now, self.gap = [], False

    def block(self, spaced: bool) -> None:
        self.line()
        if spaced:
            self.margin = 1

    def indent(self, columns: int) -> None:
        self.indents.append(((self.indents[-1] if self.indents else "") + " " * columns)[:MOST_INDENT])

    def whole(self, lines: list[str]) -> None:
        for k, s in enumerate(lines):
            if k and not self.indents:
                self.lines += lines[k:]
                break
            self.now = [s]
            self.line(force=True)


def shown_on(media: str) -> bool:
    """Whether a list of media queries holds for a screen ``VIEW`` pixels wide; other conditions don't hold."""
    for query in media.lower().split(","):
        parts = [p.strip() for p in re.split(r"\band\b", query)]
        kind = parts[0].removeprefix("only ").strip()
        tests = parts if kind.startswith("(") else parts[1:]
        limits = [WIDTH.fullmatch(t) for t in tests]
        if (kind in ("", "all", "screen") or tests is parts) and all(limits):
            wide = [float(m[2]) * (1 if m[3] == "px" else 16) for m in limits]
            if all((VIEW >= w) if m[1] == "min" else (VIEW <= w) for m, w in zip(limits, wide, strict=True)):
                return True
    return False


class _Sheet:
    """Display and visibility by single tag, class and id selectors.

    Of one selector only its last declaration of each kind can win, so that is what is
    kept, and looking up a node costs its classes and not the rules.
    """

    def __init__(self):
        self.said: dict[tuple[str, str, str], dict[tuple[str, bool], tuple[int, int, str]]] = {}
        self.order = 0

    def add(self, css: str, media: str = "") -> None:
        css = CSS_COMMENT.sub(" ", css)
        around: list[tuple[bool, list[str] | None]] = [(shown_on(media), None)]  # whether a block holds, and a rule's selectors
        for m in CSS_PART.finditer(css + "}" * css.count("{")):
            before, holds = m[1].strip(), around[-1][0]
            if m[2] != "{":
                if around[-1][1] is not None and holds:
                    self._declare(around[-1][1], before.lower())
                if m[2] == "}" and len(around) > 1:
                    around.pop()
            elif before.startswith("@"):
                name, _, rest = before[1:].partition(" ") if "(" not in before.split(" ")[0] else (*before[1:].partition("(")[:2], "(" + before.partition("(")[2])
                name = name.lower()
                around.append((holds and (name in ("layer", "supports", "container") or name == "media" and shown_on(rest)), None))
            else:
                around.append((holds and around[-1][1] is None, before.split(",")))

    def _declare(self, selectors: list[str], said: str) -> None:
        if not (d := SAID.fullmatch(said)):
            return
        self.order += 1
        for one in selectors:
            if (s := SIMPLE.fullmatch(one.strip())) and one.strip():
                tag, sign, name = (s[1] or "").lower(), s[2] or "", s[3] or ""
                weight = 100 * (sign == "#") + 10 * (sign == ".") + bool(tag)
                self.said.setdefault((sign, name, tag), {})[d[1], bool(d[3])] = (weight, self.order, d[2])

    def of(self, node: Node) -> str:
        """Declarations that hold for a node, the winning one last."""
        a = node.attributes
        inline = a.get("style", "").lower()
        found: list[tuple[bool, int, int, str]] = []
        if self.said:
            names = [("", "")] + [(".", c) for c in a.get("class", "").split()] + ([("#", a["id"])] if a.get("id") else [])
            for sign, name in names:
                for tag in ("", node.tag):
                    for (kind, important), (weight, order, value) in self.said.get((sign, name, tag), {}).items():
                        found.append((important, weight, order, f"{kind}:{value};"))
            found.sort()
        plain, strong = ("".join(f[3] for f in found if f[0] == important) for important in (False, True))
        return plain + inline + (";" + strong + ";".join(INLINE_IMPORTANT.findall(inline)) if strong or "!" in inline else "")


class _Renderer:
    def __init__(self, rules: _Sheet):
        self.sheet, self.style = rules, rules.of

    def gone(self, node: Node, style: str) -> bool:
        a = node.attributes
        return node.tag in HIDDEN or "hidden" in a or bool(style and DISPLAY.findall(style)[-1:] == ["none"]) or node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden"

    @staticmethod
    def seen(style: str, before: bool) -> bool:
        """Visibility goes down the tree until an element says otherwise."""
        said = VISIBILITY.findall(style) if style else None
        return said[-1] == "visible" if said else before

    def rendered(self, root: Node) -> list[str]:
        """Pages within tables within pages take turns here, so depth costs no recursion."""
        waiting, lines = [self.page(root, True, False)], None
        while True:
            try:
                waiting.append(waiting[-1].send(lines))
                lines = None
            except StopIteration as done:
                waiting.pop()
                lines = done.value
                if not waiting:
                    return lines

    def page(self, root: Node, seen: bool, pre: bool) -> Generator:
        """Lines of what is in ``root``; yields the generators of tables and takes their lines."""
        out = _Page()
        # node, its children, seen, preformatted, list counter, indents to restore, counted, summary of closed details
        frames: list[list] = [[root, iter(root.children), seen, pre, 0, 0, False, None]]
        while frames:
            node, rest, seen, pre, *_, summary = frames[-1]
            child = next(rest, None)
            if child is None:
                self._leave(out, frames.pop())
                continue
            if summary is not None and child is not summary:
                continue
            if isinstance(child, str):
                if seen:
                    out.text(child, pre)
                continue
            style = self.style(child) if child.attributes or self.sheet.said else ""
            if self.gone(child, style):
                continue
            seen = self.seen(style, seen)
            tag = child.tag
            if tag == "br":
                if seen:
                    out.line(force=True)
                continue
            if tag == "hr":
                out.block(True)
                continue
            if tag == "table":
                out.block(True)
                out.whole((yield self.table(child, seen, pre)))
                out.block(True)
                continue
            if tag in BLOCK:
                out.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and node.tag == "li"))
            width, marked = len(out.indents), False
            if tag == "li":
                if node.tag == "ol":
                    start = node.attributes.get("start", "1")
                    value = child.attributes.get("value", "")
                    frames[-1][4] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else frames[-1][4] + 1 if frames[-1][6] else int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
                    frames[-1][6] = True
                    out.mark = f"{frames[-1][4]}. "
                else:
                    out.mark = "* "
                marked = True
            elif tag in ("dd", "blockquote"):
                out.indent(4 if tag == "dd" else 2)
            elif tag in ("td", "th") and out.now:
                out.gap = True
            shut = None
            if tag == "details" and "open" not in child.attributes:
                shut = next((c for c in child.children if isinstance(c, Node) and c.tag == "summary"), child)
            pre = pre or tag in ("pre", "textarea", "xmp") or bool(style and PRE.search(style))
            frames.append([child, iter(child.children), seen, pre, 0, width, False, shut])
            if marked and out.lines and out.margin and node.children and node.children[0] is not child:
                out.margin = min(out.margin, 1)
        out.line()
        return out.lines

    def _leave(self, out: _Page, frame: list) -> None:
        node, width = frame[0], frame[5]
        if node.tag in BLOCK:
            out.block(node.tag in SPACED and not (node.tag in ("ul", "ol", "menu", "dir") and out.indents))
        if node.tag == "li":
            out.mark = ""
        del out.indents[width:]

    def cells(self, row: Node, loose: Node, seen: bool) -> list[tuple[Node, bool]]:
        """The cells of a row and whether they are seen, also those within other elements; each run of what is in no cell is a block of ``loose``."""
        out, holds, run = [], self.holding(row), None
        todo = [(iter(row.children), seen)]
        while todo:
            rest, seen = todo[-1]
            child = next(rest, None)
            if child is None:
                todo.pop()
                run = None
                continue
            if isinstance(child, Node):
                style = self.style(child) if child.attributes or self.sheet.said else ""
                if self.gone(child, style):
                    continue
                if child.tag in CELL - {"caption"}:
                    out.append((child, self.seen(style, seen)))
                    run = None
                    continue
                below = self.seen(style, seen)
                if id(child) in holds and child.tag != "details" and (below or not seen):
                    todo.append((iter(child.children), below))
                    run = None
                    continue
            elif run is None and child.isspace():
                continue
            if run is None:
                run = Node(RUN, {"style": f"visibility:{'visible' if seen else 'hidden'}"})
                loose.children.append(run)
            run.children.append(child)
        return out

    @staticmethod
    def holding(row: Node) -> set[int]:
        """Elements between a row and cells of it that are not its children."""
        out, above, todo = set(), {}, [row]
        while todo:
            node = todo.pop()
            for c in node.children:
                if isinstance(c, str) or c.tag == "table":
                    continue
                if c.tag in ("td", "th"):
                    at = node
                    while at is not row and id(at) not in out:
                        out.add(id(at))
                        at = above[id(at)]
                else:
                    above[id(c)] = node
                    todo.append(c)
        return out

    def table(self, table: Node, seen: bool, pre: bool) -> Generator:
        """Lines of a table; yields the generators of its cells' pages and takes their lines."""
        captions, rows, top = [], [], seen
        todo = [(iter(table.children), seen)]
        loose = Node("td", {})
        while todo:
            rest, seen = todo[-1]
            child = next(rest, None)
            if child is None:
                todo.pop()
                continue
            if isinstance(child, str):
                if not child.isspace():
                    loose.children.append(Node(RUN, {"style": f"visibility:{'visible' if seen else 'hidden'}"}))
                    loose.children[-1].children.append(child)
                continue
            style = self.style(child) if child.attributes or self.sheet.said else ""
            if self.gone(child, style):
                continue
            below = self.seen(style, seen)
            if child.tag in ("thead", "tbody", "tfoot"):
                todo.append((iter(child.children), below))
            elif child.tag == "tr":
                rows.append(self.cells(child, loose, below))
            elif child.tag == "caption":
                captions += yield self.page(child, below, pre)
            elif child.tag in ("td", "th"):
                rows.append([(child, below)])
            elif child.tag not in ("col", "colgroup"):
                if seen != top:
                    loose.children.append(Node(RUN, {"style": f"visibility:{'visible' if seen else 'hidden'}"}))
                    loose.children[-1].children.append(child)
                else:
                    loose.children.append(child)
        if loose.children:
            captions += yield self.page(loose, top, pre)
        grid: list[list[tuple[int, int, list[str]]]] = []  # first column, columns, lines
        taken: dict[int, int] = {}  # column: rows for which a cell from above holds it
        for row in rows:
            at, cells, fresh = 0, [], {}
            for cell, shown in row:
                while taken.get(at, 0) > 0:
                    at += 1
                across, down = (min(1000, int(v)) if (v := cell.attributes.get(k, "")).isdecimal() and v.isascii() and 0 < len(v) < 6 and int(v) else 1 for k in ("colspan", "rowspan"))
                cells.append((at, across, (yield self.page(cell, shown, pre))))
                for k in range(at, at + across):
                    fresh[k] = down
                at += across
            taken = {k: v - 1 for k, v in taken.items() if v > 1} | {k: v - 1 for k, v in fresh.items() if v > 1}
            grid.append(cells)
        width: dict[int, int] = {}
        size = lambda lines: max(map(len, lines), default=0)
        for cells in grid:
            for at, across, lines in cells:
                width.setdefault(at + across - 1, 0)
                if across == 1:
                    width[at] = max(width[at], size(lines))
        for cells in grid:
            for at, across, lines in cells:
                if across > 1:
                    last = at + across - 1
                    have = sum(width.get(k, 0) + 2 for k in range(at, last))
                    width[last] = max(width[last], size(lines) - have)
        left, x = {}, 0
        for k in range(max(width, default=-1) + 1):
            left[k] = x
            if k in width:
                x += width[k] + 2
        out = []
        for cells in grid:
            made: list[str] = []
            for at, _, lines in cells:
                if not left[at] and not made:
                    made = lines
                    continue
                made = made + [""] * (len(lines) - len(made))
                for i, line in enumerate(lines):
                    if line:
                        made[i] = made[i].ljust(left[at]) + line
            out += made
        return captions + [line.rstrip() for line in out] if len(grid) > 1 or grid and len(grid[0]) > 1 else captions + out


def render(html: str | None) -> str:
    if not html:
        return ""
    root, rules = parse(html)
    lines = _Renderer(rules).rendered(root)
    while lines and not lines[-1]:
        lines.pop()
    start = next((i for i, s in enumerate(lines) if s), 0)
    return "\n".join(lines[start:])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text: the visible text of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(x.as_py()) for x in b.column(1)], pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")
