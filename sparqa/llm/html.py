"""Layout-aware text of HTML pages.

A scanner cuts the page into tags and text; the tree builder opens and closes elements by the usual implied-tag
rules; the renderer walks the tree and emits visible text: blocks on lines of their own, paragraphs and headings with a
blank line around them, list items with a mark and an indent, table cells padded to their column's width.

Not visible are: comments, the contents of head-like, scripted and embedded elements (among them the fallback text of
canvas, audio, video, iframe and object, and ``noscript``, as on a screen that runs scripts) and of ``datalist``, ``input``, elements with ``hidden``, a closed
``details`` but for its summary, and whatever an inline style or a simple rule of the page (tag, .class, #id; other selectors hide nothing)
hides with ``display:none`` or ``visibility:hidden`` on every screen. Visibility is inherited, and a child may undo it.
Text of a table outside of its cells comes before it. Wide characters count as two columns of a cell.

Open elements are counted by tag, so that no tag walks over all of its ancestors: time is in proportion to the page and its text.

Edge cases: NULL or empty pages give an empty text; unclosed, stray and wrongly nested tags are repaired; what follows a tag whose ``>``
never comes belongs to it, as in a browser; pages of any
length and depth are rendered whole (no recursion); repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript canvas audio video iframe object datalist desc metadata defs "
                   "annotation annotation-xml".split())
RAW = frozenset("script style textarea title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details div dt fieldset figcaption footer form header html legend li "
                           "main menu nav section summary tr thead tbody tfoot td th option optgroup textarea".split())
#: An open element of the key ends when one of these starts inside it.
IMPLIED = {
    "p": SPACED | frozenset("address article aside details div dd dt fieldset figcaption footer form header li main menu nav section".split()) - {"hr"} | {"hr"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "thead", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "thead", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "thead", "tbody", "tfoot"}), "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}),
    "tfoot": frozenset({"tbody"}), "head": frozenset({"body"}), "caption": frozenset({"tr", "thead", "tbody", "tfoot", "colgroup"}),
}
#: Implied ends do not reach past these.
SCOPE = {"li": frozenset({"ul", "ol", "menu"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}),
         "thead": frozenset({"table"}), "tbody": frozenset({"table"}), "tfoot": frozenset({"table"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}),
         "caption": frozenset({"table"}), "option": frozenset({"select"}), "p": BLOCK - {"p"}, "head": frozenset({"html"})}
HEAD_ONLY = frozenset("title style script meta link base noscript template".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)"
                  r"((?:[^>=]++|=[ \t\n\r\f]*+(?:\"[^\"]*\"|'[^']*'|[^ \t\n\r\f>\"'][^ \t\n\r\f>]*+)?+)*+)>", re.S)
_TAG_START = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VEIL = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_RULE = re.compile(r"([^{};]+)\{([^{}]*)\}")
_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_BRACE = re.compile(r"[{};]")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text) if text and not text.isspace() else ():
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


class _Open:
    """The open elements, innermost last, with the places of every tag."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, []

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def innermost(self, tags) -> int:
        """Place of the innermost open element with one of the tags; 0, the root's, if there is none."""
        return max([p[-1] for t in tags if (p := self.places.get(t))], default=0)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


#: Tag -> the open elements that it ends, and those that keep it from reaching further out.
_ENDS = {name: frozenset(k for k in IMPLIED if name in IMPLIED[k]) for ends in IMPLIED.values() for name in ends}
_WALLS = {name: frozenset().union(*(SCOPE.get(k, frozenset()) for k in ends)) - IMPLIED.keys() for name, ends in _ENDS.items()}


def _next_tag(page: str, at: int) -> tuple[re.Match | None, int]:
    """The next tag, and where the text before it ends."""
    while (at := page.find("<", at)) >= 0:
        if _TAG_START.match(page, at):
            return _TAG.match(page, at), at
        at += 1
    return None, len(page)


def tree(page: str) -> Node:
    """The element tree of a page; text nodes are strings."""
    root = Node("#root", {}, None)
    open_ = _Open(root)
    at = 0
    while True:
        m, stop = _next_tag(page, at)
        text = page[at:stop]
        if text:
            if open_.top.tag == "head" and not text.isspace():
                open_.close(len(open_.stack) - 1)
            open_.top.kids.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            place = open_.innermost((name,))
            if name not in BLOCK:
                wall = open_.blocks[-1] if open_.blocks and name not in ("body", "html") else 0
            else:
                wall = open_.innermost(("table",)) if name != "table" else 0
            if place > wall:
                open_.close(place)
            elif name in ("p", "br"):
                open_.top.kids.append(Node(name, {}, open_.top))
            continue
        if open_.top.tag == "head" and name not in HEAD_ONLY and name != "head":
            open_.close(len(open_.stack) - 1)
        if name in _ENDS:  # close what this tag ends
            wall = open_.innermost(_WALLS[name])
            while (place := open_.innermost(_ENDS[name])) > wall:
                open_.close(place)
        if name in ("td", "th") and open_.top.tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {}, open_.top)
            open_.top.kids.append(row)
            open_.push(row)
        node = Node(name, _attrs(m[3]), open_.top)
        open_.top.kids.append(node)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            text = page[at:end.start() if end else len(page)]
            node.kids.append(entities.unescape(text) if name in ("title", "textarea") else text)
            at = end.end() if end else len(page)
        elif name not in VOID and not (m[3].endswith("/") and name in ("svg", "math")):
            open_.push(node)


def _applies(prelude: str) -> bool:
    """Whether the rules of an at-block hold on any screen: only plain ``@media`` for all or screens, and ``@layer``, surely do."""
    name, _, query = prelude.strip().lower().partition(" ")
    return name == "@layer" or name == "@media" and any(q.strip() in ("", "all", "screen", "only screen", "only all") for q in query.split(","))


def _screen_rules(css: str) -> str:
    """The plain rules of a style sheet, without the at-blocks that do not hold on every screen."""
    css = _CSS.sub(" ", css)
    out, at, skip, depth = [], 0, 0, 0
    for m in _BRACE.finditer(css):
        c = m[0]
        if c == "{":
            prelude = css[at:m.start()]
            depth += 1
            if skip:
                pass
            elif prelude.lstrip().startswith("@"):
                if _applies(prelude):
                    at = m.end()
                    continue
                skip = depth
            else:
                out.append(prelude + "{")
        elif c == "}":
            if not skip and out and not out[-1].endswith("}"):
                out.append(css[at:m.start()] + "}")
            if skip == depth:
                skip = 0
            depth = max(0, depth - 1)
        elif not skip and out and not out[-1].endswith("}"):
            out.append(css[at:m.end()])  # between the declarations of a rule
        at = m.end()
    while out and not out[-1].endswith("}"):  # a rule that never ends
        out.pop()
    return "".join(out)


class Looks:
    """What a page's styles hide: ``gone`` elements with all inside them, and ``veiled`` ones, whose own text is not seen."""

    def __init__(self, root: Node):
        none, veil = _style_rules(root)
        self.gone: set[int] = set()
        self.veiled: set[int] = set()
        todo = [(root, False)]
        while todo:
            n, veiled = todo.pop()
            names = [n.tag, *(f".{c.lower()}" for c in n.attrs.get("class", "").split()), f"#{n.attrs.get('id', '').lower()}"] if none or veil else []
            style = n.attrs.get("style", "")
            if n.up is not None and (n.tag in UNSEEN or n.tag == "input" or "hidden" in n.attrs or any(x in none for x in names) or style and _NONE.search(style)
                                     or n.up.tag == "details" and "open" not in n.up.attrs and n.tag != "summary"):
                self.gone.add(id(n))
                continue
            for x in names:  # a tag's rule, then classes, then the id, then the element's own style
                veiled = veil.get(x, veiled)
            own = _VEIL.findall(style) if style else ()
            if own:
                veiled = own[-1].lower() != "visible"
            if veiled:
                self.veiled.add(id(n))
            todo.extend((k, veiled) for k in n.kids if isinstance(k, Node))

    def shows(self, n: Node) -> bool:
        return id(n) not in self.gone

    def text(self, n: Node) -> bool:
        return id(n) not in self.veiled


def _style_rules(root: Node) -> tuple[set[str], dict[str, bool]]:
    """Selectors of elements that are not displayed, and selector -> veiled."""
    none: set[str] = set()
    veil: dict[str, bool] = {}
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "style":
            for sel, body in _RULE.findall(_screen_rules("".join(k for k in n.kids if isinstance(k, str)))):
                names = [s.strip().lower() for s in sel.split(",") if re.fullmatch(r"\s*[.#]?[\w-]+\s*", s)]
                if _NONE.search(body):
                    none.update(names)
                own = _VEIL.findall(body)
                if own:
                    veil |= dict.fromkeys(names, own[-1].lower() != "visible")
        todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return none, veil


def _columns(s: str) -> int:
    """Width of a text on a screen of fixed columns."""
    return len(s) if s.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in s)


class _Shift:
    """Lines set in by ``pad`` columns, the first after the text ``first``."""
    __slots__ = ("first", "pad", "lines")

    def __init__(self, first: str, pad: int, lines: list):
        self.first, self.pad, self.lines = first, pad, lines


def _flat(lines: list) -> list[str]:
    """The lines of a list that holds lines, lists of lines and shifted ones, at any depth."""
    out, lead, frames = [], None, [(iter(lines), "")]
    while frames:
        it, base = frames[-1]
        for x in it:
            prefix = base if lead is None else lead
            if isinstance(x, str):
                out.append((prefix + x).rstrip() if prefix else x)
                lead = None
            elif isinstance(x, _Shift):
                lead = prefix + x.first
                frames.append((iter(x.lines), base + " " * x.pad))
                break
            else:
                frames.append((iter(x), base))
                break
        else:
            frames.pop()
    return out


class _Lines:
    """Lines under construction; white space is collapsed, blank lines never double. Those of a nested table are one entry."""

    def __init__(self):
        self.lines: list = []
        self.line: list[str] = []  # pieces of the line under way
        self.gap = False
        self.blank = False
        self.indent = ""
        self.mark = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s[:1] == " ":
            self.gap = True
            s = s[1:]
        if not s:
            return
        if self.line and self.gap:
            self.line.append(" ")
        self.gap = s[-1] == " "
        self.line.append(s.rstrip(" "))

    def end(self, blank: bool = False) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = self.indent[:len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.lines.append(lead + "".join(self.line))
            self.line, self.mark = [], ""
        self.gap = False
        self.blank = self.blank or blank

    def raw(self, lines: list[str], bare: bool = False) -> None:
        """Lines as they are; ``bare``: they have no white space at their ends."""
        self.end()
        if not self.indent and bare:
            if self.blank and self.lines and lines:
                self.lines.append("")
            self.blank = self.blank and not lines
            if lines:
                self.lines.append(lines)
            return
        for x in _flat(lines):
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = self.indent[:len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.mark = ""
            self.lines.append((lead + x).rstrip())


def _render(root: Node, looks: Looks, tables: dict[int, list]) -> list:
    """Lines of a subtree; nested tables have been rendered before and are looked up."""
    out = _Lines()
    todo: list = [("in", root)]
    ordinals: dict[int, int] = {}
    while todo:
        what, n = todo.pop()
        if what == "text":
            out.text(n)
            continue
        if what == "out":
            out.end(n.tag in SPACED)
            if n.tag in ("li", "dd", "blockquote"):
                out.indent = out.indent[:-len(_lead(n, ordinals))]
                out.mark = ""
            continue
        if n is not root and not looks.shows(n):
            continue
        seen = looks.text(n)
        if n.tag == "br":
            if out.line:
                out.end()
            else:
                out.blank = True  # a second break leaves a line empty
            continue
        if n.tag == "hr":
            out.end(True)
            out.raw(["---"] if seen else [])
            out.end(True)
            continue
        if n.tag == "img":
            if seen and n.attrs.get("alt", "").strip():
                out.text(n.attrs["alt"])
            continue
        if id(n) in tables and n is not root:
            out.end(True)
            out.raw(tables[id(n)], True)
            out.end(True)
            continue
        if n.tag == "pre":
            out.end(True)
            out.raw(_plain(n, looks).strip("\n").split("\n"))
            out.end(True)
            continue
        if n.tag in BLOCK:
            out.end(n.tag in SPACED and not (n.tag in ("ul", "ol") and n.up is not None and n.up.tag == "li"))
            if n.tag == "li" and n.up is not None and n.up.tag == "ol":
                k = id(n.up)
                ordinals[k] = ordinals.get(k, _start(n.up) - 1) + 1
                ordinals[id(n)] = ordinals[k]
            if n.tag in ("li", "dd", "blockquote"):
                lead = _lead(n, ordinals)
                out.indent += lead if n.tag == "blockquote" else " " * len(lead)
                out.mark = lead if n.tag == "li" else ""
            todo.append(("out", n))
        shut = n.tag == "details" and "open" not in n.attrs
        for k in reversed(n.kids):
            if not isinstance(k, str):
                todo.append(("in", k))
            elif not shut and seen:
                todo.append(("text", k))
    out.end()
    return out.lines


def _start(n: Node) -> int:
    s = n.attrs.get("start", "1")
    return int(s) if re.fullmatch(r"-?[0-9]{1,9}", s) else 1


def _lead(n: Node, ordinals: dict[int, int]) -> str:
    if n.tag == "blockquote":
        return "> "
    if n.tag == "dd":
        return "  "
    return f"{ordinals[id(n)]}. " if id(n) in ordinals else "- "


def _plain(n: Node, looks: Looks) -> str:
    parts, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is n or looks.shows(x):
            if x.tag == "br":
                parts.append("\n")
            seen = looks.text(x)
            todo.extend(k for k in reversed(x.kids) if seen or not isinstance(k, str))
    return "".join(parts)


def _rows(table: Node, looks: Looks) -> tuple[list[Node], list[list[Node]]]:
    """Captions and rows of cells that belong to this table itself. Forms and inline elements around cells are
    transparent; all else that stands outside of cells, text too, comes before the table."""
    captions, rows = [], []
    holders = _holders(table)
    loose: Node | None = None
    todo: list = [(k, None) for k in reversed(table.kids)]
    while todo:
        n, row = todo.pop()
        if isinstance(n, str) or id(n) not in holders and n.tag not in ("colgroup", "col"):
            if loose is None:  # neighbours share a line
                loose = Node("#loose", {}, table)
                captions.append(loose)
            if not isinstance(n, str) or looks.text(table):
                loose.kids.append(n)
            continue
        if not looks.shows(n) or n.tag in ("colgroup", "col"):
            continue
        loose = None
        if n.tag in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
            row.append(n)
        else:
            if n.tag == "tr":
                row = []
                rows.append(row)
            todo.extend((k, row) for k in reversed(n.kids))
    return captions, [r for r in rows if r]


def _holders(table: Node) -> set[int]:
    """The parts of the table itself and what stands between them."""
    out, todo = set(), [k for k in table.kids if isinstance(k, Node)]
    while todo:
        n = todo.pop()
        if n.tag in ("tr", "td", "th", "thead", "tbody", "tfoot"):
            x = n
            while x is not table and id(x) not in out:
                out.add(id(x))
                x = x.up
        if n.tag not in ("td", "th", "table"):
            todo.extend(k for k in n.kids if isinstance(k, Node))
    return out


def _span(c: Node) -> int:
    s = c.attrs.get("colspan", "1")
    return max(1, int(s)) if re.fullmatch(r"[0-9]{1,3}", s) else 1


def _table(table: Node, looks: Looks, tables: dict[int, list]) -> list:
    captions, rows = _rows(table, looks)
    out = [x for c in captions for x in _render(c, looks, tables)]
    cells = [[(_span(c), _render(c, looks, tables) or [""]) for c in r] for r in rows]
    # only columns with another cell to their right are padded, and so measured
    inner = {col for r in cells for col in range(sum(span for span, _ in r[:-1]))}
    width: dict[int, int] = {}
    for r in cells:
        col = 0
        for i, (span, lines) in enumerate(r):
            if len(r) > 1 and i < len(r) - 1 or col in inner:
                r[i] = span, _flat(lines)
            if span == 1 and col in inner:
                width[col] = max(width.get(col, 0), max(map(_columns, r[i][1])))
            col += span
    for r in cells:
        left, col = [], 0
        for span, lines in r[:-1]:
            left.append((lines, sum(width.get(c, 0) for c in range(col, col + span)) + 2 * (span - 1)))
            col += span
        last = r[-1][1]
        if not left:
            out.extend(last)
            continue
        if all(len(lines) == 1 for lines, _ in left):
            first = "".join(lines[0] + " " * (w - _columns(lines[0]) + 2) for lines, w in left)
            out.append(_Shift(first, sum(w + 2 for _, w in left), last))
            continue
        last = _flat(last)
        for k in range(max(len(last), *(len(lines) for lines, _ in left))):
            line = "".join(t + " " * (w - _columns(t) + 2) for lines, w in left for t in [lines[k] if k < len(lines) else ""])
            out.append((line + (last[k] if k < len(last) else "")).rstrip())
    while out and out[-1] == "":
        out.pop()
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    root = tree(page)
    looks = Looks(root)
    nested, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == "table":
            nested.append(n)
        todo.extend(k for k in n.kids if isinstance(k, Node))
    tables: dict[int, list] = {}
    for t in reversed(nested):  # inner tables first
        tables[id(t)] = _table(t, looks, tables)
    return "\n".join(_flat(_render(root, looks, tables)))


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, n_lines) of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for t in batches:
            texts = [render(x) for x in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(texts, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())],
                                             [key, "text", "n_lines"])
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, text string, n_lines long")
