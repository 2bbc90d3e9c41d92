"""The visible text of HTML pages, laid out as lines.

A tokenizer feeds a tree builder that closes what a new element implies the end
of; the tree is then rendered: hidden elements are left out, blocks start lines
and are set apart, list items have markers and are indented, the cells of a
table's columns are aligned, and preformatted text keeps its lines.

Hidden are elements that browsers never show, those with the attribute
``hidden``, with ``display: none`` or ``visibility: hidden`` in their style or
by a rule of the page's style sheets whose selector is one element name, class,
identifier, or a name with one of these; of several declarations the one counts
that wins in the cascade, and rules count that apply on a light screen of 1280
by 800 pixels, so those for print don't; closed dialogs, and what a closed
``details`` holds beside its summary; the options of a list that aren't chosen.
Scripts aren't run, so ``noscript`` is shown; nothing is loaded, so the content
of ``object`` is. Formulas are shown as the text of their parts, drawings as a
line for each text, but for texts without a place, whose base line is the upper
edge, where browsers cut them off, and texts that are defined to be used.

Defined cases: a null page has a null text; an empty page, or one without
visible text, an empty one; a page of any length or depth is rendered whole;
what is no HTML is text; repeated rows are rendered one by one; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need, type_of

#: The elements of HTML by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset("head script style template title iframe noembed noframes datalist audio video canvas annotation annotation-xml mphantom".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup p pre search section summary table tbody td textarea tfoot th thead tr ul xmp".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul listing xmp".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul listing xmp dd dt li".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table td th caption html template object button".split())
PARTS = frozenset("thead tbody tfoot".split())
#: A new element of the key ends open elements of the values, up to a border.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th html".split())),
    "dd": (frozenset(["dd", "dt"]), frozenset("dl table td th html".split())),
    "dt": (frozenset(["dd", "dt"]), frozenset("dl table td th html".split())),
    "option": (frozenset(["option"]), frozenset("select datalist html".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset("select html".split())),
    "td": (frozenset(["td", "th", "caption"]), frozenset("tr table html".split())),
    "th": (frozenset(["td", "th", "caption"]), frozenset("tr table html".split())),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset("table html".split())),
    "thead": (PARTS | {"tr", "td", "th", "caption"}, frozenset("table html".split())),
    "tbody": (PARTS | {"tr", "td", "th", "caption"}, frozenset("table html".split())),
    "tfoot": (PARTS | {"tr", "td", "th", "caption"}, frozenset("table html".split())),
}

#: Parts of formulas that stand apart, of drawings that aren't drawn by themselves, and what moves a drawing's text.
MATH_PARTS = frozenset("mfrac msup msub msubsup munder mover munderover mroot mtable mtr".split())
DEFINED = frozenset("defs symbol clippath mask pattern marker desc metadata title".split())
PLACING = frozenset("y dy transform dominant-baseline style class".split())
SCREEN = {"width": 1280.0, "height": 800.0}
SCREEN_HAS = {
    "orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "any-hover": "hover", "pointer": "fine",
    "any-pointer": "fine", "scripting": "none",
}

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NOISE = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*+(?:"|\Z)|'(?:\\.|[^'\\])*+(?:'|\Z)|<!--|-->""", re.S)
_PARENS = re.compile(r"\([^()]*\)")
_IMPORTANT = re.compile(r"\s*!\s*important\Z")
_DISPLAY = re.compile(r"(?!-ms-|-moz-|-o-)[a-z-]+(?: [a-z-]+)*\Z")
_FEATURE = re.compile(r"(?:(min-|max-)?(?:device-)?(width|height)\s*:|(width|height)\s*([<>]?=?))\s*([0-9.]+)(px|r?em)?\Z")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?\Z", re.I)


def declarations(text: str) -> dict[str, tuple[str, bool]]:
    """The values of display and visibility, and whether they are important."""
    out: dict[str, tuple[str, bool]] = {}
    for part in _PARENS.sub("", text).lower().split(";"):
        name, _, value = part.partition(":")
        name = name.strip()
        if name in ("display", "visibility"):
            plain = _IMPORTANT.sub("", value).strip()
            important = plain != value.strip()
            known = _DISPLAY.match(plain) if name == "display" else plain in ("visible", "hidden", "collapse", "initial", "inherit", "unset", "revert")
            if known and (important or not out.get(name, ("", False))[1]):
                out[name] = plain, important
    return out


def on_screen(queries: str) -> bool:
    """Whether a list of media queries applies on the screen; unknown ones don't."""

    def has(feature: str) -> bool | None:
        feature = feature.strip("() \t\n\r\f")
        m = _FEATURE.match(feature)
        if m:
            size, least = SCREEN[m[2] or m[3]], float("0" + m[5].strip(".")) * (16 if m[6] and m[6] != "px" else 1)
            how = m[4] if m[3] else {"min-": ">=", "max-": "<="}.get(m[1], "=")
            return {">=": size >= least, "<=": size <= least, ">": size > least, "<": size < least}.get(how, size == least)
        name, _, value = (x.strip() for x in feature.partition(":"))
        return SCREEN_HAS[name] == value if value and name in SCREEN_HAS else True if feature in ("color", "hover", "pointer", "width", "height") else None

    def applies(query: str) -> bool:
        negated = query.startswith("not ")
        parts = re.split(r"\s+and\s+", re.sub(r"\A(?:not|only)\s+", "", query))
        found = [has(x) if x.startswith("(") else x in ("all", "screen") for x in parts]
        return None not in found and all(found) != negated

    every = [q.strip() for q in re.split(r",|\sor\s", queries.lower())]
    return every == [""] or any(applies(q) for q in every if q)


def style_rules(css: str) -> list[tuple]:
    """``kind, name, tag, property, value, important, layered`` in order."""
    out: list[tuple] = []
    stack: list[tuple] = [(True, False, None)]  # of each open block: whether it applies, is in a layer, and its selectors
    css, last = _NOISE.sub("", css), 0

    def declare(text: str) -> None:
        on, layered, selectors = stack[-1]
        if on and selectors:
            for what, (value, important) in declarations(text).items():
                out.extend((kind, name, tag, what, value, important, layered) for tag, kind, name in selectors)

    for m in re.finditer(r"[{};]", css):
        text, last = css[last : m.start()].strip(), m.end()
        on, layered, selectors = stack[-1]
        if m[0] != "{":
            declare(text)
            if m[0] == "}" and len(stack) > 1:
                stack.pop()
        elif text.startswith("@"):
            at = re.match(r"@([\w-]*)(.*)", text.lower(), re.S)
            applies = {"media": lambda: on_screen(at[2]), "supports": lambda: not re.match(r"\s*not\b", at[2]), "layer": lambda: True}.get(at[1], lambda: False)()
            stack.append((on and applies, layered or at[1] == "layer", selectors))
        elif selectors is not None:  # a nested rule has a selector of two parts
            stack.append((False, layered, selectors))
        else:
            found = [_SELECTOR.match(n.strip()) for n in text.split(",")]
            stack.append((on, layered, [((x[1] or "").lower(), x[2] or "", x[3] or "") for x in found if x and x[0]]))
    declare(css[last:])
    return out


def indexed(rules: list[tuple]) -> dict[tuple[str, str], list[tuple]]:
    """Rules by what they need, with their rank in the cascade."""
    out: dict[tuple[str, str], list[tuple]] = {}
    for order, (kind, name, tag, what, value, important, layered) in enumerate(rules):
        rank = (important, False, layered == important, kind == "#", kind == ".", bool(tag), order)
        out.setdefault((kind, name if kind else tag), []).append((rank, tag, what, value))
    return out


class Node:
    __slots__ = ("tag", "raw", "children", "_attrs")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children, self._attrs = tag, raw, [], None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            if self.raw:
                for m in _ATTRIBUTE.finditer(self.raw):
                    self._attrs.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return self._attrs


def build(page: str) -> tuple[Node, dict]:
    """The tree of a page, and the rules of its style sheets."""
    root = Node("html")
    stack, open_count, rules = [root], {"html": 1}, []
    at, end = 0, len(page)

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        open_count[node.tag] = open_count.get(node.tag, 0) + 1

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_count[stack.pop().tag] -= 1

    def close(tags: frozenset, borders: frozenset, outermost: bool = False) -> None:
        if not any(open_count.get(t) for t in tags):
            return
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in borders:
                break
            if stack[i].tag in tags:
                found = i
                if not outermost:
                    break
        if found:
            pop_to(found)

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag in HEADINGS:
                close(HEADINGS, SCOPES)
            elif tag not in ("html", "body") and open_count.get(tag):
                close(frozenset([tag]), (frozenset(["html"]) if tag in SCOPES or tag in PARTS or tag == "tr" else SCOPES) - {tag})
            continue
        if tag in ("html", "body"):
            root.raw += m[3]
            continue
        if tag in ENDS_P and open_count.get("p"):
            close(frozenset(["p"]), SCOPES)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in IMPLIED:
            close(*IMPLIED[tag], outermost=True)
        if tag in ("td", "th") and (stack[-1].tag == "table" or stack[-1].tag in PARTS):
            push(Node("tr"))
        node = Node(tag, m[3])
        ended = m[3].endswith("/") and tag not in BLOCKS and (tag in ("svg", "math", "path") or open_count.get("svg") or open_count.get("math"))
        if tag in RAW and not ended:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            body = page[at : stop.start() if stop else end]
            node.children.append(body)
            stack[-1].children.append(node)
            at = stop.start() if stop else end
            if tag == "style" and on_screen(node.attrs.get("media", "")):
                rules += style_rules(body)
            if stop:
                at = (_TOKEN.match(page, at) or stop).end()
        elif tag in VOID or ended:
            stack[-1].children.append(node)
        else:
            push(node)
    if at < end:
        stack[-1].children.append(page[at:])
    return root, indexed(rules)


def shown(node: Node, styles: dict, visible: bool = True) -> tuple[bool, bool]:
    """Whether an element is displayed, and whether its own text is visible."""
    if node.tag in NEVER_SHOWN:
        return False, visible
    rules = styles.get(("", node.tag), [])
    if not node.raw and node.tag != "dialog" and not rules:
        return True, visible
    attrs = node.attrs
    if styles:
        rules = rules + [r for c in set(attrs.get("class", "").split()) for r in styles.get((".", c), [])] + styles.get(("#", attrs.get("id", "")), [])
    best: dict[str, tuple] = {"display": ((), "none" if "hidden" in attrs or node.tag == "dialog" and "open" not in attrs else ""), "visibility": ((), "")}
    for rank, tag, what, value in rules:
        if tag in ("", node.tag) and rank > best[what][0]:
            best[what] = rank, value
    if "style" in attrs:
        for what, (value, important) in declarations(_NOISE.sub("", attrs["style"])).items():
            if (important, True) > best[what][0]:
                best[what] = (important, True), value
    value = best["visibility"][1]
    return best["display"][1] != "none", value in ("visible", "initial") or visible and value not in ("hidden", "collapse")


def finished(call):
    """The result of a generator that yields the calls whose results it needs,
    so that depth isn't bounded by Python's stack."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _below(node: Node, tag: str) -> list[Node]:
    """The elements of a name inside another, in order."""
    out, work = [], node.children[::-1]
    while work:
        c = work.pop()
        if isinstance(c, Node):
            if c.tag == tag:
                out.append(c)
            else:
                work += c.children[::-1]
    return out


def _labels(svg: Node, styles: dict, visible: bool) -> list[tuple[Node, bool]]:
    """The texts of a drawing, each as a block."""

    def placed(node: Node) -> bool:
        box = re.split(r"[\s,]+", node.attrs.get("viewbox", "").strip())
        return not PLACING.isdisjoint(node.attrs) or len(box) > 1 and box[1].startswith("-")

    out, work = [], [(c, placed(svg), visible) for c in reversed(svg.children)]
    while work:
        c, moved, visible = work.pop()
        if isinstance(c, str) or c.tag in DEFINED or c.attrs.get("display") == "none":
            continue
        display, visible = shown(c, styles, visible)
        moved = moved or placed(c)
        if display and c.tag == "foreignobject" or display and c.tag == "text" and (moved or any(placed(t) for t in _below(c, "tspan"))):
            label = Node("#label")
            label.children = c.children
            out.append((label, visible and c.attrs.get("visibility") != "hidden"))
        elif display and c.tag != "text":
            work += [(x, moved, visible) for x in reversed(c.children)]
    return out


class Lines:
    """Lines under construction; margins and white space collapse."""

    def __init__(self):
        self.out: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.indent: list[str] = []
        self.marker = ""

    def text(self, t: str) -> None:
        t = _SPACE.sub(" ", t)
        if t[0] == " " and (not self.now or self.now[-1].endswith(" ")):
            t = t[1:]
        if t:
            self.now.append(t)

    def flush(self) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line:
            self.line(line)

    def line(self, line: str) -> None:
        if self.gap and self.out:
            self.out.append("")
        self.gap = False
        lead = "".join(self.indent)
        if self.marker:
            lead, self.marker = lead[: len(lead) - len(self.marker)] + self.marker, ""
        self.out.append((lead + line).rstrip(" "))

    def forced(self) -> None:
        if "".join(self.now).strip(" "):
            self.flush()
        elif self.out and not self.gap:
            self.now = []
            self.out.append("")


def _number(text: str | None, other: int) -> int:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text.strip()) else other


def _render(top: list, styles: dict, visible: bool = True, pre: bool = False):
    lines = Lines()
    counts: list[list] = []  # of each open list: whether numbered, and the next number
    work: list[tuple] = [("in", c, pre, visible) for c in reversed(top)]
    while work:
        what, node, pre, visible = work.pop()
        if what == "out":
            lines.flush()
            if node.tag in ("ul", "ol", "menu", "dir"):
                counts.pop()
            if node.tag == "li" or node.tag in ("dd", "blockquote"):
                lines.indent.pop()
                lines.marker = ""
            lines.gap |= node.tag in SPACED and not (counts and node.tag in ("ul", "ol", "menu"))
            continue
        if isinstance(node, str):
            if not visible:
                continue
            t = (html.unescape(node) if "&" in node else node).replace("\r\n", "\n").replace("\x00", "")
            if pre:
                first, *more = t.split("\n")
                lines.now.append(first)
                for x in more:
                    line, lines.now = "".join(lines.now), [x]
                    lines.line(line)
            elif t:
                lines.text(t)
            continue
        tag = node.tag
        display, visible = shown(node, styles, visible)
        if not display:
            continue
        if tag == "br":
            if visible:
                lines.forced()
            continue
        if tag == "select":
            options = _below(node, "option")
            chosen = [c for c in options if "selected" in c.attrs] or options[:1]
            work += [("in", c, pre, visible) for o in reversed(chosen) for c in reversed(o.children)]
            continue
        if tag == "svg":
            work += [("in", c, pre, v) for c, v in reversed(_labels(node, styles, visible))]
            continue
        if tag == "table":
            lines.flush()
            lines.gap = True
            for line in (yield _table(node, styles, visible)):
                lines.line(line)
            lines.gap = True
            continue
        if tag in BLOCKS or tag == "#label":
            lines.flush()
            inner = bool(counts) and tag in ("ul", "ol", "menu")
            lines.gap |= tag in SPACED and not inner and not lines.marker
            if tag in ("ul", "ol", "menu", "dir"):
                counts.append([tag == "ol", _number(node.attrs.get("start"), 1)])
            elif tag == "li":
                marker = "- "
                if counts and counts[-1][0]:
                    value = _number(node.attrs.get("value"), counts[-1][1])
                    marker, counts[-1][1] = f"{value}. ", value + 1
                lines.indent.append(" " * len(marker))
                lines.marker = marker if visible else ""
            elif tag in ("dd", "blockquote"):
                lines.indent.append("  ")
            work.append(("out", node, pre, visible))
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        pre = pre or tag in ("pre", "textarea", "listing", "xmp")
        if pre and tag in ("pre", "textarea", "listing") and children and isinstance(children[0], str):
            children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]
        if tag in MATH_PARTS:
            children = [x for c in children for x in (" ", c, " ")]
        work += [("in", c, pre, visible) for c in reversed(children)]
    lines.flush()
    while lines.out and not lines.out[-1]:
        lines.out.pop()
    return lines.out


def render(top: list, styles: dict) -> list[str]:
    return finished(_render(top, styles))


def _table(table: Node, styles: dict, visible: bool):
    """Lines of the table's rows, with the cells of each column aligned."""
    before: list[str] = []
    rows: list[tuple[int, list[tuple[int, int, list[str]]]]] = []  # the row's group, and its cells
    stray: list = []
    work = [(c, 0, visible) for c in reversed(table.children)]
    groups = 0
    while work:
        c, group, seen = work.pop()
        if isinstance(c, str):
            if c.strip():
                stray.append(c)
            continue
        if c.tag not in PARTS and c.tag not in ("caption", "tr"):
            stray.append(c)
            continue
        display, seen = shown(c, styles, seen)
        if not display:
            continue
        if c.tag == "caption":
            before += yield _render(c.children, styles, seen)
        elif c.tag == "tr":
            cells = []
            for x in c.children:
                if isinstance(x, Node) and x.tag in ("td", "th"):
                    display, cell_seen = shown(x, styles, seen)
                    lines = (yield _render(x.children, styles, cell_seen)) if display else []
                    cells.append((max(1, min(1000, _number(x.attrs.get("colspan"), 1))), max(0, _number(x.attrs.get("rowspan"), 1)), lines))
                elif isinstance(x, Node) or x.strip():
                    stray.append(x)
            rows.append((group, cells))
        else:
            groups += 1
            work += [(x, groups, seen) for x in reversed(c.children)]
    placed: list[list[tuple[int, int, list[str]]]] = []  # of each row: column, columns, lines
    held: list[list] = []  # of cells from rows above: column, columns, and the rows still to come (-1: all of the group)
    for i, (group, cells) in enumerate(rows):
        if i and group != rows[i - 1][0]:
            held = []
        row, below, at, waiting = [], [], 0, held[::-1]
        for span, down, lines in cells:
            while waiting and waiting[-1][0] < at + 1:
                row.append((waiting[-1][0], waiting[-1][1], []))
                at = max(at, sum(waiting.pop()[:2]))
            if waiting and at + span > waiting[-1][0]:  # as many columns as are free
                span = waiting[-1][0] - at
            row.append((at, span, lines))
            if down != 1:
                below.append([at, span, down - 1])
            at += span
        row += [(x[0], x[1], []) for x in reversed(waiting)]
        placed.append(row)
        held = sorted([[a, n, k - 1 if k > 0 else k] for a, n, k in held if k != 1] + below)
    widths: dict[int, int] = {}
    spans = []
    for row in placed:
        for at, span, cell in row:
            width = max(map(len, cell), default=0)
            if span == 1:
                widths[at] = max(widths.get(at, 0), width)
            else:
                spans.append((at, span, width))
    for at, span, width in spans:
        have = sum(widths.get(i, 0) for i in range(at, at + span)) + 3 * (span - 1)
        if have < width:
            widths[at] = widths.get(at, 0) + width - have
    out = (yield _render(stray, styles, visible)) + before  # text between cells is moved before the table, as browsers do
    for row in placed:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            parts, end = [], 0
            for at, span, cell in row:
                parts += ["".ljust(widths.get(i, 0)) for i in range(end, at)]
                parts.append((cell[k] if k < len(cell) else "").ljust(sum(widths.get(i, 0) for i in range(at, at + span)) + 3 * (span - 1)))
                end = at + span
            out.append(" | ".join(parts).rstrip(" "))
    return out


def text_of(page: str | None) -> str | None:
    if page is None:
        return None
    root, styles = build(page)
    return "\n".join(render([root], styles)).replace("\xa0", " ")


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``key, text`` for each row."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.record_batch([part.column(0), pa.array([text_of(p) for p in part.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = type_of(pages, key).simpleString()
    return need(pages, key, page).mapInArrow(run, f"`{key}` {kind}, text string")
