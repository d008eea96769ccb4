"""Visible text of HTML pages, laid out as blocks, lists and aligned tables (operator 6).

A tokenizer feeds a tree builder that supplies implied tags; visibility follows the element, its attributes, the page's own
style rules and what it inherits; the rendering walks the tree with its own stacks, tables in cells of tables too, so no depth
is too great. Cells that something stands to the right of are broken into lines of WIDE characters at most, so columns align
at any width of their texts and a cell's padding is bounded. Only blanks where a line has no cell of its own (places that
spans and cells above reach over, lines below a short cell, indents) come from a stock that grows with the page, so that no
page gives more than a fixed multiple of its length; what has no stock left stands unaligned, but stands.

Of style rules, selectors of one element (its tag, classes and id) count, with display and visibility, in the page's order
and by specificity, inside of @media too where it asks for a screen and for no more than a least width. Selectors with
combinators, attributes or pseudo-classes, imported sheets and scripts are not looked at.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restored, set_aside

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is one text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist".split())
#: What is not rendered inside of svg and math.
FOREIGN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask pattern marker".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Elements in svg and math whose content is HTML again.
ISLANDS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: HTML elements that end an svg or math they stand in.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Formulas whose parts stand in different places.
PLACES = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul xmp caption".split())
#: Blocks with an empty line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul xmp".split())
#: A start tag closes the open elements named here, as far as the scope elements of the second list.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("table",)),
    "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ()),
    "h1": (("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section", "article", "td", "th", "li")),
}
for _h in ("h2", "h3", "h4", "h5", "h6"):
    CLOSES[_h] = CLOSES["h1"]
#: A p ends before these.
ENDS_P = BLOCK - frozenset("body html li td th tr tbody thead tfoot caption option optgroup select legend summary dd dt".split()) | {"li", "dd", "dt"}
#: Elements an end tag of another element doesn't reach past.
WALLS = frozenset("table td th caption html template".split())
HEAD = frozenset("title meta link style script base noscript template".split())

#: Characters of blanks where no cell stands, for each character of a page, and for any page.
ALIGN, ALIGN_LEAST = 64, 10_000
#: A cell with something to its right is broken into lines of so many characters at most, so no column is wider.
WIDE = 100

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Declarations of a style; a string or bracket that doesn't end runs to the end.
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
DECLARATION = re.compile(r"(?:[^;\"'(]++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z))++")
IMPORTANT = re.compile(r"\s*!\s*important\s*\Z")
#: A selector of one element, its parts, and media that a wide screen is.
COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#](?:[\w-]|[^\x00-\x7F]|\\[^0-9a-fA-F\n])+)*)\Z", re.A)
PART = re.compile(r"([.#])((?:\\.|[^.#\\])+)", re.S)
SCREEN = re.compile(r"(?:only\s+)?(?:(?:screen|all)(?:\s+and\s+(?=\()|\s*\Z)|(?=\())(?:\(\s*min-width\s*:[^()]*\)(?:\s+and\s+(?=\()|\s*\Z))*\Z")


class Node:
    """An element. how: "unseen" or "apart" (from what stands before) where svg or math says so; inside: svg or math, if it is part of one; rules: what style rules say of display and visibility, see ``styled``."""

    __slots__ = ("tag", "attrs", "kids", "how", "inside", "rules")

    def __init__(self, tag: str, attrs: str = "", inside: str = ""):
        self.tag, self.attrs, self.kids, self.how, self.inside, self.rules = tag, attrs, [], "", inside, None


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a style's declarations, each as (important, value). The last of a property counts, important ones first."""
    low = style.lower()
    value: dict[str, tuple[bool, str]] = {}
    if "display" not in low and "visibility" not in low:
        return value
    for d in DECLARATION.findall(COMMENT.sub(" ", low)):
        name, colon, rest = d.partition(":")
        name, plain = name.strip(), IMPORTANT.sub("", rest).strip()
        must = plain != rest.strip()
        if name in ("display", "visibility") and colon and plain and (must or not value.get(name, (False,))[0]):
            value[name] = must, plain
    return value


def rules(sheet: str) -> list[tuple[str, list[tuple[str, str]], dict]]:
    """(tag or "", ids and classes as ("#" or ".", name), what is declared) of a sheet's rules of display and visibility for single elements, in order."""
    out: list = []
    low = sheet.lower()
    if "display" not in low and "visibility" not in low:
        return out
    sheet = COMMENT.sub(" ", sheet).replace("<!--", " ").replace("-->", " ")
    at = 0
    for sign in re.finditer(r"[{};]", sheet):
        if sign.start() < at:
            continue
        head, at = sheet[at : sign.start()].strip(), sign.end()
        # Of media that hold, the bracket is passed over and the rules inside are read as if they stood outside.
        if sign[0] != "{" or head[:6].lower() == "@media" and any(SCREEN.match(q.strip()) for q in head[6:].lower().split(",")):
            continue
        depth, stop = 1, len(sheet)
        for inner in re.compile(r"[{}]").finditer(sheet, at):
            depth += 1 if inner[0] == "{" else -1
            if not depth:
                stop = inner.start()
                break
        said = {} if head.startswith("@") else declared(sheet[at:stop])
        at = stop + 1
        for selector in head.split(",") if said else []:
            m = COMPOUND.match(selector.strip())
            if m and m[0]:
                out.append(((m[1] or "").lower().replace("*", ""), [(kind, re.sub(r"\\(.)", r"\1", name)) for kind, name in PART.findall(m[2])], said))
    return out


def styled(root: Node, sheets: list[Node]) -> None:
    """Say at each element what the page's own sheets declare for it: the most specific rule counts, of such the last, important ones first."""
    found = []
    for node in sheets:
        media = attributes(node.attrs).get("media", "").strip().lower()
        if not media or any(SCREEN.match(q.strip()) for q in media.split(",")):
            found += rules("".join(node.kids))
    if not found:
        return
    keys = [[*parts, *([("", tag)] if tag or not parts else [])] for tag, parts, _ in found]
    often: dict = {}
    for own in keys:
        for key in own:
            often[key] = often.get(key, 0) + 1
    # A rule is looked for where the rarest of its parts stands.
    at: dict = {}
    for n, (own, (tag, parts, said)) in enumerate(zip(keys, found, strict=True)):
        rank = sum(k == "#" for k, _ in parts), sum(k == "." for k, _ in parts), bool(tag), n
        at.setdefault(min(own, key=often.__getitem__), []).append((rank, set(own) - {("", "")}, said))
    stack = [root]
    while stack:
        node = stack.pop()
        stack += [x for x in node.kids if not isinstance(x, str)]
        have = {("", node.tag)}
        low = node.attrs.lower()
        if "class" in low or "id" in low:
            a = attributes(node.attrs)
            have.update((".", c) for c in a.get("class", "").split())
            have.add(("#", a.get("id", "")))
        best: dict = {}
        for key in (*have, ("", "")):
            for rank, needs, said in at.get(key, ()):
                if needs <= have:
                    for name, (must, value) in said.items():
                        if name not in best or (must, rank) > best[name][0]:
                            best[name] = (must, rank), value
        if best:
            node.rules = {name: (must, value) for name, ((must, _), value) in best.items()}


def empty(attrs: str) -> bool:
    """Whether a tag ends in a slash that is no part of a value without quotes."""
    last = attrs.rsplit(None, 1)[-1] if attrs.endswith("/") else ""
    return bool(last) and ("=" not in last or '"' in last or "'" in last)


class Open:
    """The open elements, with the places of each tag, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {root.tag: [0]}
        self.walls = [0] if root.tag in WALLS else []
        #: For each open element the place of the svg or math that its next child is part of, or 0.
        self.foreign = [0]

    def push(self, node: Node) -> None:
        i, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.places.setdefault(tag, []).append(i)
        if tag in WALLS:
            self.walls.append(i)
        self.foreign.append(i if tag in FOREIGN else 0 if tag in ISLANDS else self.foreign[-1])

    def cut(self, i: int) -> None:
        """Close the elements from place i on."""
        while len(self.stack) > i:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            self.foreign.pop()
            if tag in WALLS:
                self.walls.pop()

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def close(self, names: tuple, scope: tuple) -> None:
        """Close the outermost open element of names inside scope."""
        inside = max([0, *[self.last(tag) for tag in scope if tag not in names]])
        found = [at[k] for tag in names if (at := self.places.get(tag)) and (k := bisect_right(at, inside)) < len(at)]
        if found:
            self.cut(min(found))


#: End tags that reach past walls.
PASSING = frozenset("table tr tbody thead tfoot html body".split())


def parse(page: str) -> Node:
    """The tree of a page; every input has one. An unclosed tag or comment runs to the end."""
    root, sheets = Node("html"), []
    now = Open(root)
    stack = now.stack
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            s = s.replace("\0", "")
            tag = stack[-1].tag
            if tag in ("table", "tbody", "thead", "tfoot", "tr", "head", "colgroup"):
                if not SPACE.sub("", s):
                    return
                if tag == "head":
                    now.cut(len(stack) - 1)
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if now.foreign[-1] and page.startswith("<![CDATA[", lt):
            text(page[at:lt])
            end = page.find("]]>", lt)
            stack[-1].kids.append(page[lt + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        m = TAG.match(page, lt)
        if m is None:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            i = now.last(name)
            if name in ("p", "br") and i < 0:
                stack[-1].kids.append(Node(name))
            elif i > 0 and name not in ("body", "html") and (name in PASSING or not now.walls or now.walls[-1] <= i):
                now.cut(i)
            continue
        if name in ("html", "body") and name in [x.tag for x in stack[:3]]:
            continue
        if stack[-1].tag == "head" and name not in HEAD:
            now.cut(len(stack) - 1)
        inside = now.foreign[-1]
        if inside and name in BREAKOUT:
            # Also out of an svg around a math.
            while inside:
                now.cut(inside)
                inside = now.foreign[-1]
        kind = stack[inside].tag if inside else ""
        if name in CLOSES:
            now.close(*CLOSES[name])
        if name in ENDS_P:
            now.close(("p",), ("table", "td", "th", "caption", "button", "blockquote", "div", "li", "ul", "ol"))
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].kids.append(row)
            now.push(row)
        node = Node(name, m[3], kind)
        if inside:
            if name in FOREIGN[kind]:
                node.how = "unseen"
            elif name == "text" or stack[-1].tag in PLACES and any(not isinstance(x, str) for x in stack[-1].kids):
                node.how = "apart"
        stack[-1].kids.append(node)
        if (inside or name in FOREIGN) and empty(m[3]):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            node.kids.append(html.unescape(body) if name in ("textarea", "title") else body)
            if name == "style":
                sheets.append(node)
            at = n if end is None else page.find(">", end.end()) + 1 or n
        elif name not in VOID:
            now.push(node)
    styled(root, sheets)
    return root


def look(node: Node, dim: bool) -> tuple[bool, bool]:
    """(gone, dim) for a node where text is dim (not seen, but what it holds may be) or not: visibility is inherited, a box that isn't made is gone with all below."""
    if node.tag in HIDDEN or node.how == "unseen" or node.tag == "input":
        return True, dim
    low, drawn = node.attrs, node.inside == "svg" or node.tag == "svg"
    if node.rules is None:
        if not low or low.isspace():
            return node.tag == "dialog", dim
        low = low.lower()
        if "hidden" not in low and "style" not in low and not (drawn and ("display" in low or "visibility" in low)):
            return node.tag == "dialog" and "open" not in attributes(low), dim
    a = attributes(node.attrs)
    # Later ones count, important ones before all others: an svg's attributes, rules of the page, the element's own style.
    said: dict[str, tuple[bool, str]] = {k: (False, a[k].strip().lower()) for k in ("display", "visibility") if drawn and a.get(k)}
    for more in (node.rules or {}, declared(a.get("style", ""))):
        said |= {k: x for k, x in more.items() if x[0] or not said.get(k, (False,))[0]}
    display, visibility = said.get("display", (False, ""))[1], said.get("visibility", (False, ""))[1]
    if display == "none" or not display and ("hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a):
        return True, dim
    if visibility == "collapse" and node.tag in ("tr", "tbody", "thead", "tfoot"):
        return True, dim
    return False, visibility != "visible" if visibility in ("hidden", "collapse", "visible") else dim


def shown(node: Node) -> list:
    """The children that may be seen: of closed details only the summary."""
    if node.tag == "details" and "open" not in attributes(node.attrs):
        return [x for x in node.kids if not isinstance(x, str) and x.tag == "summary"][:1]
    return node.kids


class Room:
    """The stock of blanks for alignment that a page has."""

    def __init__(self, size: int):
        self.left = ALIGN * size + ALIGN_LEAST

    def take(self, n: int) -> bool:
        if n > self.left:
            return False
        self.left -= n
        return True


class Page:
    """Lines under construction: inline text collapses its blanks, blocks ask for line breaks, the most asked for wins."""

    def __init__(self, room: Room):
        self.room = room
        self.lines: list[str] = []
        self.now: list[str] = []
        self.want = 0
        self.indent = [0]
        self.mark = None

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if not s:
            return
        if not self.now or self.now[-1].endswith((" ", "\n")):
            s = s.lstrip(" ")
            if not s:
                return
        if not self.now:
            self._begin()
        self.now.append(s)

    def _begin(self) -> None:
        if self.lines and self.want > 1:
            self.lines.append("")
        self.want = 0
        if self.mark is not None:
            self.now.append(self._margin(-2) + self.mark + " ")
            self.mark = None
        elif self.indent[-1]:
            self.now.append(self._margin(-1))

    def _margin(self, level: int) -> str:
        own = self.indent[level]
        return " " * own if self.room.take(own) else ""

    def flush(self) -> None:
        if self.now:
            line = "".join(self.now).rstrip(" ")
            if line.strip():
                self.lines.append(line)
            self.now = []

    def block(self, want: int) -> None:
        self.flush()
        self.want = max(self.want, want)

    def literal(self, lines: list[str]) -> None:
        """Lines that keep their blanks."""
        self.flush()
        for i, line in enumerate(lines):
            if i == 0:
                self._begin()
                self.lines.append(("".join(self.now) + line).rstrip(" \r"))
                self.now = []
            else:
                self.lines.append((self._margin(-1) + line).rstrip(" \r"))


def number(attrs: dict[str, str], name: str, most: int) -> int:
    """A span of a cell, 1 where there is none; the rows of 0 go as far as the row group."""
    span = attrs.get(name, "").strip()
    if not (span.isascii() and span.isdigit()):
        return 1
    n = most if len(span.lstrip("0")) > 9 else min(int(span[-9:]), most)
    return n or (most if name == "rowspan" else 1)


def in_order(table: Node) -> list:
    """(child, its row group) of a table, as shown: the first thead before all others, the first tfoot after them. Rows outside of groups are a group as far as the next one."""
    kids, own = [], object()
    for kid in table.kids:
        if isinstance(kid, str) or kid.tag not in ("tbody", "thead", "tfoot"):
            kids.append((kid, own))
        else:
            kids.append((kid, kid))
            own = object()
    for tag, to in (("thead", 0), ("tfoot", len(kids) - 1)):
        at = next((i for i, (x, _) in enumerate(kids) if not isinstance(x, str) and x.tag == tag), None)
        if at is not None:
            kids.insert(to, kids.pop(at))
    return kids


def cells(table: Node, dim: bool, room: Room) -> tuple[list, list[list[tuple[Node | None, int, bool]]]]:
    """(node, dim) outside of rows, and rows of (cell, columns it spans, dim); None where a cell above reaches down."""
    rows, loose = [], []
    held: list[tuple[int, int, int]] = []  # first column, columns, last row that they are held for
    within, r = None, -1
    stack = [(kid, group, dim) for kid, group in reversed(in_order(table))]
    while stack:
        kid, group, low = stack.pop()
        if isinstance(kid, str):
            if kid.strip():
                loose.append((kid, low))
            continue
        gone, low = look(kid, low)
        if gone:
            continue
        if kid.tag in ("tbody", "thead", "tfoot"):
            stack += [(x, kid, low) for x in reversed(kid.kids)]
        elif kid.tag == "tr":
            if group is not within:
                within, held = group, []
            r += 1
            row, at, above = [], 0, [h for h in held if h[2] >= r]
            if not room.take(3 * len(above)):
                above = []
            held, above = list(above), above[::-1]

            def carry(upto: int | None) -> None:
                """Take the columns held from above that come next, or all of them with a blank for what lies between."""
                nonlocal at
                while above and (upto is None or above[-1][0] <= upto):
                    c, w, _ = above.pop()
                    if c > at:
                        row.append((None, c - at, False))
                        at = c
                    if c + w > at:
                        row.append((None, c + w - at, False))
                        at = c + w
                    upto = None if upto is None else at

            for c in kid.kids:
                if isinstance(c, str):
                    if c.strip():
                        loose.append((c, low))
                elif c.tag in ("td", "th"):
                    gone, own = look(c, low)
                    if gone:
                        continue
                    a = attributes(c.attrs) if c.attrs else {}
                    carry(at)
                    span, down = number(a, "colspan", 1000), number(a, "rowspan", 65534)
                    if down > 1:
                        held.append((at, span, r + down - 1))
                    row.append((c, span, own))
                    at += span
                else:
                    loose.append((c, low))
            carry(None)
            held.sort()
            rows.append(row)
        elif kid.tag not in ("colgroup", "col"):
            loose.append((kid, low))
    return loose, rows


def broken(line: str, most: int) -> list[str]:
    """A line as lines of at most so many characters, broken at blanks, and inside a word only where it is longer than that."""
    out, at = [], 0
    while len(line) - at > most:
        stop = line.rfind(" ", at, at + most + 1)
        if not line[at : max(at, stop)].strip(" "):
            stop = at + most
        out.append(line[at:stop].rstrip(" "))
        at = stop
        while at < len(line) and line[at] == " ":
            at += 1
    return [x for x in (*out, line[at:]) if x] or [""]


def layout(rows: list[list[tuple[list[str], int, bool]]], room: Room) -> list[str]:
    """Lines of a table of cells (lines, columns spanned, whether the page has a cell there), a bar between columns.

    A cell that columns stand to the right of, in whatever row, is broken at WIDE characters, or at what it spans if that is
    more; the others run on. Columns are as wide as their widest cell; a cell that spans several widens the last of them. So
    all rows align. Where a line lacks the stock of blanks for places without a cell, what stands in it has bars between.
    """
    starts, most = 0, 0
    for row in rows:
        at = 0
        for _, span, own in row:
            starts = max(starts, at if own else 0)
            at += span
        most = max(most, at)
    widths = [0] * most
    for single in (True, False):
        for row in rows:
            at = 0
            for k, (lines, span, own) in enumerate(row):
                if lines and (span == 1) == single and at + span <= starts:
                    have = sum(widths[at : at + span]) + 3 * (span - 1)
                    lines = [x for line in lines for x in broken(line, WIDE if single else max(WIDE, have))]
                    row[k] = lines, span, own
                    widths[at + span - 1] += max(0, max(map(len, lines)) - have)
                at += span
    ends = [0, *accumulate(w + 3 for w in widths)]
    out = []
    for row in rows:
        at, places = 0, []
        have: list[dict[int, str]] = []
        for k, (lines, span, _) in enumerate(row):
            places.append(ends[at + span] - ends[at] - 3)
            at += span
            have += [{} for _ in range(len(lines) - len(have))]
            for i, line in enumerate(lines):
                have[i][k] = line
        stock = sum(own for *_, own in row) * (WIDE + 3)
        for texts in have:
            blanks = ends[at] - sum(min(len(x), places[k]) for k, x in texts.items())
            if room.take(max(0, blanks - stock)):
                out.append(" | ".join(texts.get(k, "").ljust(w) for k, w in enumerate(places)).rstrip(" "))
            else:
                out.append(" | ".join(x for x in texts.values() if x))
            stock = 0
    return out


WHOLE = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])", re.A)


def numbering(node: Node, dim: bool) -> list[int]:
    """[number of the first item, step] of an ol: its start, or the number of its items if it is reversed, else 1."""
    a = attributes(node.attrs)
    step = -1 if "reversed" in a else 1
    if m := WHOLE.match(a.get("start", "")):
        return [int(m[1]), step]
    n, stack = 0, list(node.kids) if step < 0 else []
    while stack:
        x = stack.pop()
        if not isinstance(x, str) and not look(x, dim)[0]:
            n += x.tag == "li"
            stack += shown(x) if x.tag not in ("ol", "ul", "menu", "dir") else []
    return [n if step < 0 else 1, step]


class Frame:
    """What is being rendered to lines of its own: the page or a table's cell. stack: (node or text, what ends with it, dim)."""

    def __init__(self, kids: list, dim: bool, out: list[str], room: Room):
        self.page, self.lists, self.out = Page(room), [], out
        self.stack: list = [(kid, None, dim) for kid in reversed(kids)]


class Table:
    """A table on its way to lines: what of it is still to render."""

    def __init__(self, node: Node, dim: bool, room: Room):
        loose, rows = cells(node, dim, room)
        self.outside: list[str] = []
        self.rows = [[([], span, c is not None) for c, span, _ in row] for row in rows]
        parts = [([x], d, self.outside) for x, d in loose]
        parts += [(shown(c), d, out) for row, own in zip(rows, self.rows, strict=True) for (c, _, d), (out, *_) in zip(row, own, strict=True) if c is not None]
        self.todo = parts[::-1]


def render(node: Node, room: Room) -> list[str]:
    """The visible text below node as lines."""
    lines: list[str] = []
    frames = [Frame(node.kids, False, lines, room)]
    while frames:
        frame = frames[-1]
        page, lists, stack = frame.page, frame.lists, frame.stack
        if not stack:
            page.flush()
            frame.out.extend(page.lines)
            frames.pop()
            continue
        kid, ends, dim = stack.pop()
        if ends == "table":
            if kid.todo:
                stack.append((kid, ends, dim))
                frames.append(Frame(*kid.todo.pop(), room))
                continue
            whole = kid.outside + layout(kid.rows, room)
            if whole:
                page.literal(whole)
            page.block(2)
            continue
        if ends is not None:
            if ends == "block":
                page.block(2 if kid.tag in SPACED and not (lists and kid.tag in ("ul", "ol", "menu")) else 1)
            elif ends == "list":
                lists.pop()
                page.block(1 if lists else 2)
            elif ends == "item":
                page.flush()
                page.mark = None
                page.indent.pop()
                page.block(1)
            continue
        if isinstance(kid, str):
            if not dim:
                page.text(kid)
            continue
        gone, dim = look(kid, dim)
        if gone:
            continue
        if kid.how:
            page.text(" ")
        tag = kid.tag
        below = [(x, None, dim) for x in reversed(shown(kid))]
        if tag == "br":
            if page.now:
                page.flush()
            else:
                page.want = max(page.want, 2)
        elif tag == "wbr" or tag in VOID and tag != "hr":
            continue
        elif tag in ("pre", "xmp", "textarea"):
            flat, inner = [], below
            while inner:
                x, _, low = inner.pop()
                if isinstance(x, str):
                    flat.append("" if low else x)
                elif x.tag == "br":
                    flat.append("\n")
                else:
                    gone, low = look(x, low)
                    inner += [] if gone else [(y, None, low) for y in reversed(shown(x))]
            text = "".join(flat)
            page.block(2)
            if text.strip():
                page.literal(text.removeprefix("\n").rstrip("\n").split("\n"))
            page.block(2)
        elif tag == "table":
            page.block(2)
            stack.append((Table(kid, dim, room), "table", dim))
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(1 if lists else 2)
            lists.append(numbering(kid, dim) if tag == "ol" else [None, 0])
            stack.append((kid, "list", dim))
            stack += below
        elif tag == "li":
            page.block(1)
            count = lists[-1] if lists else [None, 0]
            if count[0] is None:
                page.mark = "-"
            else:
                own = WHOLE.match(attributes(kid.attrs).get("value", "")) if kid.attrs else None
                count[0] = int(own[1]) if own else count[0]
                page.mark = f"{count[0]}."
                count[0] += count[1]
            page.indent.append(page.indent[-1] + len(page.mark) + 1)
            stack.append((kid, "item", dim))
            stack += below
        elif tag in BLOCK:
            page.block(2 if tag in SPACED else 1)
            stack.append((kid, "block", dim))
            stack += below
        else:
            stack += below
    return lines


def page_text(page: str | None) -> str | None:
    """The visible text of a page; null for null."""
    return None if page is None else "\n".join(render(parse(page), Room(len(page))))


def extract(pages: DataFrame, column: str = "html", to: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages with to (the visible text of column); keep names the other columns to carry, all but column unless given.

    A null page has a null text, an empty one or one without visible text an empty one. No row depends on another, so
    nothing is shuffled. A column of pages called like to is replaced, all
    others pass, whatever they are called.
    """

    held, at = set_aside(pages, column)
    rest = {old: new for old, new in at.items() if old not in (column, to) and (keep is None or old in keep)}
    rows = held.select(*rest.values(), F.col(at[column]).cast("string").alias("_html"))
    schema = "".join(f"{new} {rows.schema[new].dataType.simpleString()}, " for new in rest.values()) + "_text string"

    def run(batches):
        for batch in batches:
            texts = pa.array([page_text(x) for x in batch.column("_html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest.values()], texts], names=[*rest.values(), "_text"])

    out = rows.mapInArrow(run, schema)
    return out.select(*restored(out, rest), F.col("_text").alias(to))


def op6_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract(pages)


QUERIES = {"op6_html_extraction": op6_html_extraction}
SQL = {}
