"""HTML extraction against a plain recursive renderer on random pages with tables, spans and attributes, and at extremes."""

import random

import pytest

from ledgerloom.llm import html_text

HIDE = {"hidden": "gone", 'style="display:none"': "gone", "STYLE='color:red; Display : NONE'": "gone", 'style="visibility:hidden"': "dim", 'style="visibility:visible"': "bright", 'style="backface-visibility:hidden"': "", 'class="hidden"': "", "": ""}


class Maker:
    """Random pages as trees (tag, attribute, children or words)."""

    def __init__(self, seed):
        self.r, self.n = random.Random(seed), 0

    def word(self):
        self.n += 1
        return f"w{self.n}" + "x" * (self.r.randrange(60, 250) if self.r.random() < 0.03 else self.r.randrange(0, 12))

    def attr(self):
        return self.r.choice(list(HIDE)) if self.r.random() < 0.35 else ""

    def inline(self):
        return [("span", self.attr(), [" ".join(self.word() for _ in range(self.r.randrange(1, 4)))]) if self.r.random() < 0.3 else " ".join(self.word() for _ in range(30)) if self.r.random() < 0.05 else self.word() for _ in range(self.r.randrange(1, 4))]

    def blocks(self, depth):
        return [self.block(depth) for _ in range(self.r.randrange(1, 4))]

    def block(self, depth):
        kind = self.r.choice(["p", "p", "div", "table", "section"] if depth < 3 else ["p"])
        if kind == "p":
            return ("p", self.attr(), self.inline())
        if kind == "table":
            rows = []
            for _ in range(self.r.randrange(1, 5)):
                cells = []
                for _ in range(self.r.randrange(1, 5)):
                    span = "".join(f' {k}="{self.r.randrange(1, 4)}"' for k in ("colspan", "rowspan") if self.r.random() < 0.25)
                    kids = self.blocks(depth + 1) if self.r.random() < 0.1 else self.inline()
                    cells.append((self.r.choice(["td", "th"]), (self.attr() + span).strip(), kids))
                rows.append(("tr", self.attr(), cells))
            return ("table", self.attr(), rows)
        return (kind, self.attr(), self.blocks(depth + 1))


def source(node):
    if isinstance(node, str):
        return node
    tag, attr, kids = node
    return f"<{tag}{' ' + attr if attr else ''}>" + " ".join(map(source, kids)) + f"</{tag}>"


def fate(attr):
    """What the attribute (without spans) does."""
    return next((v for k, v in HIDE.items() if k and attr.startswith(k)), "")


def lines_of(kids, dim):
    """Lines of children, by recursion: events are ("break", n) and ("text", s) and ("line", s)."""
    events = []

    def walk(node, dim):
        if isinstance(node, str):
            if not dim:
                events.append(("text", node))
            return
        tag, attr, kids = node
        what = fate(attr)
        if what == "gone":
            return
        dim = {"dim": True, "bright": False}.get(what, dim)
        want = {"p": 2, "table": 2, "div": 1, "section": 1}.get(tag, 0)
        if want:
            events.append(("break", want))
        if tag == "table":
            events.extend(("line", x) for x in grid(kids, dim))
        else:
            for k in kids:
                walk(k, dim)
        if want:
            events.append(("break", want))

    for k in kids:
        walk(k, dim)
    out, now, want = [], [], 0

    def end():
        nonlocal now, want
        if now:
            if out and want > 1:
                out.append("")
            out.append(" ".join(now))
            now, want = [], 0

    raw = False
    for kind, x in events:
        if kind == "text":
            now.append(x)
        elif kind == "break":
            end()
            want, raw = max(want, x), False
        else:
            end()
            if out and want > 1 and not raw:
                out.append("")
            out.append(x)
            want, raw = 0, True
    end()
    return out


def wrapped(line, most):
    """A line cut at its last blank that leaves at most so many characters, or there if it has none."""
    if len(line) <= most:
        return [line]
    blanks = [i for i in range(most + 1) if line[i] == " " and line[:i].strip()]
    at = blanks[-1] if blanks else most
    return [x for x in (line[:at].rstrip(" "), *wrapped(line[at:].lstrip(" "), most)) if x]


def grid(rows, dim):
    """Lines of a table from an explicit grid of places."""
    taken, placed, r = {}, [], -1
    for _, attr, cells in rows:
        what = fate(attr)
        if what == "gone":
            continue
        low = {"dim": True, "bright": False}.get(what, dim)
        r += 1
        row, at = [], 0

        def skip(at, row, r=r):
            while (r, at) in taken:
                c, w = taken[r, at]
                row.append((None, c + w - at))
                at = c + w
            return at

        for _, cell_attr, kids in cells:
            what = fate(cell_attr)
            if what == "gone":
                continue
            own = {"dim": True, "bright": False}.get(what, low)
            number = lambda k, a=cell_attr: int(a.split(f'{k}="')[1][0]) if f'{k}="' in a else 1
            at = skip(at, row)
            for below in range(1, number("rowspan")):
                for c in range(at, at + number("colspan")):
                    taken.setdefault((r + below, c), (at, number("colspan")))
            row.append(("\n".join(lines_of(kids, own)), number("colspan")))
            at += number("colspan")
        while any(k[0] == r and k[1] >= at for k in taken):
            c = min(k[1] for k in taken if k[0] == r and k[1] >= at)
            if c > at:
                row.append((None, c - at))
                at = c
            at = skip(at, row)
        placed.append(row)
    # (text or None, columns) becomes (first column, last column, lines, cell or not).
    table = []
    for row in placed:
        at, new = 0, []
        for text, span in row:
            new.append([at, at + span - 1, text.split("\n") if text else [], text is not None])
            at += span
        table.append(new)
    last = max([c[0] for row in table for c in row if c[3]], default=0)
    widths = {}
    taken_by = lambda a, z: sum(widths.get(c, 0) for c in range(a, z + 1)) + 3 * (z - a)
    for wide in (False, True):
        for cell in (c for row in table for c in row if c[2] and c[1] < last and (c[1] > c[0]) == wide):
            most = max(html_text.WIDE, taken_by(*cell[:2])) if wide else html_text.WIDE
            cell[2] = [x for line in cell[2] for x in wrapped(line, most)]
            short = max(map(len, cell[2])) - taken_by(*cell[:2])
            widths[cell[1]] = widths.get(cell[1], 0) + max(0, short)
    out = []
    for row in table:
        for i in range(max((len(c[2]) for c in row), default=0)):
            out.append(" | ".join((lines[i] if i < len(lines) else "").ljust(taken_by(a, z)) for a, z, lines, _ in row).rstrip(" "))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_random_pages(seed):
    for k in range(60):
        kids = Maker(seed * 1000 + k).blocks(0)
        page = " ".join(map(source, kids))
        assert html_text.page_text(page).split("\n") == (lines_of(kids, False) or [""]), page


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes <b>b</b></p></div>", "yes b"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "| yes"),
        ("<table><tr style='visibility:collapse'><td>no<tr><td>yes</table>", "yes"),
        ("<details><summary>sum</summary>no<p>no</details><details open><summary>s2</summary>yes</details>", "sum\ns2\nyes"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<svg visibility=hidden><text>no</text><text visibility=visible>yes</text></svg>", "yes"),
    ],
)
def test_inherited(page, text):
    assert html_text.page_text(page).strip() == text


def test_no_depth_changes_what_is_seen():
    for n in (8, 9, 511, 512, 513, 5000):
        assert html_text.page_text("<div>" * n + "<p hidden>secret</p><p>x" + "</div>" * n) == "x"
        assert html_text.page_text("<table><tr><td>" * n + "a<td>b") == "a | b"


def test_one_page_is_bounded():
    """Whatever a page holds, what comes out is bounded by its length, and no text is lost."""
    wide = "<table><tr><td>" + "x" * 30_000 + "<td>b" + "<tr><td>a<td>b" * 3000 + "</table>"
    pages = [
        wide,
        "<table><tr><td colspan=" + "9" * 5000 + ">w<td>w</table>",
        "<table>" + "<td rowspan=65534>w" * 1000 + "<tr><td>w" * 5000,
        "<table><tr>" + "<td>w" * 1000 + "<td>" + "<br>w" * 20_000,
        "<ul><li>w" * 10_000,
        "<table><tr><td>w<td>" * 2000,
        "<b>" * 50_000 + "</i>" * 50_000 + "w",
        "<svg/>" + "<i>" * 50_000 + "w",
        "<p " + "a" * 200_000 + ">w",
        "<table><tr><td rowspan=" + "0" * 50 + "2 colspan=0>w<td>w<tr><td>w",
    ]
    for page in pages:
        text = html_text.page_text(page)
        assert len(text) <= (html_text.ALIGN + html_text.WIDE // 4 + 4) * len(page) + 2 * html_text.ALIGN_LEAST
        assert text.count("w") == page.count(">w")
    assert html_text.page_text(wide).count("a" + " " * (html_text.WIDE - 1) + " | b") == 3000


@pytest.mark.parametrize(
    "page, text",
    [
        ("<ol><li>a<li value=9>b<li>c</ol>", "1. a\n9. b\n10. c"),
        ("<ol reversed><li>a<li hidden>n<li>b<ol><li>x</ol></ol>", "2. a\n1. b\n   1. x"),
        ("<ol reversed start=7><li>a<li value=-2>b<li>c</ol>", "7. a\n-2. b\n-3. c"),
        ("<ul><li value=9>a</ul><ol start=x><li value=y>b</ol>", "- a\n\n1. b"),
        ("<table><tfoot><tr><td>f</tfoot><tr><td>a<thead><tr><td>h</table>", "h\na\nf"),
        ("<table><tr><td rowspan=2>a<td>b<tfoot><tr><td>f<td>g</tfoot><tr><td>c<td>d</table>", "a | b\nc | d\nf | g"),
    ],
)
def test_order_and_numbers(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    "sheet, seen",
    [
        ("", "abcd"),
        (".x{display:none}", "bd"),
        ("#one { color:red; display : NONE } ", "bcd"),
        ("p.x, q{visibility:hidden}", "bcd"),
        ("span{display:none}p{display:block}", "abd"),
        (".x{display:none} .x{display:inline}", "abcd"),
        (".x{display:none!important} p.x{display:block}", "bd"),
        (".x{display:none} #one{display:block}", "abd"),
        ("div .x{display:none} .x:hover{display:none} [id]{display:none}", "abcd"),
        ("@media print{.x{display:none}} @import 'a'; b{display:none}", "acd"),
        ("@media screen and (min-width:9px){.x{display:none}} @media (max-width:9px){b{display:none}}", "bd"),
        ("/* .x{display:none} */ .y\\:z{display:none}", "abc"),
        ("*{visibility:hidden} .x{visibility:visible}", "ac"),
        (".x{display:none", "bd"),
        ("u{display:block}", "abcdh"),
    ],
)
def test_rules_of_the_page(sheet, seen):
    page = f"<style>{sheet}</style><p class=x id=one>a</p><b>b</b><span class='w x'>c</span><i class='y:z'>d</i><u hidden>h</u><s style='display:none'>n</s>"
    assert html_text.page_text(page).replace("\n", "").replace(" ", "") == seen


def test_cells_align_at_any_width():
    for n in (99, 100, 101, 250, 5000):
        text = html_text.page_text(f"<table><tr><td>{'w' * n}<td>b<tr><td>x<td>y<tr><td>{'u ' * n}<td>z<tr><td colspan=2>{'v' * n}</table>")
        lines = text.split("\n")
        assert {line.index("|") for line in lines if line[0] in "wxu"} == {min(n, 100) + 1 if n > 99 else 100}
        assert text.count("w") == text.count("u") == text.count("v") == n and lines[-1] == "v" * n


def test_a_sheet_of_many_rules():
    page = "<style>" + "".join(f".c{i}.d{i % 50}{{display:none}}" for i in range(20_000)) + "</style>" + "".join(f"<i class='c{i} d{i % 50}'>n</i><i class='c{i}'>w</i>" for i in range(0, 20_000, 2))
    assert html_text.page_text(page) == "w" * 10_000
