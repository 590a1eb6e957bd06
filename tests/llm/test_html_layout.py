"""Layout text: generated pages against their known visible words, tables against a plain layout, time on hostile pages."""

import random
import re
import time

import pytest

from sparqa.llm import html

BLOCKS, INLINE = ["div", "section", "article", "center"], ["b", "i", "span", "em", "a"]


class Page:
    """A random well-formed page that keeps the words a reader sees, in order."""

    def __init__(self, seed):
        self.rng, self.n, self.seen = random.Random(seed), 0, []
        self.page = "<style>.none{display:none} .veil{visibility:hidden} #back{visibility:visible}</style>" + self.inside(0, True, False)

    def word(self, shown):
        self.n += 1
        if shown:
            self.seen.append(f"w{self.n}")
        return f"w{self.n}"

    def inside(self, depth, shown, veiled):
        return "".join(self.part(depth, shown, veiled) for _ in range(self.rng.randrange(1, 5)))

    def part(self, depth, shown, veiled):
        rng = self.rng
        if depth > 5 or rng.random() < 0.4:
            return f" {self.word(shown and not veiled)} "
        kind = rng.choice([*BLOCKS, *INLINE, "p", "ul", "blockquote", "noscript", "template", "details"])
        how = rng.choice(["", "", "", " hidden", " class=none", " class='a veil'", " style='visibility: visible'", " style=display:none", " id=back"])
        if how in (" hidden", " class=none", " style=display:none") or kind in ("noscript", "template"):
            shown = False
        veiled = {" class='a veil'": True, " style='visibility: visible'": False, " id=back": False}.get(how, veiled)
        if kind == "details":
            return f"<details{how}><summary>{self.word(shown and not veiled)}</summary>{self.inside(depth + 1, False, veiled)}</details>"
        if kind == "ul":
            return f"<ul{how}>" + "".join(f"<li>{self.inside(depth + 1, shown, veiled)}" for _ in range(2)) + "</ul>"
        if kind == "p":
            return f"<p{how}> {self.word(shown and not veiled)} <b>{self.word(shown and not veiled)}</b></p>"
        if kind in INLINE:
            return f"<{kind}{how}> {self.word(shown and not veiled)} </{kind}>"
        return f"<{kind}{how}>{self.inside(depth + 1, shown, veiled)}</{kind}>"


def test_generated_pages_show_their_visible_words_in_order():
    for seed in range(500):
        p = Page(seed)
        assert re.findall(r"w\d+", html.render(p.page)) == p.seen, p.page


def _plain_table(rows):
    """Lines of a table of text cells, by the definition."""
    n = max(map(len, rows))
    width = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(n)]
    return [("  ".join(x.ljust(width[c]) for c, x in enumerate(r))).rstrip() for r in rows]


def test_tables_line_up():
    rng = random.Random(5)
    for _ in range(200):
        rows = [["x" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows) + "</table>"
        assert html.render(page).split("\n") == _plain_table(rows)


def test_nested_tables_keep_their_place():
    inner = "<table><tr><td>b<td>y<br>z<tr><td>bbb<td></table>"
    assert html.render(f"<table><tr><td>a<td>{inner}<tr><td>long<td>q<td>r</table>").split("\n") == ["a     b    y", "           z", "      bbb", "long  q       r"]
    assert html.render(f"<table><tr><td>a<td>{inner}<tr><td>long<td>q</table>").split("\n") == ["a     b    y", "           z", "      bbb", "long  q"]
    assert html.render(f"<table><tr><td>a<br>c<td>{inner}</table>").split("\n") == ["a  b    y", "c       z", "   bbb"]
    assert html.render(f"<table><tr><td>{inner}<td>t</table>").split("\n") == ["b    y  t", "     z", "bbb"]


def test_wide_characters_take_two_columns():
    assert html.render("<table><tr><td>日本<td>a<tr><td>xyzab<td>b</table>") == "日本   a\nxyzab  b"


def test_visibility_is_inherited_and_undone():
    page = "<div style='visibility:hidden'>x<p>x<b style='visibility:visible'>w1</b>x</p><table><tr><td>x<td style='visibility:visible'>w2</table><pre>x<i style='visibility:visible'>w3</i></pre></div>w4"
    assert re.findall(r"\w+", html.render(page)) == ["w1", "w2", "w3", "w4"]
    assert html.render("<noscript>x</noscript>a<br><br>b<br>c") == "a\n\nb\nc"


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "x", "<b>x " * 100_000, "<b>" * 50_000 + "</i>x" * 50_000, "<div>" * 50_000 + "</i>x" * 50_000, "<div><p>x" * 50_000, "<p>x" * 100_000,
    "<table><tr><td>x" * 50_000, "<table><tr><td>a<td>x" * 1000, "<font><table>" * 20_000, "<li>x" * 100_000, "<td>x" * 100_000, "<a" * 100_000, "<!--" * 50_000, "&amp" * 100_000,
])
def test_time_follows_the_page(page):
    t = time.process_time()
    html.render(page)
    assert time.process_time() - t < 15  # some ten times what it takes here
