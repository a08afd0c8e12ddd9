"""Markup that HTML allows: omitted end tags, listed words on inline elements, parts inside parts."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from nightgrid.llm import pages

CASES = {
    '<article><p class="advert">Buy now<p>Real text here</article>': "Real text here",
    "<article><table><tr><td>1<td class=ad>2<tr><td>3</table></article>": "1\n3",
    '<article><ul><li class="ad">x<li>kept item</ul></article>': "kept item",
    "<article><dl><dt class=ad>t<dd>d<dt>u</dl></article>": "d\nu",
    '<article><p>The <span class="share">share</span> price <a class="related-link">rose</a> today</article>': "The share price rose today",
    '<article><p>x <b class="notice">important</b> y</p></article>': "x important y",
    "<article><p>x <span hidden>secret</span> y</p></article>": "x y",
    "<article><p>a <button>press</button> b <select><option>1<option>2</select> c</p></article>": "a b c",
    "<main><p>intro</p><article>card</article><p>outro</p></main>": "intro\ncard\noutro",
    "<nav>n</nav><main><p>one<aside>no</aside>two</main><p>outside": "one\ntwo",
    "<article><ul><li>a<ul><li class=ad>b</ul>c<li>d</ul></article>": "a\nc\nd",
    "<article><p>first<div class=sidebar><p>no<p>no</div><p>last</article>": "first\nlast",
    "<article><p>open<hr>rule<p hidden>gone<h2>head</h2></article>": "open\nrule\nhead",
    "<article><table><thead><tr><th class=ad>h<tbody><tr><td>v</table></article>": "v",
    "<article>a<span hidden><div>x</div></span>b</article>": "a\nb",
    "<div class=content><p>named</p></div><p>not</p>": "named",
}


@pytest.mark.parametrize("html", CASES)
def test_blocks_of_legal_markup(html):
    assert pages.decide(html) == (CASES[html], [])


def test_omitted_end_tags_equal_written_ones():
    full = "<article><ul><li>a</li><li class='menu'>b</li><li>c</li></ul><p>d</p><p class='promo'>e</p><table><tr><td>f</td><td>g</td></tr></table></article>"
    for tag in ("</li>", "</p>", "</td>", "</tr>"):
        full_without = full.replace(tag, "")
        assert pages.decide(full_without) == pages.decide(full)


def test_a_spelling_is_read_once(monkeypatch):
    html = '<nav class="menu"><ul><li><a href="/a">a</a></ul></nav><article><h1 id=t>T</h1><p>x<p>y<p>z</article><footer>f</footer>'
    read, part_of = [], pages.part_of
    monkeypatch.setattr(pages, "part_of", lambda tag, attributes: read.append(tag) or part_of(tag, attributes))
    stretches = pages._stretches(iter([pa.RecordBatch.from_pydict({"page_id": range(50), "url": ["http://h"] * 50, "html": [html] * 50})]), 8, 10**6)
    rows = [r for s in stretches for r in s.rows]
    assert [r[2] for r in rows] == [[(pages.ARTICLE, t) for t in "Txyz"]] * 50 and [[t for _, t in r[3]] for r in rows] == [["a", "f"]] * 50
    assert sorted(read) == sorted(["nav", "ul", "li", "a", "article", "h1", "p", "footer"])


def test_kept_spellings_change_no_page(monkeypatch):
    monkeypatch.setattr(pages, "KEPT_TAGS", 20)
    rng = random.Random(9)
    pieces = ["<", ">", "<p>", "</p>", '<p class="ad">', "<p class='ad' >", '<p title="a', '">', "'", "x y", "&amp;", "<!--", "-->", "<!-- c -->", "<br/>", "<b hidden>", "</b>", "<li>",
              "<div id=menu>", "</div>", "<DIV>", "<article>", "</article>", "<script>", "</script >", "<svg/>", "<a href=/x>", "</a", "<p\n>", "<!doctype x>", "</ >", "<p/>", "<hr class=ad>",
              "<p data-a='>' class=ad>", f"<p title='{'t' * pages.KEPT_CHARS}'>", "<"]
    kept = pages.Scanner()
    for _ in range(4000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        got, want = [], []
        assert (pages.blocks(html, kept, got), got) == (pages.blocks(html, pages.Scanner(), want), want), html
        assert pages.blocks(html, kept) == pages.blocks(html), html
    assert 0 < len(kept.kept) <= 20


@pytest.mark.parametrize("tag, attributes, part", [
    ("a", ' class="ad" href="/x"', None), ("a", ' class="x" ROLE="navigation"', pages.BOILER), ("span", " class=x STYLE='display : none'", pages.BOILER),
    ("b", " HIDDEN", pages.BOILER), ("span", " itemProp=articleBody", pages.MAIN), ("div", ' CLASS="ad"', pages.BOILER), ("div", ' width="3"', None),
    ("section", " ID=story", pages.MAIN), ("p", " data-role=main", None)])
def test_attributes_that_say_something(tag, attributes, part):
    assert pages.part_of(tag, attributes) == part


def test_links_and_images_are_not_parsed(monkeypatch):
    parsed, finditer = [], re.finditer
    monkeypatch.setattr(re, "finditer", lambda pattern, text: parsed.append(text) or finditer(pattern, text))
    html = "".join(f'<p><a class="l{i}" href="/{i}" title="t">x</a><img class=ad src="/{i}.png">' for i in range(9))
    assert pages.blocks(html) == [(pages.OPEN, "x")] * 9 and not parsed
