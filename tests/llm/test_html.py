"""Main text of pages: bare text, linked paragraphs, hostile markup, the cut against all labellings."""

import itertools
import random
import time

import pytest

from territoria.llm import html_mincut as hm


@pytest.mark.parametrize("html, text", [
    ("line one<br>line two<br><br>line three", "line one line two line three"),
    ("<div>Hi there</div>", "Hi there"),
    ("<nav>Home</nav><div>Hi there</div><footer>end</footer>", "Hi there"),
    ("<nav><a href=x>Home</a></nav><footer>Imprint</footer>", ""),
    ("<div class=sidebar>About us</div>", ""),
    ("<article><h1>Title here</h1><p><a href=x>All of this first paragraph is one link to a source.</a></p>"
     "<p><a href=y>So is the second paragraph, every word of it.</a></p></article>",
     "Title here\n\nAll of this first paragraph is one link to a source.\n\nSo is the second paragraph, every word of it."),
    ("<p title='a > b' class=x>Some words, then <b>bold</b>.<p>More words here.", "Some words, then bold .\n\nMore words here."),
    ("<!-- <p>no --><p>Yes, this is it.</p><!-- never closed <p>nothing", "Yes, this is it."),
    ("<script>if (a < b) { x('<p>no</p>') }</script><p>Text of the page.</p><script>var y", "Text of the page."),
])
def test_texts(html, text):
    assert hm.main_text(html) == text.replace("bold .", "bold.")


@pytest.mark.parametrize("part", ["<b>", "</i>", "<a \"", "<a '>", "<svg>", "<button>", "<!", "<a", "<x \"'>", "<p>a", "<div><b>", "</div>t",
                                  "<li>x</ul>", "<table><td>", "<p><article>", "<a href=\"x>y", "&amp", "<script", "<!--", "<script>"])
def test_hostile_pages_take_linear_time(part):
    for page in (part * (1_000_000 // len(part)), "<b>" * 150_000 + part * (500_000 // len(part)),
                 "<p>" + part * (400_000 // len(part)) + "</i></p>" * 60_000):
        began = time.process_time()
        hm.blocks_of(page)
        assert time.process_time() - began < 6


def test_a_large_hostile_page_as_a_whole():
    page = "<div>" * 3000 + "".join(f"<p>Some words of paragraph {i}.</p><ul><li><a href=x>link</a></ul>" for i in range(9000)) + "<b>" * 9000 + "</i>" * 9000
    began = time.process_time()
    text = hm.main_text(page)
    assert time.process_time() - began < 4 and "paragraph 8999" in text


def test_minimum_cut_against_all_labellings():
    r = random.Random(6)
    for n in [1, 2, 3, 5, 8, 12] * 4:
        costs = [round(r.uniform(-3, 3), 3) for _ in range(n)]
        edges = [(i, j, round(r.uniform(0, 2), 3)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4]

        def energy(label):
            return (sum(c for c, content in zip(costs, label) if c > 0 and not content)
                    + sum(-c for c, content in zip(costs, label) if c <= 0 and content)
                    + sum(c for i, j, c in edges if label[i] != label[j]))

        best = min(energy(x) for x in itertools.product([False, True], repeat=n))
        assert energy(hm.minimum_cut(costs, edges)) == pytest.approx(best, abs=1e-9)
