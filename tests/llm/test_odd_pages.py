"""Pages with odd quotes and deep nesting lose no text and take time in proportion."""

import random
import time
from html.parser import HTMLParser

import pytest

from echograin.llm import html_blocks


class Plain(HTMLParser):
    """Words of all text of a page."""

    def __init__(self):
        super().__init__()
        self.words = []

    def handle_data(self, data):
        self.words += data.split()


def words(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    return parser.words


ATTRIBUTES = ["class=x\"", "title=it's", "data-a='b\"c'", 'title="a > b"', "title='c > d'", "x = 'y'", "checked", "a=b=c", "q=\"\"", "w=''", "href=/u?a=1&b='2", "  ", "o'clock", '"', "k=v/"]


@pytest.mark.parametrize("seed", range(30))
def test_odd_quotes_lose_no_text(seed):
    rng = random.Random(seed)
    html, n = "<article>", 0
    for _ in range(40):
        tag = rng.choice(["p", "div", "b", "span", "li"])
        html += f"<{tag} {' '.join(rng.choice(ATTRIBUTES) for _ in range(rng.randrange(4)))}>word{n} "
        n += 1
        if rng.random() < 0.6:
            html += f"</{tag}>"
    html += "</article>"
    found = [w for b in html_blocks.read_blocks(html) for w in b.text.split()]
    assert found == words(html) == [f"word{k}" for k in range(n)]


@pytest.mark.parametrize("attribute", ["title=it's", 'class=x"', "o'clock", "a='", 'b="'])
def test_one_odd_quote(attribute):
    text = html_blocks.main_text(f"<article><p>A first paragraph.</p><p {attribute}>mid</p><p>And the last one.</p></article>")
    assert text == "A first paragraph.\nmid\nAnd the last one."


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "</b>" * 100_000, "<blockquote>x" * 60_000, "<p a=" * 60_000, "<a =" * 50_000 + ">", "<p " + "= " * 80_000, "<div>a" * 50_000 + "</div>" * 50_000, "<i>" * 100_000 + "x", "<li>x" * 60_000])
def test_time_is_in_proportion(html):
    began = time.process_time()
    html_blocks.main_text(html)
    assert time.process_time() - began < 4
