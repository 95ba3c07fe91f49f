"""Main text of pages: tag-path ratios against a plain recomputation, layouts, and time in nested markup."""

import random
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from undula.llm import html_text

WORDS = ["stone", "river", "walks", "slow", "green", "north", "under", "light", "a", "of"]


def page(rng):
    """A well-formed page of nested blocks, some with marked classes."""
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    text = lambda: say(rng.randint(1, 60)) + rng.choice(["", ".", ", and; so on.", "!"])

    def element(depth):
        tag = rng.choice(["div", "section", "p", "ul", "article", "h2"])
        cls = rng.choice(["", "", "", ' class="comments"', ' class="ad-slot"', ' class="post has-comments"'])
        if tag in ("p", "h2") or depth > 3:
            return f"<{tag}{cls}>{text()}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{text()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        return f"<{tag}{cls}>" + "".join(element(depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    return "<html><body><nav>Menu</nav>" + "".join(element(0) for _ in range(rng.randint(1, 5))) + "<footer>Foot.</footer></body></html>"


class Plain(HTMLParser):
    """Every block with its whole tag path, as (text, ((tag, marked), ...))."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.out = [], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        cls = dict(attrs).get("class") or ""
        self.stack.append((tag, cls in ("comments", "ad-slot")))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip() and not {"nav", "footer"} & {t for t, _ in self.stack}:
            self.out.append((data.strip(), tuple(self.stack)))


def plain_scores(found):
    ratio = {}
    for path in {p for _, p in found}:
        own = [t for t, p in found if p == path]
        size, signs = sum(map(len, own)) / len(own), sum(1 + sum(t.count(c) for c in ".,;!") for t in own) / len(own)
        ratio[path] = size / (size + html_text.HALF_SIZE), signs / (signs + html_text.HALF_MARKS)
    smooth = lambda k, j: sum(w * ratio[found[min(max(k + d, 0), len(found) - 1)][1]][j] for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)))
    fused = [(smooth(k, 0) * smooth(k, 1)) ** 0.5 for k in range(len(found))]
    out = []
    for _, path in found:
        same = [(len(t), f) for (t, p), f in zip(found, fused, strict=True) if p == path]
        out.append(sum(n * f for n, f in same) / sum(n for n, _ in same) * html_text.LOWERED ** sum(m for _, m in path))
    return out


@pytest.mark.parametrize("seed", range(120))
def test_scores_against_plain_paths(seed):
    html = page(random.Random(seed))
    read, plain = html_text.Page(html), Plain(html).out
    assert [t for t, _ in read.blocks] == [t for t, _ in plain]
    if plain:
        want = plain_scores(plain)
        assert np.allclose(html_text.path_scores(read), want)
        kept = html_text.chosen(read)
        assert all(k for k, w in zip(kept, want, strict=True) if w > html_text.SHARE * max(want) + 1e-9)


def test_scores_decide(sf, monkeypatch):
    pages = [h for (h,) in duckdb.sql(f"select html from '{sf}/pages.parquet'").fetchall()]
    text = [html_text.main_text(h) for h in pages]
    monkeypatch.setattr(html_text, "path_scores", lambda p: np.ones(len(p.blocks)))
    assert sum(html_text.main_text(h) != t for h, t in zip(pages, text, strict=True)) > 0.9 * len(pages)


@pytest.mark.parametrize("name", ["page no-sidebar", "post has-comments", "search-result", "newsletter", "with-sidebar"])
@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_layout_names_keep_their_text(name, tag):
    got = html_text.main_text(f'<body><nav>Home</nav><{tag} class="{name}"><h1>Head</h1><p>The only text of it, as a paragraph.</p></{tag}><footer>Foot</footer></body>')
    assert got == "Head The only text of it, as a paragraph."


def test_comments_longer_than_the_article_go():
    long = "Nice text, I like it, really; thank you. " * 40
    got = html_text.main_text(f"<article><h1>Head</h1><p>A short article, with one sentence, or so.</p><section class='comments'><p>{long}</p><p>{long}</p></section></article>")
    assert got == "Head A short article, with one sentence, or so."


def test_short_blocks_within_the_content_stay():
    long = "<p>" + "Some long text, that goes on and on, for a while. " * 5 + "</p>"
    got = html_text.main_text(f"<body><div>Follow us</div><div id=c><h2>Head</h2>{long}<ul><li>one</li><li>two</li></ul>{long}<p>End</p></div><div>All rights reserved</div></body>")
    assert got.startswith("Head Some") and " one two Some" in got and got.endswith("End")


def test_nested_markup_takes_linear_time():
    times = []
    for n in (4000, 16000):
        began = time.perf_counter()
        assert html_text.main_text("<div>x" * n).count("x") == n
        html_text.main_text("<ul><li>x" * n + "</b></i>" * n)
        times.append(time.perf_counter() - began)
    assert times[0] < 1 and times[1] < 12 * times[0]


LONG = "The river runs slowly under the stone bridge, and nobody knows why. It was built long ago; some say by monks. " * 8


@pytest.mark.parametrize("name", ['class="social-studies"', 'class="ad-free"', 'class="search-page"', 'id="related-work"'])
def test_a_name_that_may_mean_an_aside_keeps_the_only_long_text(name):
    page = f"<html><body><div><p>A short block, elsewhere.</p></div><div {name}><h1>Bridges</h1><p>{LONG}</p><p>{LONG}</p></div></body></html>"
    got = html_text.main_text(page)
    assert LONG.strip() in got and "Bridges" in got


@pytest.mark.parametrize("name", ["comments", "comment-list", "commentBody", "ad-box", "sidebar-left", "related-posts"])
def test_a_sure_name_stays_an_aside_however_much_it_holds(name):
    page = f'<html><body><article><p>{LONG}</p></article><div class="{name}"><p>Mine: {LONG}{LONG}</p></div></body></html>'
    assert html_text.main_text(page) == LONG.strip()


def test_a_name_that_may_mean_an_aside_is_one_beside_a_longer_text():
    page = f'<html><body><article><p>{LONG}{LONG}</p></article><div class="related-work"><p>Beside: {LONG}</p></div></body></html>'
    assert html_text.main_text(page) == (LONG + LONG).strip()


def test_forms():
    inside = f'<nav>Home</nav><div class="sidebar"><p>Side.</p></div><h1>Bridges</h1><p>{LONG}</p><p>More of it.</p><button>Go</button>'
    assert html_text.main_text(f"<html><body><form action=x>{inside}</form></body></html>") == f"Bridges {LONG.strip()} More of it."
    fill = "<form>Your name <input> Your address and everything else that we would like to know about you</form>"
    assert html_text.main_text(f"<html><body><article><p>{LONG}</p></article>{fill}</body></html>") == LONG.strip()
    assert html_text.main_text(f"<html><body>{fill}</body></html>") == ""
    assert html_text.main_text(f"<html><body><article><p>{LONG}</p></article><form><p>{LONG}</p></form></body></html>") == LONG.strip()


def test_a_page_of_many_megabytes_with_few_tags():
    page = f"<html><body><div class='ad'>x</div><p>{LONG * 6000}</p></body></html>"
    begun = time.time()
    assert len(html_text.main_text(page)) > 5_000_000 and time.time() - begun < 20
