import random
import re
import time
from html import unescape
from math import e, log

import pyarrow.parquet as pq
import pytest

from rillflow.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"


def template_text(page):
    """The article of a generated page, by its template."""
    article = re.sub(r"</?[bi]>", "", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]).replace("<br>", " ")
    blocks = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_every_page_of_the_template(tag):
    pages = pq.read_table(PAGES).to_pylist()
    for p in pages:
        assert html.main_text(p["html"].replace("article>", f"{tag}>")) == template_text(p["html"])


def test_density_alone_finds_all_but_the_shortest_articles(monkeypatch):
    monkeypatch.setattr(html, "CUT_NAMES", frozenset())
    for p in pq.read_table(PAGES).to_pylist():
        for tag in ("article", "div"):
            want = template_text(p["html"])
            assert html.main_text(p["html"].replace("article>", f"{tag}>")) == want or len(want) < 300


def plain_measures(node):
    """(characters, tags, characters in links, links) of a subtree, by one walk for each node."""
    c = t = lc = lt = 0
    for x in node.items:
        if isinstance(x, str):
            c += len(x.strip())
        elif not x.cut:
            a, b, la, lb = plain_measures(x)
            c, t = c + a, t + b + 1
            lc, lt = (lc + a, lt + lb + 1) if x.tag == "a" else (lc + la, lt + lb)
    return c, t, lc, lt


def test_densities_against_their_definition():
    rng = random.Random(5)
    for _ in range(40):
        page = "<body>"
        for _ in range(rng.randint(1, 60)):
            page += rng.choice(["<div>", "</div>", "<p>", "<a href=x>link text</a>", "some words here ", "<ul><li>", "</ul>", "<span>x y</span>", "<nav>no</nav>"])
        root = html.tree(page)
        order = html.measured(root)
        body = plain_measures(root)
        for n in order:
            c, t, lc, lt = plain_measures(n)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt)
            t, lt = max(1, t), max(1, lt)
            want = max(0.0, c / t * log(max(1.0, c * t / (max(1, lc) * lt)) + 1e-9) / log(c * lc / max(1, c - lc) + body[2] / max(1, body[0]) * c + e)) if c > 1 else 0.0
            assert n.density == pytest.approx(want)
            assert n.total == pytest.approx(sum(x.density for x in n.items if isinstance(x, html.Node) and not x.cut))
        if any(n.total for n in order):
            best = max(n.total for n in order)
            held = set()
            for n in html.chosen(root):
                held.update(id(x) for x in walk(n))
            assert any(id(n) in held for n in order if n.total >= best * (1 - 1e-9))


def walk(node):
    yield node
    for x in node.items:
        if isinstance(x, html.Node):
            yield from walk(x)


def test_names_that_only_resemble_those_of_adverts():
    text = " ".join(f"word{i}" for i in range(60))
    assert html.main_text(f'<body><p class="more">Real paragraph {text}</p></body>') == f"Real paragraph {text}"
    assert html.main_text(f'<body><article><p>{text}</p><div class="share-price">Price: 3 {text}</div></article></body>') == f"{text}\nPrice: 3 {text}"
    assert html.main_text(f'<body><article><p>{text}</p></article><div class="ad-slot">{text}</div><div id="comment_list"><p>{text}</p></div><div class="comments"><p>{text}</p></div></body>').count("word59") in (1, 2)


HOSTILE = {
    "nested blocks": "<div>" * 100_000 + "x",
    "open links": "<a " * 100_000,
    "odd quotes": "<a '\">x" * 60_001,
    "nested behind a wall": "<p><table><td>" + "<div>" * 100_000,
    "stray inline ends": "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000,
    "stray block ends": "<div>" * 50_000 + "</section>" * 50_000,
    "inline texts": "<span>a" * 100_000,
    "open list items": "<li>x" * 100_000,
    "open comments": "<!--" * 100_000,
    "lone signs": "<" * 300_000 + ">",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_in_proportion(name):
    page = HOSTILE[name]
    began = time.process_time()
    html.main_text(page)
    # a walk over all ancestors for each tag would take minutes
    assert time.process_time() - began < 10


def test_raw_parts_end_where_they_end_in_the_page():
    # lower case of this letter is two characters
    page = "<body>" + "İ" * 50 + "<SCRIPT>var a = 1;</Script><p>after</p>"
    assert html.main_text(page) == "İ" * 50 + "\nafter"


LONG, SIDE = (" ".join(f"{w}{i}" for i in range(120)) for w in ("word", "side"))
WHOLE = {
    "a form around the page": (f"<html><head><title>x</title></head><body><form action=x><input type=hidden value=1><ul><li><a href=a>Home</a></li></ul><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><button>Go</button></form></body></html>", f"Head\n{LONG}\n{LONG}"),
    "an open head and no body": (f"<!DOCTYPE html><head><title>x</title><meta charset=utf-8><p>{LONG}<p>{LONG}", f"{LONG}\n{LONG}"),
    "an open head and text": (f"<head><title>x</title>{LONG}", LONG),
    "a wrapper named like a sidebar": (f'<body><div class="sidebar-layout"><div><p>{LONG}</p></div><div class="sidebar"><p>{SIDE}</p></div></div></body>', LONG),
    "a wrapper with a sidebar's name": (f'<body><div class="sidebar"><div><h1>A</h1><p>{LONG}</p></div></div></body>', f"A\n{LONG}"),
    "a form in a notice": (f'<body><div class="notice"><form><p>{LONG}</p></form></div><div class="ad"><p>short {SIDE[:30]}</p></div></body>', LONG),
    "hyphenated names": (f'<body><article><p>{LONG}</p><div class="ad-hoc-analysis"><p>One {LONG}</p></div><p class="notice-period">Two {LONG}</p><section id="comment-on-law"><p>Three {LONG}</p></section></article></body>', f"{LONG}\nOne {LONG}\nTwo {LONG}\nThree {LONG}"),
    "a list of replies": (f'<body><article><p>{LONG}</p></article><ol class="replies"><li><p>Reply {SIDE}</p></li></ol></body>', LONG),
    "articles as comments": (f"<body><article><h1>A</h1><p>{LONG}</p><section><article><p>Reply {SIDE[:300]}</p></article><article><p>{SIDE[:300]}</p></article></section></article></body>", f"A\n{LONG}"),
    "articles in a frame": (f"<body><article><h1>A</h1><article><p>{LONG}</p></article><article><p>{SIDE}</p></article></article></body>", f"A\n{LONG}\n{SIDE}"),
    "a form to sign up": (f"<body><article><p>{LONG}</p><form class=x><p>Subscribe {SIDE}</p><input></form></article></body>", LONG),
    "quotes after many odd ones": ("<body>" + "<i '\">" * 70 + f'<p title="1 > 2">{LONG}</p></body>', LONG),
}


@pytest.mark.parametrize("name", WHOLE)
def test_no_page_is_lost_or_padded(name):
    page, want = WHOLE[name]
    assert html.main_text(page) == want


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_pages_of_two_articles_lose_little(tag):
    pages = [p["html"] for p in pq.read_table(PAGES).to_pylist()]
    article = lambda page: re.search(r"<article>.*?</article>", page, re.DOTALL)[0]
    lost = total = 0
    for a, b in zip(pages[::2], pages[1::2], strict=False):
        page = a.replace(article(a), article(a) + article(b)).replace("article>", f"{tag}>")
        want = set(f"{template_text(a)}\n{template_text(b)}".split("\n"))
        lost += sum(map(len, want - set(html.main_text(page).split("\n"))))
        total += sum(map(len, want))
    assert lost <= 0.02 * total
