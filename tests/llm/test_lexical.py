import math
import re
from collections import Counter

import numpy as np

from rillflow.llm import lexical
from rillflow.llm.lexical import search, term_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n string, terms int, score string, item string"


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def plain(docs, items, k=10):
    counts = [(d, Counter(terms_of(t))) for d, t in docs if terms_of(t)]
    total, df = sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + (90 * c.total() * len(counts)) // total
            score = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, e[3], -e[0]) for i, e in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def cases():
    rng = np.random.default_rng(5)
    vocabulary = ["the", "a", "Élan", "élan", "straße", "x1", "KelvinK", "日本", *[f"w{i}" for i in range(40)]]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " -- ".join(rng.choice(vocabulary, n, p=weight / weight.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(150)]
    docs += [(200 + i, "the Same text, w3 W3") for i in range(40)] + [(5, docs[5][1])] * 3
    docs += [(None, "THE same w3"), (None, None), (300, None), (301, ""), (302, " \x7f.,_ "), (303, "w5 " * 400_000 + "lonely")]
    items = [(i, text(12)) for i in range(20)] + [(7, "w3 same"), (None, "lonely W5 w5"), (31, None), (32, "..."), (33, "nowhere")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "?", 1, "?", "?") for d in docs], SCHEMA).repartition(5), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")


def test_against_plain_scores(spark):
    docs, items = cases()
    want = plain(docs, items)
    assert rows(search(*frames(spark, docs, items))) == want
    assert {r[0] for r in want} >= {None, 7, 19} and not {31, 32, 33} & {r[0] for r in want}


def test_blocks_of_items_and_small_batches(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(lexical, "CELLS", 30)
    monkeypatch.setattr(lexical, "EXACT", 1)
    assert rows(search(*frames(spark, docs, items), k=3, index_postings=40)) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = frames(spark, *cases())
    assert search(docs.where("false"), items).count() == 0 and search(docs, items.where("false")).count() == 0
    assert search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    for text in ("abcdefghijk lmn, op  q", "x" * 50, "ab " * 20 + "Ab", "", "   "):
        assert term_counts(text) == Counter(t.encode() for t in terms_of(text))
