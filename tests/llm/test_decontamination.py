import hashlib
import re

import numpy as np
import pytest

from rillflow.llm.decontamination import contamination, without_documents, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, hit int, h string, n string, item string"


def words_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def windows_of(items, n):
    found: dict = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    return found


def hit_words(words, known):
    gone, items = set(), set()
    for k in {len(w) for w in known}:
        for i in range(len(words) - k + 1):
            if (w := tuple(words[i : i + k])) in known:
                gone.update(range(i, i + k))
                items |= known[w]
    return gone, sorted(items)


def plain(docs, items, n):
    known, out = windows_of(items, n), []
    for d, text in docs:
        w = words_of(text)
        gone, named = hit_words(w, known)
        out.append((d, len(w), len(gone), named))
    return sorted(out, key=repr)


def cases():
    rng = np.random.default_rng(8)
    vocabulary = ["the", "The", "Élan", "élan", "straße", "x1", "日本", "K", *[f"w{i}" for i in range(30)]]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(25)) for i in range(12)] + [(3, text(12)), (20, None), (21, " .,_\x7f"), (None, text(11)), (40, "rare1 rare2"), (41, "W7 w7")]
    items += [(50 + i, items[0][1].upper().replace("É", "é").replace("SSE", "sse")) for i in range(5)]
    docs = [(i, text(int(rng.integers(0, 40)))) for i in range(60)]
    for i in range(40):
        passage = items[i % 12][1].split(" ")
        a = int(rng.integers(0, 12))
        docs.append((100 + i, " ".join([*rng.choice(vocabulary, 8), *passage[a : a + int(rng.integers(5, 20))], "...", *rng.choice(vocabulary, 4)])))
    docs += [(300, items[5][1] + "!? " + items[5][1]), (301, "--" + items[6][1].replace(" ", "\n _") + "--"), (302, "Rare1, RARE2 rare1"), (303, None), (304, "")]
    docs += [docs[62]] * 3 + [(None, items[1][1]), (None, items[1][1]), (None, "clean"), (9, "another text of id nine w7 w7"), (305, "w1 " * 200_000 + items[2][1])]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "?", "?", "?") for d in docs], SCHEMA).repartition(5), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize(("n", "limit"), [(10, 500_000), (10, 5), (4, 500_000)])
def test_against_plain_windows(spark, n, limit):
    docs, items = cases()
    got = contamination(*frames(spark, docs, items), n, limit).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=repr) == plain(docs, items, n)


def test_items_of_one_window_length(spark):
    docs, items = cases()
    items = [i for i in items if len(words_of(i[1])) >= 10]
    got = contamination(*frames(spark, docs, items)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=repr) == plain(docs, items, 10)


def test_removal_of_spans_and_documents(spark):
    docs, items = cases()
    known = windows_of(items, 10)
    frame, benchmark = frames(spark, docs, items)
    kept = without_documents(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == sorted([d for d in docs if not hit_words(words_of(d[1]), known)[0]], key=repr)
    cut = without_spans(frame, benchmark)
    assert cut.columns == frame.columns
    want = []
    for d, text in docs:
        gone, _ = hit_words(words_of(text), known)
        spans = [m.span() for m in WORD.finditer(text or "")]
        ends = [s for s, _ in spans[1:]] + [len(text or "")]
        left = "".join(text[s:e] for i, ((s, _), e) in enumerate(zip(spans, ends, strict=False)) if i not in gone) if spans else ""
        want.append((d, text if not gone else text[: spans[0][0]] + left))
    got = [(r["doc_id"], r["text"]) for r in cut.collect()]
    digest = lambda rows: sorted((repr(d), hashlib.sha256(repr(t).encode()).hexdigest()) for d, t in rows)
    assert digest(got) == digest(want)


def test_empty_tables(spark):
    docs, items = frames(spark, *cases())
    assert contamination(docs.where("false"), items).count() == 0
    clean = contamination(docs, items.where("false"))
    assert clean.count() == docs.count() and clean.where("n_hit > 0 or size(items) > 0").count() == 0


def test_texts_are_not_shuffled_and_no_python_runs(spark):
    from rillflow.llm.decontamination import op11_decontamination

    plan = op11_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    exchanges = [part for part in plan.split("\n\n") if ") Exchange" in part]
    assert exchanges and not any("words" in part.replace("n_words", "") or "text" in part for part in exchanges)
