import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from rillflow.llm import chat, html, tokencounts, toxicity
from rillflow.llm.bpe import ByteBPE
from tests.llm.brute import sections, subsequence_value

SF = "/root/testdata/sf0.001"


def test_chat_digests(spark):
    said = r"\### Assistant: </turn> ok"
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: r for r in chat.op3_chat_formatting(spark, SF).collect()}
    assert set(got) == set(turns)
    for c, rows in turns.items():
        loss = "".join(t for role, t in rows if role == "assistant")
        assert got[c]["n_turns"] == len(rows)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_parts_are_flattened_in_order():
    parts = [{"type": "text", "text": "a # <b"}, {"type": "image", "ref": "i", "width": 57, "height": 28}, {"type": "audio", "ref": "s", "seconds": 0.5}, {"type": "document", "ref": "d", "pages": 3}, {"type": "Video!", "ref": "v"}]
    turn, start, end, seen = chat.formatted_turn("assistant", parts)
    assert turn == "### assistant: a \\# \\<b<image:1><audio:2><document:3><video_:4> </turn>\n"
    assert [(a["number"], a["ref"], a["tokens"]) for a in seen] == [(1, "i", 3), (2, "s", 13), (3, "d", 1800), (4, "v", 0)]
    assert all(turn[a["at"]] == "<" for a in seen) and turn[start:end].startswith("a ") and turn[end:] == " </turn>\n"


def test_turns_are_reversible():
    for role, text in [("a: b", "x"), ("U#\\<:", "### user: hi </turn>\n\\<image:1>"), ("", ""), ("user", "\\"), ("user", " </turn>\n### user: ")]:
        assert chat.read_turns(chat.formatted_turn(role, [{"type": "text", "text": text}])[0] * 2) == [(role, text)] * 2


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, None, "user", "a"), (None, 0, "assistant", "x"), (1, 0, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(chat.F.col("text")))
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got == {1: 4, None: 1}
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


@pytest.mark.parametrize("seconds", [None, float("nan"), float("inf"), float("-inf"), -3.0, 0.0, 1e300])
def test_chat_audio_lengths(seconds):
    seen = chat.Flattener()
    seen.visit({"type": "audio", "seconds": seconds})
    assert seen.attachments[0]["tokens"] == (chat.MOST_TOKENS if seconds == 1e300 else 1)


def test_chat_escapes_of_all_short_texts():
    from itertools import product

    for n in range(6):
        for signs in product("\\#<: a", repeat=n):
            text = "".join(signs)
            turn, *_ = chat.formatted_turn(text, [{"type": "text", "text": text}])
            assert chat.read_turns(turn * 2) == [(text, text)] * 2


def test_chat_attachments_and_clashing_names_through_spark(spark):
    parts = [("text", "see <this> #1", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, float("nan"), None), ("document", None, "c.pdf", None, None, None, 3), ("Map 2", None, "d", None, None, None, None)]
    schema = f"conv_id long, turn long, role string, text string, content array<{chat.PART}>, attachments__ string"
    turns = spark.createDataFrame([(1, 0, "user", None, parts, "mine"), (1, 1, "assistant", None, None, None)], schema)
    done = chat.format_turns(turns)
    assert done.columns[:6] == turns.columns and done.columns.count("attachments__") == 2
    row = sorted(done.collect(), key=lambda r: r["turn"])[0]
    assert row["attachments__"] == "mine" and row[6] == "### user: see \\<this> \\#1<image:1><audio:2><document:3><map_2:4> </turn>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in row[9]] == [("image", "a.png", 3), ("audio", "b.wav", 1), ("document", "c.pdf", 1800), ("Map 2", "d", 0)]
    assert row["expanded_tokens__"] == 1804 and all(row[6][a["at"] :].startswith("<") for a in row[9])


def test_chat_of_one_very_long_turn(spark):
    text = "\\ab # <x> c" * 400_000
    turns = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(chat.F.col("text")))
    row = chat.read_back(chat.format_turns(turns)).first()
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


PAGE = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<div class="cookie-notice">We use cookies</div><div id="wrap"><div class="sidebar"><p>side</p></div><div class="content"><h1>T&eacute;st &amp;amp;</h1>
<p>Long   text with <a href="u">a link</a> in it.<p>Second <b>bold</b>text.<ul><li>one<li>two</ul><form><input>Search</form><div hidden>no</div></div>
<div id="comments"><p>I disagree</p></div></div><footer>f</footer></body></html>"""


def test_main_text_without_marked_article():
    assert html.main_text(PAGE) == "Tést &amp;\nLong text with a link in it.\nSecond boldtext.\none\ntwo"


def test_main_text_of_an_article():
    page = '<body><nav>n</nav><article><h1>H</h1><p><b>A b.<br><p>C <i>d</i></p><aside>ad</aside><section class="comments"><p>reply</p></section></article><div class="ad">Buy buy buy</div></body>'
    assert html.main_text(page) == "H\nA b.\nC d"


def test_main_text_in_several_parts():
    long = [" ".join(f"{w}{i}" for i in range(40)) for w in ("river", "stone", "winter", "garden")]
    part = lambda tag, a, b: f"<{tag}><h1>On {a[:5]}</h1><p>{a}</p><p>{b}</p></{tag}>"
    want = "\n".join(["On river", long[0], long[1], "On winte", long[2], long[3]])
    teaser = "<article><p>Next one</p></article>"
    for tag in ("article", "div", "section"):
        page = f"<body><nav>n</nav>{part(tag, long[0], long[1])}<div><p>Buy now</p></div>{part(tag, long[2], long[3])}{teaser}</body>"
        assert html.main_text(page) == want
    # a short article doesn't hide the text outside it
    assert html.main_text(f"<body>{teaser}{part('div', long[0], long[1])}</body>") == "\n".join(["On river", long[0], long[1]])


def test_html_odd_pages(spark):
    assert [html.main_text(x) for x in (None, "", "<", "<p", "<script>x", "<!-- a", "plain &lt; text", "<div class='ad'>x</div>")] == ["", "", "<", "<p", "", "", "plain < text", ""]
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html.main_text(deep) == "deep"
    assert html.main_text("<p>" + "word " * 200_000).count("word") == 200_000
    got = html.extract(spark.createDataFrame([(1, None, "a"), (1, PAGE, "b")], "page_id long, html string, text string"))
    assert got.columns == ["page_id", "text", "text__"] and [r["text__"] == "" for r in got.collect()] == [True, False]
    assert html.extract(got.select("page_id", got["text"].alias("html")).limit(0)).count() == 0


def test_pages_against_their_template(spark):
    import re
    from html import unescape

    for r in html.op4_html_extraction(spark, SF).collect():
        page = spark.read.parquet(f"{SF}/pages.parquet").where(f"page_id = {r['page_id']}").first()["html"] if r["page_id"] < 5 else None
        if page:
            article = re.sub(r"</?[bi]>", "", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]).replace("<br>", " ")
            blocks = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", article)]
            assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_token_counts_against_plain_version(spark):
    coder = ByteBPE(P.path(tokencounts.RANKS), P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in tokencounts.op8_token_counts(spark, SF).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["n_chars"], r["n_tokens"], r["n_crossing"]))
    for d, t in texts.items():
        ids = coder.encode([t])[0]
        first, end = coder.char_offsets(t, ids)
        spans = [m.span() for m in re.finditer(r"[^\n]*\n|[^\n]+", t)] or [(0, 0)]
        assert got[d] == sections(t, spans, list(zip(first.tolist(), end.tolist(), strict=True)))


def test_crossing_tokens_go_to_the_larger_part(spark):
    rows = [(1, "hello world 漢字🙂", [7, 3]), (2, None, [4]), (2, "", None), (None, "a\n\nb", [1, 0, 2, 9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<int>")
    coder = ByteBPE(P.path(tokencounts.RANKS), P.PATTERN)
    got = {}
    for r in tokencounts.attribute(docs, lengths="parts").collect():
        got.setdefault(r["doc_id"], []).append((r["n_chars"], r["n_tokens"], r["n_crossing"]))
    text = rows[0][1]
    ids = coder.encode([text])[0]
    first, end = coder.char_offsets(text, ids)
    assert got[1] == sections(text, [(0, 7), (7, 10), (10, len(text))], list(zip(first.tolist(), end.tolist(), strict=True)))
    assert sum(n for _, n, _ in got[1]) == len(ids)
    assert got[2] == [(0, 0, 0), (0, 0, 0)] and sum(c for c, *_ in got[None]) == 4
    assert tokencounts.attribute(docs.drop("parts").limit(0)).count() == 0


def toxic_table(spark, n=400):
    words = "river stone winter garden paper window morning letter silver market".split()
    insults = ["blockhead", "nincompoop"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(words[(i * 7 + k * (i % 5 + 1)) % 10] for k in range(30))
        bad = i % 4 == 0
        if bad:
            text = text[:60] + f" {insults[i % 8 // 4]} " + text[60:]
        docs.append((i, text, "x"))
        labels.append((i, int(bad), "y"))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, lang string")


def test_toxicity_tolerates_gaps_and_insertions(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    bad = ["you blockhead", "you b.l.o.c.k.h.e.a.d", "you b l o c k h e a d now", "you blockxhead", "a ninco-mpoop here"]
    fine = ["a silver window", "the market in the morning", "", "r i v e r"]
    assert (model.scores(bad) >= 0.5).all() and (model.scores(fine) < 0.5).all()
    kept = toxicity.clean_only(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0").count() == 0 and kept.count() == 300


def test_toxicity_odd_rows(spark):
    docs, labels = toxic_table(spark, 40)
    more = docs.unionByName(spark.createDataFrame([(None, "a blockhead", "x"), (900, None, "x"), (901, "q" * 100_000, "x")], docs.schema))
    none = toxicity.score(more, toxicity.fit(more, labels.where("toxic = 0")))
    assert none.count() == 43 and none.where("score__ >= 0.5").count() == 0
    scored = toxicity.score(more, toxicity.fit(more, labels.unionByName(labels)))
    assert scored.where("score__ is null or score__ < 0 or score__ > 1").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_span_values_against_all_subsequences():
    rng = random.Random(6)
    weights = np.random.default_rng(1).standard_normal(64**3).astype(np.float32)
    for _ in range(60):
        text = "".join(rng.choice("abcde fé9.-\n") for _ in range(rng.randint(0, 40)))
        value, first, last, _ = toxicity.span_values([text], weights)
        got = [(text[s - 2 : e - 2], float(v)) for v, s, e in zip(value, first, last, strict=True)]
        want = subsequence_value(text, lambda a, b, c: float(weights[a << 12 | b << 6 | c]), toxicity.DECAY, toxicity.REACH, toxicity._classes())
        assert [v for _, v in got] == pytest.approx(want, abs=1e-4)


def test_worst_spans_look_at_all_spans():
    weights = np.zeros(64**3, np.float32)
    text = "bad " * 500 + "worse " + "bad " * 500
    codes = [ord(c) - 96 for c in "bad"]
    weights[codes[0] << 12 | codes[1] << 6 | codes[2]] = 1
    codes = [ord(c) - 96 for c in "ors"]
    weights[codes[0] << 12 | codes[1] << 6 | codes[2]] = 0.1
    assert [s for s, _ in toxicity.worst_spans([text, "", "x"], weights, 2)[0]] == ["bad", "worse"]


def test_sentences_stand_by_their_worst_spans():
    weights = np.zeros(64**3, np.float32)
    for word, weight in (("bad", 1), ("ors", 0.5), ("mid", 0.2)):
        a, b, c = (ord(x) - 96 for x in word)
        weights[a << 12 | b << 6 | c] = weight
    texts = ["bad worse. mid one! worse", "", "worse\nmid", "a.b worse v1.5 mid", "bad mid. mid bad mid"]
    got = [[s for s, _ in x] for x in toxicity.worst_spans(texts, weights, 4, by_sentence=True)]
    assert got[0] == ["bad", "worse", "mid"] and got[1] == [] and got[2] == ["worse", "mid"] and got[3] == ["worse"] and got[4] == ["bad"]
    assert [s for s, _ in toxicity.worst_spans(texts, weights, 1, by_sentence=True)[0]] == ["bad"]
    together = toxicity.worst_spans(["worse", "bad"], weights, 4, by_sentence=True)
    assert [[s for s, _ in x] for x in together] == [["worse"], ["bad"]]


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.9 and n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.85


def test_token_counts_of_a_long_text_beside_clashing_columns(spark):
    text = "\n".join(f"line {i} " + "ñandú déjà-vu 日本語 x" * (i % 40) for i in range(4000))
    docs = spark.createDataFrame([(1, text, "?", 3, "?"), (2, "a\nb", "?", 3, "?")], "doc_id long, text string, section string, n_tokens int, n_chars string")
    got = tokencounts.attribute(docs).where("doc_id = 1").orderBy("section").collect()
    assert len(text) > 1_000_000 and [r["n_chars"] for r in got] == [len(x) + 1 for x in text.split("\n")][:-1] + [len(text.split("\n")[-1])]
    coder = ByteBPE(P.path(tokencounts.RANKS), P.PATTERN)
    assert sum(r["n_tokens"] for r in got) == len(coder.encode([text])[0]) and tokencounts.attribute(docs).columns == ["doc_id", "section", "n_chars", "n_tokens", "n_crossing"]
