import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from rillflow.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_against_tiktoken(spark, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op10_byte_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_random_texts_and_offsets(reference):
    coder = bpe.coder(P.path(bpe.RANKS), P.PATTERN)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("aabcdé \n\t'sStTdlreñ12.,!?-_öü漢字🙂　 ᢅ\U00016ea7") for _ in range(rng.randint(0, 60)))
        ids = coder.encode([text])[0]
        assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()
        assert list(coder.char_offsets(text, ids)[0]) == reference.decode_with_offsets(ids)[1]


def test_a_full_table_of_known_pieces_is_renewed(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    coder = bpe.ByteBPE(P.path(bpe.RANKS), P.PATTERN)
    for text in ("one two three four five", "six seven", "one six", "x" * 500, "one six two three", "x" * 500):
        assert coder.encode([text])[0] == reference.encode_ordinary(text)
        assert len(coder.known) <= 3 + 5 and all(len(p) <= bpe.LONG_PIECE for p in coder.older)


def test_every_code_point_is_of_the_class_that_the_reference_has_it_in(reference):
    coder = bpe.coder(P.path(bpe.RANKS), P.PATTERN)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"a{chr(c)}'s  {chr(c)}b" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    for i in range(0, len(texts), 20):
        assert coder.encode(texts[i : i + 20]) == [reference.encode_ordinary(t) for t in texts[i : i + 20]]


def test_outputs_of_one_pass_and_clashing_names(spark):
    rows = [(1, "née 🙂 x", "kept"), (1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded__ string")
    names = ["ids__", "n_tokens__", "decoded_sha256__", "ids_sha256__"]
    got = bpe.transcode(docs, [*names, "starts__"]).collect()
    for row, (_, text, kept) in zip(got, rows, strict=True):
        assert row["decoded__"] == kept and row["n_tokens__"] == len(row["ids__"]) == len(row["starts__"])
        assert row["decoded_sha256__"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert row["ids_sha256__"] == hashlib.sha256(",".join(map(str, row["ids__"])).encode()).hexdigest()
    again = bpe.transcode(docs, ["decoded__"])
    assert again.columns == ["doc_id", "text", "decoded__", "decoded__"] and bytes(again.collect()[0][3]).decode() == "née 🙂 x"


def test_odd_rows(spark):
    rows = [(1, None, [1]), (1, "", None), (None, "x y", [2]), (2, "z" * 100_000, None)]
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>"), offsets=True)
    assert coded.columns == ["doc_id", "text", "ids", "ids__", "starts__", "ends__"]
    got = bpe.decode(coded).collect()
    assert [bytes(r["decoded__"]).decode() for r in got] == ["", "", "x y", "z" * 100_000]
    assert [len(r["starts__"]) == len(r["ids__"]) for r in got] == [True] * 4
    assert bpe.encode(coded.select("doc_id", "text").limit(0)).count() == 0
