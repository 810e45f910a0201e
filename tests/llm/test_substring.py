import random

from rillflow.llm import substring
from tests.llm.brute import substring as plain

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(substring.op7_substring_dedup(spark, SF)) == plain(rows)


def test_random_overlaps(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    passages = [rng.sample(words, rng.randint(12, 30)) for _ in range(6)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages)[: rng.randint(10, 30)] if rng.random() < 0.6 else rng.sample(words, rng.randint(1, 20))
        if rng.random() < 0.2:
            text += ["again"] * rng.randint(5, 40)
        rows.append((d, rng.choice([" ", "  ", "\n"]).join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    import hashlib

    got = {r["doc_id"]: (r["n_words__"], r["n_removed__"], hashlib.sha256(r["kept_text__"].encode()).hexdigest()) for r in substring.remove_repeats(docs).collect()}
    assert got == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"q{i}" for i in range(20))
    rows = [(1, long, "a"), (2, long, "b"), (2, long, "b"), (3, "x " + long, "c"), (None, long, "d"), (5, None, "e"), (6, "", "f"), (7, "v " * 60_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    got = sorted(((r["doc_id"], r["n_words__"], r["n_removed__"], r["hits"]) for r in substring.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(1, 20, 0, "a"), (2, 20, 20, "b"), (2, 20, 20, "b"), (3, 21, 20, "c"), (None, 20, 0, "d"), (5, 0, 0, "e"), (6, 0, 0, "f"), (7, 60000, 0, "g")], key=str)
    assert [r["doc_id"] for r in substring.without_repeats(docs).orderBy("doc_id").collect()] == [None, 1, 3, 5, 6, 7]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_words_that_fool_a_polynomial_hash(spark):
    # the Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 for every odd base
    morse = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    tail = " ".join(f"w{i}" for i in range(12))
    words = [("p", "q")[i.bit_count() % 2] for i in range(2048)]
    rows = [(1, f"{morse} {tail}"), (2, f"{morse.translate({97: 98, 98: 97})} {tail}"), (3, f"{morse} {tail} z"), (4, " ".join(words)), (5, " ".join("q" if w == "p" else "p" for w in words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d: x[1] for d, x in as_rows(digest(docs)).items()} == {d: x[1] for d, x in plain(rows).items()}
    assert as_rows(digest(docs))[2][1] == 0


def digest(docs):
    from pyspark.sql import functions as F

    return substring.remove_repeats(docs).select("doc_id", F.col("n_words__").alias("n_words"), F.col("n_removed__").alias("n_removed"), F.sha2("kept_text__", 256).alias("kept_sha256"))


def test_maximal_repeats(spark):
    run = [f"r{i}" for i in range(30)]
    rows = [(1, " ".join(run)), (2, " ".join(["x", *run[3:25], "y", *run[:12], "z", *run[10:30]]))]
    got = {r["doc_id"]: [tuple(x) for x in r["repeats__"]] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(1, 23), (37, 57)]}
