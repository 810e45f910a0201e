import base64

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import bpe, mixing, toxicity
from rillflow.llm.storage import materialize
from tests.llm.brute import WORD, substring
from tests.llm.test_simhash import expected

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, materialize(stage(spark, docs, SF), "test"))
        docs = seen[name][1]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    texts = {k: ({r["doc_id"]: r["text"] for r in a.collect()}, {r["doc_id"]: r["text"] for r in b.collect()} if "text" in b.columns else None) for k, (a, b) in seen.items()}

    before, after = texts["toxicity"]
    model = toxicity.fit(seen["toxicity"][0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = dict(zip(before, model.scores([t or "" for t in before.values()]), strict=True))
    assert after == {d: t for d, t in before.items() if scores[d] < 0.5} and len(after) < len(before)

    before, after = texts["simhash"]
    _, groups = expected(list(before.items()))
    assert after == {d: t for d, t in before.items() if groups[d] == d}

    before, after = texts["substring"]
    plain = substring(list(before.items()))
    for d, t in before.items():
        words, removed, _ = plain[d]
        assert (d in after) == (words == 0 or removed < words)
        if d in after:
            assert after[d] == t if not removed else len(WORD.findall(after[d])) == words - removed

    before, after = texts["mixing"]
    picks = {}
    for r in mixing.chosen(seen["mixing"][0]).collect():
        picks[r["doc_id"]] = picks.get(r["doc_id"], 0) + 1
    got = [r["doc_id"] for r in seen["mixing"][1].collect()]
    assert sorted(got) == sorted(d for d, n in picks.items() for _ in range(n))
    assert all(after[d] == before[d] for d in after)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    plain_coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in seen["bpe"][1].collect():
        assert r["ids"] == plain_coder.encode_ordinary(texts["bpe"][0][r["doc_id"]]) and r["round_trip"] and r["n_tokens"] == len(r["ids"])
    assert corpus_pipeline.run(spark, SF).count() == seen["bpe"][1].count()


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    long = "word " * 60_000
    odd = spark.createDataFrame([(None, None, "en", "src1", 0), (9001, "", None, None, 0), (9002, long, "en", "src1", len(long)), (9003, "twice told", "en", "src1", 10), (9003, "twice told", "en", "src1", 10)], docs.schema)
    names = ["times", "row__", "copy__", "whole", "name", "score__", "ids__", "n_removed__", "rest__", "hits", "fp"]
    docs = docs.unionByName(odd).withColumns({n: F.lit(n) for n in names}).withColumn("a b", F.struct(F.lit(1).alias("c d")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF), "test")
        assert docs.columns == before.columns and docs.where(" or ".join(f"`{n}` <> '{n}' or `{n}` is null" for n in names)).count() == 0
        kept = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "mixing":
            assert kept.count(None) == 1 and {9001, 9002} <= {*kept} and kept.count(9003) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(kept)
