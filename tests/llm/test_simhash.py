import random

import pytest
import xxhash

from rillflow.llm import simhash
from rillflow.llm.components import connected_components
from tests.llm.brute import WORD, components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, n=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = {d: plain_fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    return prints, components(ids, links)


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints, groups = expected(rows)
    for r in simhash.op6_simhash_near_dedup(spark, SF).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == groups[r["doc_id"]]


@pytest.mark.parametrize("block_rows", [3, 2048])
def test_links_of_planted_fingerprints(spark, block_rows):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {i: base[i % 6] ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))) for i in range(150)}
    distinct = {}
    for i, p in prints.items():
        distinct.setdefault(p, i)
    signed = [(p - (1 << 64) if p >> 63 else p, i) for p, i in distinct.items()]
    links = simhash.close_pairs(spark.createDataFrame(signed, "fp long, rep long"), block_rows=block_rows)
    got = components(list(distinct.values()), [tuple(r) for r in links.collect()])
    nodes = list(distinct.items())
    near = [(i, j) for p, i in nodes for q, j in nodes if i < j and (p ^ q).bit_count() <= 4]
    assert got == components([i for _, i in nodes], near)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b c d e", "z"), (3, "a b c d e", "z"), (None, "a b c d e", "w"), (5, "A\tb  C\nd e", "v"), (6, "w " * 50_000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, 3), (5, 3), (6, 6)}
    kept = [r["doc_id"] for r in simhash.keep_first(docs).collect()]
    assert sorted(kept, key=str) == [1, 3, 3, 6, None]
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and len(got) == 101
