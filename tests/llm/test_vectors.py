import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import ann, collisions
from tests.llm.brute import components

SF = "/root/testdata/sf0.001"


def clustered(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 8, dim))
    x = centers[rng.integers(0, len(centers), n)] + 0.12 * rng.standard_normal((n, dim))
    x[5] = x[3]
    x[9] = x[3]
    return x


def nearest(x, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    d[i] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k], d


@pytest.mark.parametrize("block", [300, 4096])
def test_search_recall(spark, block):
    x = clustered(2000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    rows = ann.search(df, F.col("vec_id") % 40 == 0, block=block, rerank=80).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, got in found.items():
        want, d = nearest(x, q, 10)
        assert [g[0] for g in sorted(got)] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-9 for _, v, s in got)
        hits += len(set(want.tolist()) & {v for _, v, _ in got})
    assert len(found) == 50 and hits / 500 >= 0.95


@pytest.mark.parametrize("noise", [0.003, 0.02])
def test_search_in_a_large_group_of_near_copies(spark, noise):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    x[::3] = x[0] / np.linalg.norm(x[0])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] += noise * rng.standard_normal((len(x[::3]), 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = sum(len(set(g.values()) & set(nearest(x, q, 10)[0].tolist())) for q, g in got.items())
    assert len(got) == 80 and hits == 800


def test_search_by_query_group_at_production_settings(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((12_000, 64))
    x[1::2] = x[1] + 0.05 * np.linalg.norm(x[1]) / 8 * rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 101 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = {0: [], 1: []}
    for q, g in got.items():
        found[q % 2].append(len(g & set(nearest(x, q, 10)[0].tolist())) / 10)
    assert len(got) == 119 and np.mean(found[0]) >= 0.9 and np.mean(found[1]) >= 0.9


def searched(x, queries):
    """(recall, share of the rows measured exactly) over one block."""
    codebook = ann.Codebook(x[: ann.SAMPLE])
    block = ann.Block(codebook, np.arange(len(x)), x, codebook.encode(x))
    hits = measured = 0
    for i in queries:
        q = x[i : i + 1]
        ids, _, n = block.nearest(i, q[0], codebook.tables(q)[0], block.margins(q)[0], 10, ann.RERANK)
        hits, measured = hits + len(set(ids.tolist()) & set(nearest(x, i, 10)[0].tolist())), measured + n
    return hits / 10 / len(queries), measured / len(queries) / len(x)


def test_codes_decide_on_most_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    recall, share = searched(np.array([r["embedding"] for r in rows], np.float64), range(0, 2000, 10))
    assert recall >= 0.98 and share < 0.1
    x = np.random.default_rng(0).standard_normal((20_000, 64))
    recall, share = searched(x / np.linalg.norm(x, axis=1, keepdims=True), range(0, 20_000, 400))
    assert recall >= 0.98 and share < 0.05


@pytest.mark.parametrize("noise", [0.003, 0.01, 0.03, 0.05])
def test_codes_in_groups_of_near_copies(noise):
    rng = np.random.default_rng(int(noise * 1000))
    x = rng.standard_normal((4000, 64))
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] += noise * rng.standard_normal((len(x[::3]), 64))
    for queries in (range(0, 4000, 96), range(1, 4000, 96)):
        recall, share = searched(x, queries)
        assert recall >= 0.95 and share < 0.35


def test_codes_narrow_down_small_blocks_too(spark):
    x = clustered(2000)
    codes = ann.Codebook(x)
    assert ann.RERANK < 100 and codes.encode(x).shape == (2000, codes.blocks // 2)


def test_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in ann.op1_ann(spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[q] & set(ids[nearest(x, i, 10)[0]].tolist())) for i, q in enumerate(ids) if q % 100 == 0]
    assert sum(hits) >= 9 * len(hits)


ODD = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.01], 1), (8, [1.0, 0.01], 1), (9, [0.0, 1.0], 1)]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x"))
    good = df.where(ann.usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(good, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(100, 1, 7), (100, 2, 8), (100, 3, 8), (100, 4, 9)]
    assert ann.search(good.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    near = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in collisions.near_duplicates(df).collect()), key=str)
    assert near == sorted([(i, 0, i, True) for i in (1, 2, 3, 4, 5, 7, 9)] + [(None, 0, None, False), (100, 2, 8, False), (8, 2, 8, True), (8, 2, 8, True)], key=str)
    assert collisions.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [64, 2048])
def test_links_against_all_pairs(spark, block):
    x = clustered(800)
    label = np.arange(800) % 3
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= collisions.COSINE) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    i, j = np.nonzero(np.triu(near))
    groups = components(list(range(800)), list(zip(i.tolist(), j.tolist(), strict=True)))
    got = {r["vec_id"]: r for r in collisions.near_duplicates(df, block=block).collect()}
    total = sum(r["n_links"] for r in got.values())
    assert near.sum() > 500 and total >= 0.99 * near.sum() and total <= near.sum()
    assert sum(got[k]["component_id"] == groups[k] for k in range(800)) >= 792


def test_every_link_at_the_limit(spark):
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centers = unit(rng.standard_normal((20, 64)))
    near = np.repeat(centers, 800, axis=0)
    aside = rng.standard_normal(near.shape)
    aside = unit(aside - (aside * near).sum(1, keepdims=True) * near)
    cosine = collisions.COSINE + 1e-4
    x = unit(np.concatenate([centers, cosine * near + np.sqrt(1 - cosine**2) * aside]))
    links = np.zeros(len(x), np.int64)
    for s in range(0, len(x), 1000):
        links[s : s + 1000] = (x[s : s + 1000] @ x.T >= collisions.COSINE).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collisions.near_duplicates(df).collect()}
    assert all(links[:20] >= 800) and [got[i][0] for i in range(len(x))] == links.tolist()
    assert all(got[i][1] == min((i - 20) // 800, got[(i - 20) // 800][1]) for i in range(20, len(x)))


def test_calibrated_count():
    assert collisions.least_count(recall=0.999) <= collisions.least_count(recall=0.9) < collisions.PROJECTIONS


def test_few_pairs_are_verified():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lines, half = collisions.lines_for(64), collisions.WINDOW * np.sqrt(2 - 2 * collisions.COSINE)
    p = x @ lines.T
    least = collisions.least_count(miss=collisions.miss_for(1500))
    counts = sum((np.abs(p[:, None, m] - p[None, :, m]) <= half).astype(int) for m in range(len(lines)))
    share = (np.triu(counts >= least, 1)).sum() / (1500 * 1499 / 2)
    assert share < 1e-3 and collisions.verified_share(51_282, 64) < 1e-3 and collisions.verified_share(10_000_000, 64) < 0.05
    # without lines every pair is verified
    passed = sum(len(i) for i, _ in collisions.linked(x, x, -1.0, lines[:0], True, 0))
    assert passed == 1500 * 1499 // 2


def test_the_query_finds_every_planted_link(spark, tmp_path):
    """20,000 rows in ten labels, a third of them in one: pairs, groups at the limit, and 1,500 copies of one vector."""
    rng = np.random.default_rng(21)
    n = 20_000
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, 64)))
    label = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 10, n))
    for k in range(600):
        mine = rng.choice(n, int(rng.integers(2, 12)), replace=False)
        aside = rng.standard_normal((len(mine), 64))
        aside = unit(aside - (aside @ x[mine[0]])[:, None] * x[mine[0]])
        cosine = rng.uniform(0.9301, 0.9999, (len(mine), 1))
        x[mine] = cosine * x[mine[0]] + np.sqrt(1 - cosine**2) * aside
        label[mine] = label[mine[0]]
    x[rng.choice(n, 1500, replace=False)] = x[7]
    rows = spark.createDataFrame([(i, v.tolist(), int(c), "?") for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int, n_links string")
    rows.repartition(6).write.parquet(str(tmp_path / "embeddings.parquet"))
    x = unit(x.astype(np.float32).astype(np.float64))
    links, pairs, close = np.zeros(n, np.int64), [], 0
    for c in range(10):
        at = np.flatnonzero(label == c)
        for s in range(0, len(at), 1000):
            cosines = x[at[s : s + 1000]] @ x[at].T
            i, j = np.nonzero(cosines >= collisions.COSINE)
            links[at[s : s + 1000]] = np.bincount(i, minlength=len(at[s : s + 1000])) - 1
            # a row's least partner and its own links, but of large groups only the first, hold all components together
            first = np.unique(i, return_index=True)[1]
            small = links[at[s + i]] < 200
            keep = np.union1d(np.flatnonzero(small), first)
            pairs += zip(at[s + i[keep]].tolist(), at[j[keep]].tolist(), strict=True)
            close += int((np.abs(cosines - collisions.COSINE) < 1e-12).sum())
    assert close == 0 and (links > 0).sum() > 3000
    groups = components(list(range(n)), pairs)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collisions.op9_embedding_near_dedup(spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(n)] == links.tolist()
    assert [got[i][1] for i in range(n)] == [groups[i] for i in range(n)]
