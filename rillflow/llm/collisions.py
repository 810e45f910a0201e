"""Embedding near-dedup by collision-counting projections.

Vectors of one label link at cosine ``COSINE`` or more. Unit vectors are projected on ``PROJECTIONS`` random lines. On each
line a pair collides if the one lies in the window of half-width ``WINDOW`` times the greatest linked distance around the
other; a pair at exactly ``COSINE`` collides on a line with a known chance, so the count of its collisions is binomial,
and pairs whose count reaches the greatest number that such pairs reach with the needed chance are verified by their exact
cosine in double precision. Closer pairs collide more, so the chance holds for every linked pair; it is set by the number of
pairs in the table, so that all of them together are expected to lose at most ``MISSES`` links. Windows are wide, because
that parts the counts best: of random pairs in 64 dimensions 0.006 % are verified at 50,000 rows and 0.17 % at 10 million.

Scale: equal vectors of a label become one with a multiplicity. Rows are cut by label and by cells of the first line that
are as wide as the greatest linked distance, so that a link lies in one cell or two neighbours; a cell of more than
``BLOCK`` rows (fewer in tables too small to give every core a block) is cut into parts, and each pair of parts is a task of
at most twice ``BLOCK`` rows: a row is copied once for each part of its cell and of the two beside it. In a task windows are
ranges of ranks in the sorted projections, counted for tiles of pairs at once. A task returns a row per linked vector (its
links' number and its least companion), never the pairs, so groups of thousands of copies stay small.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without label or vec_id link
with nothing and are components of their own; vectors of different length never link; repeated rows are linked copies; a
row is kept if its vec_id is its component_id (repeated rows alike); an empty table gives an empty result; further columns
are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.ann import matrix, usable
from rillflow.llm.components import connected_components
from rillflow.llm.simhash import forest
from rillflow.llm.storage import map_texts, materialize

COSINE = 0.93
PROJECTIONS = 48
WINDOW = 2.5
RECALL = 0.9995
MISSES = 0.001
BLOCK = 8192
TILE = 1024
SEED = 11


def least_count(lines: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL, miss: float | None = None) -> int:
    """The greatest count that a pair at the linking distance reaches with chance ``recall``, or all but ``miss``."""
    p = erf(window / sqrt(2))
    missed = 0.0
    for k in range(lines + 1):
        missed += comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if missed > (1 - recall if miss is None else miss):
            return k
    return lines


def miss_for(rows: int) -> float:
    """The chance of missing a link at which all pairs of ``rows`` rows are expected to lose at most ``MISSES`` links."""
    return MISSES / max(1, rows * (rows - 1) // 2)


def verified_share(rows: int, dim: int, cosine: float = COSINE) -> float:
    """The share of pairs of independent random directions whose count makes them be verified."""
    lines, least = PROJECTIONS, least_count(miss=miss_for(rows))
    # squared distances of random unit vectors lie about 2, closely so in many dimensions
    q = erf(WINDOW * sqrt(2 - 2 * cosine) / 2 * sqrt(1 - 1 / dim))
    return sum(comb(lines, k) * q**k * (1 - q) ** (lines - k) for k in range(least, lines + 1))


def lines_for(dim: int, lines: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((lines, dim))


def linked(x: np.ndarray, y: np.ndarray, cosine: float, lines: np.ndarray, same: bool, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of linked pairs of unit rows, of those with ``least`` collisions; with ``same`` only i < j."""
    half = WINDOW * sqrt(2 - 2 * cosine)
    px, py = x @ lines.T, y @ lines.T
    for s in range(0, len(x), TILE):
        for t in range(s if same else 0, len(y), TILE):
            a, b = px[s : s + TILE], py[t : t + TILE]
            count = np.zeros((len(a), len(b)), np.uint8)
            rank = np.empty(len(b), np.int16)
            for m in range(len(lines)):
                order = np.argsort(b[:, m])
                rank[order] = np.arange(len(b), dtype=np.int16)
                line = b[order, m]
                lo = np.searchsorted(line, a[:, m] - half, "left").astype(np.int16)
                hi = np.searchsorted(line, a[:, m] + half, "right").astype(np.int16)
                count += ((rank[None, :] - lo[:, None]).view(np.uint16) < (hi - lo).view(np.uint16)[:, None]).view(np.uint8)
            i, j = np.nonzero(count >= least)
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 15):
                u, v = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                near = (x[u] * y[v]).sum(1) >= cosine
                if near.any():
                    yield u[near], v[near]


def _tasks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with the key of each task that they belong to, and their side in it."""
    cells = rows.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    near = cells.select("label", "dim", F.col("cell").alias("at"), "parts")
    for step, name in ((0, "own"), (1, "next"), (-1, "before")):
        side = near.select("label", "dim", (F.col("at") - step).alias("cell"), F.col("parts").alias(name))
        rows = rows.join(side, ["label", "dim", "cell"], "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))
    upto = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col(c) - 1))
    key = lambda c, i, d, j, right: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), F.lit(right).alias("right"))
    cell, part = F.col("cell"), F.col("part")
    tasks = F.concat(
        F.transform(upto("own"), lambda j: key(cell, F.least(part, j), cell, F.greatest(part, j), False)),
        F.transform(upto("next"), lambda j: key(cell, part, cell + 1, j, False)),
        F.transform(upto("before"), lambda j: key(cell - 1, j, cell, part, True)),
    )
    return rows.withColumn("task", F.explode(tasks)).select("label", "dim", "task.*", "part", "rep", "n", "v")


def _prepared(distinct: DataFrame, cosine: float) -> DataFrame:
    """(label, rep, n, v, dim, cell): vectors made of length 1, and their cell on the first line.

    Cells are as wide as the greatest linked distance; the line is a unit vector, so a linked pair's projections on it are
    less than a cell apart.
    """
    width = sqrt(2 - 2 * cosine) * 1.000001

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, size = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            edge = np.concatenate([[0], np.cumsum(size)])
            unit, cell = np.empty(len(flat)), np.zeros(len(size), np.int32)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                at = edge[rows][:, None] + np.arange(d)
                # by the greatest component first, so that no square overflows or vanishes
                x = flat[at] / np.abs(flat[at]).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                line = lines_for(d, 1)[0]
                unit[at], cell[rows] = x, np.floor(x @ line / np.linalg.norm(line) / width)
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(unit))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "rep", "n")), lists, pa.array(size.astype(np.int32)), pa.array(cell)], names=["label", "rep", "n", "v", "dim", "cell"])

    kind = distinct.schema["label"].dataType.simpleString()
    return map_texts(distinct.select("label", "rep", "n", "v"), run, f"label {kind}, rep long, n long, v array<double>, dim int, cell int")


def links(distinct: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """(node, links, root) of linked rows of (label, v, rep, n), from each task: links counts multiplicities."""

    size = distinct.count()
    least = least_count(miss=miss_for(size))
    block = block or min(BLOCK, max(512, -(-size // (2 * distinct.sparkSession.sparkContext.defaultParallelism))))

    def run(table: pa.Table) -> pa.Table:
        rep, n, v = table.column("rep").to_numpy(), table.column("n").to_numpy(), matrix(table.column("v").combine_chunks())
        c, i, d, j = (table.column(k)[0].as_py() for k in "cidj")
        lines = lines_for(v.shape[1])
        inner = c == d and i == j
        left = np.ones(len(rep), bool) if inner else table.column("part").to_numpy() == i if c == d else ~table.column("right").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(left), np.flatnonzero(left if inner else ~left)
        total, us, vs = np.zeros(len(rep), np.int64), [], []
        for x, y in linked(v[a], v[b], cosine, lines, inner, least):
            x, y = a[x], b[y]
            np.add.at(total, x, n[y])
            np.add.at(total, y, n[x])
            x, y = forest(rep[x], rep[y])
            us.append(x)
            vs.append(y)
        root = rep.copy()
        if us:
            x, y = forest(np.concatenate(us), np.concatenate(vs))
            order = np.argsort(rep)
            root[order[np.searchsorted(rep[order], x)]] = y
        got = total > 0
        return pa.table([pa.array(rep[got]), pa.array(total[got]), pa.array(root[got])], names=["node", "links", "root"])

    dealt = _tasks(materialize(_prepared(distinct, cosine), "collisions-rows"), block)
    return dealt.groupBy("label", "dim", "c", "i", "d", "j").applyInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    ok = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label", ok.alias("ok"))
    same = F.xxhash64("v").alias("h")
    good = rows.where("ok").select("vec_id", "label", "v", same)
    distinct = materialize(good.groupBy("label", "h", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "collisions-distinct")
    found = materialize(links(distinct.select("label", "v", "rep", "n"), cosine, block), "collisions-links")
    roots = connected_components(found.select("node", "root"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = distinct.join(counted, distinct["rep"] == counted["node"], "left").drop("node").join(roots, F.col("rep") == roots["node"], "left")
    known = known.select("label", "h", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = good.join(known, ["label", "h", "v"]).select("vec_id", "n_links", "component_id")
    done = done.unionByName(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def near_duplicates_sql() -> str:
    return f"""
with recursive v as (select vec_id, embedding::double[] as e, label, coalesce(label is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as ok from embeddings),
near as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where a.ok and b.ok and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach as (select vec_id as a, vec_id as b from v union select r.a, n.b from reach r join near n on r.b = n.a),
roots as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from near group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept from v left join counts on vec_id = counts.a left join roots on vec_id = roots.a
"""
