"""SimHash near-duplicate groups by pigeonhole blocks.

Fingerprints of 64 bits are cut into ``distance + extra`` blocks. Two that differ in at most ``distance`` bits agree in
at least ``extra`` whole blocks, so every combination of ``extra`` blocks is a join key and no close pair is missed. Rows
are joined on those keys by one shuffle and the Hamming distance is verified inside each key, in vectorized comparisons
of sorted runs. Only equal texts' representatives take part, and a task returns a forest of the links that it found, never
all pairs, so a large group of copies costs its comparisons but no rows. A key with more than ``block_rows`` rows is
cut into parts; each pair of parts is compared in a task of its own.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated rows and ties share
a component; a row without doc_id gets the component of its fingerprint's other rows, or null; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.components import connected_components
from rillflow.llm.storage import map_texts, materialize

DISTANCE = 4
EXTRA_BLOCKS = 2
SHINGLE_WORDS = 4
BLOCK_ROWS = 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, n: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if set in over half of its shingles' XXH64 values."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(joined, 42)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[n - 1 :], strict=False)), np.uint64, len(words) - n + 1)
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    rows = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 1 << 16):
        bits = np.unpackbits(rows[i : i + (1 << 16)], axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if whole else 0
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(x or "", shingle) for x in (v.as_py() for v in b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, fp long")


def _block_masks(distance: int, extra: int) -> list[int]:
    edges = [round(i * 64 / (distance + extra)) for i in range(distance + extra + 1)]
    blocks = [((1 << (e - s)) - 1) << s for s, e in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, extra)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its group) for linked values a[i]-b[i], without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(run: np.ndarray, side: np.ndarray, split: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the close pairs inside runs of equal ``run``. In a run whose ``split`` is set only unlike sides meet."""
    edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    size = np.diff(edge)
    a, b = [], []
    small = int(min(64, size.max(initial=1)))
    of = np.repeat(np.where(size <= 64, np.arange(len(size)), -1 - np.arange(len(size))), size)
    for o in range(1, small):
        at = np.flatnonzero((of[o:] == of[:-o]) & (of[o:] >= 0))
        at = at[(np.bitwise_count(fp[at] ^ fp[at + o]) <= distance) & (~split[at] | (side[at] != side[at + o]))]
        a.append(rep[at])
        b.append(rep[at + o])
    for k in np.flatnonzero(size > 64):
        lo, hi = edge[k], edge[k + 1]
        ga, gb = [], []
        for i in range(lo, hi, tile):
            for j in range(i, hi, tile):
                p, q = slice(i, min(i + tile, hi)), slice(j, min(j + tile, hi))
                near = np.bitwise_count(fp[p, None] ^ fp[None, q]) <= distance
                if split[lo]:
                    near &= side[p, None] != side[None, q]
                x, y = np.nonzero(near)
                x, y = x + i, y + j
                kept = x < y
                x, y = forest(rep[x[kept]], rep[y[kept]]) if kept.any() else (x[:0], y[:0])
                ga.append(x)
                gb.append(y)
        a += ga
        b += gb
    a, b = np.concatenate([*a, rep[:0]]), np.concatenate([*b, rep[:0]])
    return forest(a, b) if len(a) else (a, b)


def close_pairs(distinct: DataFrame, distance: int = DISTANCE, extra: int = EXTRA_BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between representatives of (fp, rep) rows whose transitive closure is that of all close pairs."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in _block_masks(distance, extra)])
    keyed = distinct.select("fp", "rep", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("combo", "part"))
    hot = keyed.groupBy("combo", "part").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    hot = hot.select("combo", "part", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    side = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(hot, ["combo", "part"], "left").withColumn("parts", parts).withColumn("side", F.when(F.col("parts") == 1, 0).otherwise(side))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    group = F.xxhash64("combo", "part", F.least("side", "other"), F.greatest("side", "other"))
    rows = dealt.select(group.alias("run"), "side", ((F.col("parts") > 1) & (F.col("side") != F.col("other"))).alias("mixed"), "fp", "rep")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("run", "side", "mixed", "fp", "rep")
        kept = None
        out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def work(c: dict) -> pa.RecordBatch:
            # a run whose rows all have other == side compares within; the mixed part of a cut key compares across
            return out(*_links(c["run"], c["side"], c["mixed"], c["fp"].view(np.uint64), c["rep"], distance))

        for b in _larger(batches):
            now = {n: b.column(n).to_numpy() for n in names}
            if kept is not None:
                now = {n: np.concatenate([kept[n], now[n]]) for n in names}
            last = int(np.searchsorted(now["run"], now["run"][-1]))
            kept = {n: v[last:] for n, v in now.items()}
            if last:
                yield work({n: v[:last] for n, v in now.items()})
        if kept is not None:
            yield work(kept)

    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(search, "a long, b long")


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from smaller batches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def near_duplicate_groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE_WORDS, extra: int = EXTRA_BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    fps = materialize(fingerprints(docs, shingle=shingle), "simhash")
    distinct = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = materialize(distinct, "simhash-distinct")
    found = connected_components(close_pairs(distinct, distance, extra, block_rows))
    members = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(members, "fp", "left").select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicate_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate group; rows without doc_id stay."""
    kept = near_duplicate_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
