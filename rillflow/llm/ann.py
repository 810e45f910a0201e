"""Approximate nearest neighbours by score-aware four-bit codes.

Nearness by Euclidean distance is a maximum inner product: with x' = (x, -|x|²/2) and q' = (q, 1), q'·x' is larger where x
is nearer. Vectors x' are cut into blocks of two dimensions, each with sixteen code words (four bits). Code words are fit,
and codes chosen, for the anisotropic loss: the part of the residual that is parallel to x' costs ``PARALLEL`` times as
much as the rest, because that part is what moves large inner products. Codes are chosen by coordinate descent over the
blocks, and code words by the loss's normal equations; both use a sample of at most ``SAMPLE`` vectors.

Search: every vector is coded and dealt to a code block; the queries are dealt to query blocks, and each pair of blocks is
a task: per query a table of its products with the code words (two four-bit tables joined into one of 256), one lookup per
byte of code, the ``RERANK`` best codes of the block, and their exact distances in double precision. Every other row whose
code comes within a margin of the k-th of these is scored exactly too. The margin is ``MARGIN`` deviations of what the query's
products with residuals of the block's length are, taken from ``MARGIN_SAMPLE`` rows, so that a neighbour is lost about once in
thousands. Where the best codes' rows have their residuals in common (near copies), codes can't tell them apart and the
margin is the residual's whole length, which loses none. A task returns ten rows a query, and the last step ranks those.

Scale: a code block has at most about ``BLOCK`` rows and a query block ``QUERY_BLOCK`` (24 MB at 64 dimensions), fewer in
tables too small to give every core a block, so that a task's memory is bounded. n rows and q queries make n/BLOCK copies
of each query and q/QUERY_BLOCK copies of each row: with a query in a hundred rows, 5 million rows are copied three times
and 50,000 queries 153 times.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows without vec_id, and vectors of
another length than most take no part; ties go to the smaller vec_id, among all candidates of equal code too; repeated rows
are candidates each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 8192
PARALLEL = 4.0
BLOCK = 32768
QUERY_BLOCK = 16384
RERANK = 64
#: Deviations of a query's products with residual directions, taken over so many rows of a block, within which codes decide.
MARGIN = 3.25
MARGIN_SAMPLE = 1024
#: Squared length of the mean residual direction of the best codes' rows from which they count as near copies.
COPIES = 0.2
WIDTH = 2
K = 10


def usable(vector: Column) -> Column:
    """True where a vector has only finite components, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Codebook:
    """Code words for blocks of ``WIDTH`` dimensions of augmented vectors, trained on a sample."""

    def __init__(self, sample: np.ndarray, rounds: int = 6, seed: int = 5):
        x = self.augmented(sample)
        rng = np.random.default_rng(seed)
        self.blocks = x.shape[1] // WIDTH
        parts = x.reshape(len(x), self.blocks, WIDTH)
        start = rng.choice(len(x), 16, replace=len(x) < 16)
        self.words = parts[start].transpose(1, 0, 2).copy()
        for _ in range(4):
            self._means(parts, self._nearest(parts))
        for _ in range(rounds):
            self._anisotropic_words(x, self.encode_augmented(x))

    @staticmethod
    def augmented(vectors: np.ndarray) -> np.ndarray:
        x = np.asarray(vectors, np.float64)
        pad = (-x.shape[1] - 1) % (2 * WIDTH)
        return np.hstack([x, -0.5 * (x * x).sum(axis=1, keepdims=True), np.zeros((len(x), pad))])

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        return np.stack([((parts[:, b, None] - self.words[b][None]) ** 2).sum(-1).argmin(1) for b in range(self.blocks)], 1)

    def _means(self, parts: np.ndarray, codes: np.ndarray) -> None:
        for b in range(self.blocks):
            for w in range(16):
                mine = codes[:, b] == w
                if mine.any():
                    self.words[b, w] = parts[mine, b].mean(0)

    def _anisotropic_words(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The words of each block that are least in the loss, given the codes and the other blocks' words."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        parts, dirs = x.reshape(len(x), self.blocks, WIDTH), unit.reshape(len(x), self.blocks, WIDTH)
        coded = self.words[np.arange(self.blocks), codes]
        along = ((parts - coded) * dirs).sum((1, 2))
        extra = PARALLEL - 1
        for b in range(self.blocks):
            # the parallel part of the residual without this block's own share of it
            other = along - ((parts[:, b] - coded[:, b]) * dirs[:, b]).sum(1)
            for w in range(16):
                m = codes[:, b] == w
                if m.any():
                    u = dirs[m, b]
                    left = m.sum() * np.eye(WIDTH) + extra * u.T @ u
                    right = parts[m, b].sum(0) + extra * (u * (other[m] + (parts[m, b] * u).sum(1))[:, None]).sum(0)
                    self.words[b, w] = np.linalg.solve(left, right)
            coded[:, b] = self.words[b][codes[:, b]]
            along = other + ((parts[:, b] - coded[:, b]) * dirs[:, b]).sum(1)

    def encode_augmented(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes of least anisotropic loss: nearest words first, then coordinate descent over the blocks."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        parts, dirs = x.reshape(len(x), self.blocks, WIDTH), unit.reshape(len(x), self.blocks, WIDTH)
        away = [parts[:, b, None] - self.words[b][None] for b in range(self.blocks)]
        square = np.stack([(a**2).sum(-1) for a in away], 1)
        parallel = np.stack([(a * dirs[:, b, None]).sum(-1) for b, a in enumerate(away)], 1)
        codes = square.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(parallel, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(passes):
            for b in range(self.blocks):
                other = total - parallel[rows, b, codes[:, b]]
                loss = square[:, b] + (PARALLEL - 1) * (other[:, None] + parallel[:, b]) ** 2
                codes[:, b] = loss.argmin(1)
                total = other + parallel[rows, b, codes[:, b]]
        return codes

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte: (rows, blocks / 2)."""
        codes = np.concatenate([self.encode_augmented(self.augmented(vectors[i : i + 1024])) for i in range(0, len(vectors), 1024)]).astype(np.uint8)
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The augmented vectors that rows of code bytes stand for."""
        each = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), self.blocks)
        return self.words[np.arange(self.blocks), each].reshape(len(codes), -1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): the inner product of a query with what each byte of code stands for."""
        q = np.asarray(queries, np.float64)
        q = np.hstack([q, np.ones((len(q), 1)), np.zeros((len(q), self.blocks * WIDTH - q.shape[1] - 1))]).reshape(len(q), self.blocks, WIDTH)
        each = np.einsum("qbd,bwd->qbw", q, self.words)
        return (each[:, 0::2, None, :] + each[:, 1::2, :, None]).reshape(len(q), self.blocks // 2, 256).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Block:
    """Coded rows in order of vec_id, and the search among them."""

    def __init__(self, codebook: Codebook, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], vectors[order]
        self.columns = np.ascontiguousarray(codes[order].T)
        residual = codebook.augmented(self.v) - codebook.decode(codes[order])
        self.norm = np.linalg.norm(residual, axis=1)
        #: rows of small residuals may be a group's, which errs in its own way; they get the margin of the others
        self.usual = np.maximum(self.norm, self.norm.mean())
        self.directions = (residual / np.maximum(self.norm, 1e-300)[:, None]).astype(np.float32)
        self.sample = self.directions[np.linspace(0, len(ids) - 1, min(len(ids), MARGIN_SAMPLE)).astype(int)]

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """By query: how far a product may be from its code's, in units of the row's residual, but for one row in thousands."""
        padded = np.zeros((len(queries), self.directions.shape[1]))
        padded[:, : queries.shape[1]], padded[:, queries.shape[1]] = queries, 1.0
        return MARGIN * np.sqrt(((self.sample @ padded.T) ** 2).mean(0))

    def nearest(self, query: int, q: np.ndarray, table: np.ndarray, margin: float, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances) of the ``k`` nearest rows but the query's own, and how many rows were measured."""
        near = table[0][self.columns[0]]
        for m in range(1, len(self.columns)):
            near += table[m][self.columns[m]]
        other = self.ids != query
        near[~other] = -np.inf
        if rerank < len(near):
            # candidates of equal code come in order of vec_id
            edge = np.partition(near, len(near) - rerank)[len(near) - rerank]
            above = np.flatnonzero(near > edge)
            picked = np.concatenate([above, np.flatnonzero(near == edge)[: rerank - len(above)]])
        else:
            picked = np.arange(len(near))
        picked = picked[other[picked]]
        d = np.sqrt(((self.v[picked] - q) ** 2).sum(1))
        if rerank < len(near):
            # what the scan's single precision may be off, and the product that a row must reach to be among the k nearest
            off = 2.0**-22 * len(self.columns) * np.abs(table).max(1).sum(dtype=np.float64)
            least = ((q**2).sum() - np.partition(d, k - 1)[k - 1] ** 2) / 2 if len(d) >= k else -np.inf
            bound = np.sqrt((q**2).sum() + 1) * self.norm
            # near copies are off all alike, so that nothing but the residual's whole length bounds them
            alike = np.linalg.norm(self.directions[picked].mean(0, dtype=np.float64)) ** 2 > COPIES
            reach = bound if alike else np.minimum(bound, margin * self.usual)
            open_ = other & (near + reach + off >= least - 1e-9 * abs(least))
            open_[picked] = False
            more = np.flatnonzero(open_)
            picked = np.concatenate([picked, more])
            d = np.concatenate([d, np.sqrt(((self.v[more] - q) ** 2).sum(1))])
        best = np.lexsort((self.ids[picked], d))[:k]
        return self.ids[picked][best], d[best], len(picked)


def fit(vectors: DataFrame, size: int = SAMPLE) -> Codebook:
    """Code words from the ``size`` rows of least hash; a bounded sample of fixed-length rows."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("v").collect()
    return Codebook(np.array([r["v"] for r in rows], np.float64))


def search(vectors: DataFrame, is_query: Column, k: int = K, block: int | None = None, rerank: int = RERANK, codebook: Codebook | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of every query row among all rows of (vec_id, v array<double>)."""
    spark = vectors.sparkSession
    sizes = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0)).alias("q"), F.mode(F.size("v")).alias("d")).first()
    if not sizes["n"] or not sizes["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size("v") == sizes["d"])
    shipped = spark.sparkContext.broadcast(codebook or fit(vectors))
    # as many tasks as cores where the blocks of a small table would make fewer
    cores = 2 * spark.sparkContext.defaultParallelism
    block = block or int(min(BLOCK, max(256, -(-sizes["n"] // cores))))
    blocks, query_blocks = -(-sizes["n"] // block), -(-sizes["q"] // QUERY_BLOCK)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = shipped.value.encode(matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*b.schema.names, "code"])

    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    base = vectors.select("vec_id", "v").mapInArrow(code, "vec_id long, v array<double>, code binary").withColumn("cb", spread(blocks))
    base = base.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = vectors.where(is_query).select("vec_id", "v", spread(query_blocks).alias("qb")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            held = Block(shipped.value, left.column("vec_id").to_numpy(), matrix(left.column("v").combine_chunks()), codes)
            queries, qs = right.column("vec_id").to_numpy(), matrix(right.column("v").combine_chunks())
            for s in range(0, len(qs), 32):
                for query, q, t, m in zip(queries[s : s + 32], qs[s : s + 32], shipped.value.tables(qs[s : s + 32]), held.margins(qs[s : s + 32]), strict=True):
                    ids, d, _ = held.nearest(query, q, t, m, k, rerank)
                    for column, x in zip(out, (np.full(len(ids), query), ids, d), strict=True):
                        column.append(x)
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    found = base.groupBy("cb", "qb").cogroup(asked.groupBy("cb", "qb")).applyInArrow(scan, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return search(rows, F.col("vec_id") % 100 == 0)
