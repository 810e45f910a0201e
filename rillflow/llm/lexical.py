"""Ranked lexical search, reversed: few queries (items) against very many documents.

The items' inverted index (term to items) is the broadcast side. Each task streams its documents' term counts through it and
keeps a heap of the best documents of each item; heaps of all tasks are merged. Documents are read once: their counts of index
terms go to a table in the shared folder, from which the corpus statistics come and which the scoring pass reads.

What is broadcast is bounded: an index holds at most ``INDEX_POSTINGS`` postings (term, item), and items beyond that are searched in
blocks, each with its own index and passes. (One item is never split: its terms are as many as its text has.)

Defined results: a null text has no terms; an item or a document without terms finds nothing and counts in no statistic; a
text of any length is read whole, a megabyte at a time. Each row of items is an item of its own, each row of documents a
document, whether ids repeat or are null; of documents with equal scores those without doc_id come last. An empty table on
either side gives an empty result. Further columns of either table are not read, whatever they are called.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.storage import drop, map_texts, materialize

#: The words of a text in UTF-8, once ``bytes.lower`` has lower-cased A-Z and nothing else: every byte over 0x7F belongs to one.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PIECE = 1 << 20
INDEX_POSTINGS = 2_000_000
#: Scores held at once in a task: documents of a batch times items.
CELLS = 1 << 21
#: Heaps of so many tasks' groups are merged first, so that no merge reads those of all tasks.
MERGES = 32
EXACT = 1 << 53
COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"
HEAPS = "item int, doc_id long, score long"


def term_counts(text: str | bytes | None) -> Counter:
    """How often each term occurs in a whole text; texts over a megabyte are cut between words."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower()
    if len(raw) <= PIECE:
        return Counter(TERM.findall(raw))
    found: Counter = Counter()
    at = 0
    while at < len(raw):
        cut = _BREAK.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        found.update(TERM.findall(raw, at, end))
        at = end
    return found


class Index:
    """Term numbers, and the items that hold each term as one flat list."""

    def __init__(self, items: list[set[bytes]]):
        self.n_items = len(items)
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*items)))} if items else {}
        pairs = sorted((self.terms[t], j) for j, held in enumerate(items) for t in held)
        self.items = np.array([j for _, j in pairs], np.int64)
        self.size = np.bincount([i for i, _ in pairs], minlength=len(self.terms)).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.longest = max(map(len, items), default=0)


def _counted(index) -> object:
    """Batches of (doc_id, text) to counts of index terms; documents without any term of their own are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.terms
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            ids, n, terms, tfs, ends = [], [], [], [], [0]
            for i, doc in enumerate(batch.column("doc_id")):
                counts = term_counts(text[i].as_py())
                if not counts:
                    continue
                for t, tf in counts.items():
                    if t in number:
                        terms.append(number[t])
                        tfs.append(tf)
                ids.append(doc.as_py())
                n.append(counts.total())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def _scores(index: Index, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_docs: int, exact: int = EXACT) -> np.ndarray:
    """(documents, items) scores, whole numbers; entries (doc, term, tf) are laid out once for each item of their term."""
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    times = index.size[term]
    first = np.cumsum(times) - times
    at = np.arange(int(times.sum())) + np.repeat(index.start[term] - first, times)
    cell = np.repeat(doc * index.n_items, times) + index.items[at]
    if int(weights.max(initial=0)) * 1_000_000 * index.longest < exact:
        return np.bincount(cell, np.repeat(part, times), n_docs * index.n_items).astype(np.int64).reshape(n_docs, -1)
    total = np.zeros(n_docs * index.n_items, np.int64)
    np.add.at(total, cell, np.repeat(part, times))
    return total.reshape(n_docs, -1)


def _heaped(index, weights: list[int], n_docs: int, n_terms: int, k: int) -> object:
    """Batches of counts to the task's best ``k`` documents of each item."""
    cells, exact = CELLS, EXACT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, w = index.value, np.array(weights, np.int64)
        heaps: list[list] = [[] for _ in range(held.n_items)]
        floor = np.ones(held.n_items, np.int64)  # a score below an item's floor can't enter its heap
        step = max(1, cells // max(held.n_items, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, terms, tfs = part.num_rows, part.column("terms"), part.column("tfs")
                doc = np.repeat(np.arange(rows), terms.value_lengths().to_numpy())
                m = np.array([10 + (90 * n * n_docs) // n_terms for n in part.column("n").to_pylist()], np.int64)
                score = _scores(held, w, doc, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), m, rows, exact)
                least = np.maximum(floor, np.partition(score, rows - k, axis=0)[rows - k]) if rows > k else floor
                ids = part.column("doc_id").to_pylist()
                for d, i in zip(*(x.tolist() for x in np.nonzero(score >= least)), strict=True):
                    entry = (int(score[d, i]), ids[d] is not None, -(ids[d] or 0))
                    heap = heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[i] = heap[0][0]
        rows = [(i, -e[2] if e[1] else None, e[0]) for i, heap in enumerate(heaps) for e in heap]
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def _best(heaps: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """The search of items (id, terms) whose index fits a broadcast."""
    spark = docs.sparkSession
    index = Index([terms for _, terms in items])
    shipped = spark.sparkContext.broadcast(index)
    counts = materialize(map_texts(docs, _counted(shipped), COUNTS), "counts")
    totals = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 1
    found = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # as many rows as the index has terms
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(index.terms))]
    heaps = counts.mapInArrow(_heaped(shipped, weights, n_docs, n_terms, k), HEAPS)
    merged = materialize(_best(heaps.withColumn("part", F.spark_partition_id() % MERGES), ["item", "part"], k).drop("part", "rank"), "heaps")
    drop(counts)
    names = F.broadcast(spark.createDataFrame([(j, i) for j, (i, _) in enumerate(items)], "item int, item_id long"))
    return _best(merged, ["item"], k).join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, index_postings: int = INDEX_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text) with a score above 0."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks: list[DataFrame] = []
    held: list[tuple] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        terms = set(term_counts(r["text"]))
        if held and size + len(terms) > index_postings:
            blocks.append(_search_block(docs, held, k))
            held, size = [], 0
        if terms:
            held.append((r["item_id"], terms))
            size += len(terms)
    if held:
        blocks.append(_search_block(docs, held, k))
    return reduce(DataFrame.unionByName, blocks) if blocks else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def lexical_sql(k: int = 10) -> str:
    """The same in SQL, by joins of whole term tables."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with d as (select doc_id, row_number() over () as r, {terms} as t from documents), i as (select item_id, row_number() over () as q, list_distinct({terms}) as t from benchmark),
sizes as (select r, doc_id, len(t)::bigint as n from d where len(t) > 0), total as (select count(*)::bigint as nn, sum(n)::bigint as ll from sizes),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(t) as term from d) group by r, term), df as (select term, count(*)::bigint as df from tf group by term),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w from df, total), asked as (select item_id, q, unnest(t) as term from i),
scored as (select item_id, q, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
  from asked join w using (term) join tf using (term) join sizes using (r), total group by item_id, q, doc_id, r),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {k}"""
