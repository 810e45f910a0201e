"""Substring dedup by seed and extend on winnowed anchors.

A repeat is a run of at least ``length`` words that also starts in a document with a smaller doc_id; its words go. The
first keeper, by doc_id, keeps them.

Seeds: each document's ``ANCHOR``-word grams are winnowed so that any ``length`` consecutive words hold a chosen gram, and
two documents that share those words choose the same one. Anchors found in more than one document are joined back to the
documents. Extension: each such anchor is extended both ways, by o words to the left and the rest to the right for every o,
to the windows of ``length`` words that hold it; documents are joined on the extended anchors, each with the least doc_id
that has it. The runs of a document's matched windows are its maximal repeats over the threshold (``repeats__``): a repeat
of any length has an anchor in every window, so it grows by as many steps as it has windows. Joining to the least doc_id of
each extension, and not to one fixed document or to every pair, keeps work in proportion to the anchors, however many
documents share a passage, and still finds the repeats that only two of an anchor's documents have. Aggregations combine
before the shuffle and are written; the joins back then shuffle both sides for themselves, with one row per key on one
side, so that adaptive execution splits a hot key.

Words are hashed by non-linear 64-bit hashes; an extension is matched by 64 bits and by 32 bits that rest on a second,
independent hash of the words, a whole document by the 128 bits of XXH3 over its words' hashes.

Documents that repeat a smaller doc_id's whole word sequence are found by one hash and need no extension.

Defined results: null and short texts lose nothing; a row without doc_id neither loses words nor removes others'; rows
with equal doc_id never remove each other's words; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.storage import drop, map_texts, materialize
from rillflow.llm.words import gram_hashes, mixed, sequence_hashes, text_slices, winnowed, word_hashes, word_spans

LENGTH = 13
ANCHOR = 7


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.ListArray:
    """One list for each of ``n`` documents from values in document order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def seeds(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, whole, check, anchors) of every row of (doc_id, text): its sequence hash and distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, at in text_slices(b):
                n = part.num_rows
                starts, ends, doc = word_spans(data, at)
                words = word_hashes(data, starts, ends)
                grams, valid = gram_hashes(words, doc, anchor)
                chosen = winnowed(grams, valid, length - anchor + 1)
                got, of = grams[chosen], doc[chosen]
                order = np.lexsort((got, of))
                got, of = got[order], of[order]
                new = np.ones(len(got), bool)
                new[1:] = (got[1:] != got[:-1]) | (of[1:] != of[:-1])
                whole, check = sequence_hashes(words, doc, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.bincount(doc, minlength=n)), _signed(whole), _signed(check), _lists(got[new].view(np.int64), of[new], n)],
                    names=["doc_id", "n_words", "whole", "check", "anchors"],
                )

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_words long, whole long, check long, anchors array<long>")


def _window_hashes(words: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the window from each word on: 64 bits, 32 bits of another hash on another hash of the words, and if it is whole."""
    full, whole = gram_hashes(words, doc, length)
    check, _ = gram_hashes(word_hashes(data, starts, ends, 1), doc, length, 2)
    return full, (check >> np.uint64(32)).astype(np.uint32).view(np.int32), whole


def _both(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One key of both hashes of a window."""
    return mixed(h.view(np.uint64)) ^ (c.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(doc_id, h, c) of the windows around the listed anchors of (doc_id, text, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, at in text_slices(b):
                starts, ends, doc = word_spans(data, at)
                words = word_hashes(data, starts, ends)
                grams, valid = gram_hashes(words, doc, anchor)
                chosen = winnowed(grams, valid, length - anchor + 1)
                found = part.column("found")
                known, of = found.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(part.num_rows), np.diff(found.offsets.to_numpy()))
                # an anchor counts in the document that it is listed for
                pairs = np.unique(known + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                key = grams[chosen] + doc[chosen].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                chosen = chosen[np.isin(key, pairs)]
                full, check, whole = _window_hashes(words, data, starts, ends, doc, length)
                near = np.zeros(len(full) + length, bool)
                for o in range(length - anchor + 1):
                    near[np.maximum(chosen - o, 0)] |= chosen >= o
                at_ = np.flatnonzero(near[: len(full)] & whole)
                of = doc[at_]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), _signed(full[at_]), pa.array(check[at_])], names=["doc_id", "h", "c"])

    return map_texts(docs, run, "doc_id long, h long, c int")


ADDED = "kept_text__ string, n_words__ long, repeats__ array<struct<start:int,end:int>>, n_removed__ long"


def _repeats(spans: list[np.ndarray]) -> pa.ListArray:
    """Lists of (start, end) from each document's alternating starts and ends."""
    flat = np.concatenate([*spans, np.zeros(0, np.int64)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[::2]), pa.array(flat[1::2])], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 2 for x in spans)]).astype(np.int32)), pairs)


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """(row struct, kept, n_words, n_removed) from (row, doc_id, text, copy, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, at in text_slices(b):
                n = part.num_rows
                starts, ends, doc = word_spans(data, at)
                hashes = word_hashes(data, starts, ends)
                seq = [x.view(np.int64) for x in sequence_hashes(hashes, doc, n)]
                full, check, whole = _window_hashes(hashes, data, starts, ends, doc, length)
                full = _both(full, check)
                edge = np.searchsorted(doc, np.arange(n + 1))
                kept, spans, words = [], [], np.diff(edge)
                copies, hits, raw = part.column("copies"), part.column("hits"), data.tobytes()
                for i in range(n):
                    s, e = starts[edge[i] : edge[i + 1]], ends[edge[i] : edge[i + 1]]
                    gone = np.zeros(len(s), bool)
                    if copies[i].is_valid and {"whole": seq[0][i], "check": seq[1][i]} in copies[i].as_py():
                        gone[:] = True
                    elif hits[i].is_valid:
                        own = slice(edge[i], max(edge[i], edge[i + 1] - length + 1))
                        listed = _both(*(x.to_numpy() for x in hits[i].values.flatten()))
                        got = np.flatnonzero(np.isin(full[own], listed) & whole[own])
                        step = np.zeros(len(s) + length + 1, np.int64)
                        np.add.at(step, got, 1)
                        np.add.at(step, got + length, -1)
                        gone = np.cumsum(step)[: len(s)] > 0
                    runs = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans.append(runs)
                    kept.append(b" ".join(raw[x:y] for x, y in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names[:-2]), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words), _repeats(spans), pa.array([int((x[1::2] - x[::2]).sum()) for x in spans], pa.int64())],
                    names=[*part.schema.names[:-2], *(x.split()[0] for x in ADDED.split(", "))],
                )

    return map_texts(docs, run, T.StructType([*docs.schema.fields[:-2], *T.StructType.fromDDL(ADDED).fields]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Every row of ``docs`` with its columns, and kept_text__ (kept words, space-joined), n_words__, repeats__ and n_removed__.

    repeats__ lists the maximal repeats that were removed, as (start, end) in words; those that touch or overlap are one.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seed = materialize(seeds(plain.where("doc_id is not null"), length, anchor), "substring-seeds")
    copied = Copies(seed, length)
    occurs = seed.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = occurs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = materialize(shared, "substring-shared")
    found = occurs.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("found"))
    found = materialize(found.join(copied.alone, "doc_id", "left_anti"), "substring-anchors")
    drop(seed)
    windows = materialize(_windows(plain.join(found, "doc_id"), length, anchor), "substring-windows")
    least = windows.groupBy("h", "c").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "c", "lo")
    least = materialize(least, "substring-least")
    hits = windows.join(least, ["h", "c"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_set(F.struct("h", "c")).alias("hits"))
    gone = materialize(hits.join(copied.rows, "doc_id", "full").select("doc_id", "copies", "hits"), "substring-hits")
    drop(windows)
    inner = [c for c in docs.columns if c not in ("doc_id", "text")]
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(inner)], F.lit(0).alias("none")).alias("rest__"))
    cut = _cut(typed.join(gone, "doc_id", "left").select("doc_id", "text", "rest__", "copies", "hits"), length)
    return cut.select(*[c if c in ("doc_id", "text") else F.col(f"rest__.`{inner.index(c)}`").alias(c) for c in docs.columns], "kept_text__", "n_words__", "repeats__", "n_removed__")


class Copies:
    """Whole copies of a smaller doc_id: ``rows`` (doc_id, copies: both sequence hashes), ``alone``: doc_ids all of whose rows are copies."""

    def __init__(self, seed: DataFrame, length: int):
        text = seed.where(F.col("n_words") >= length).select("doc_id", "n_words", "whole", "check")
        first = text.groupBy("whole", "check", "n_words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        first = materialize(first, "substring-firsts")
        copies = text.join(first, ["whole", "check", "n_words"]).where("doc_id > lo")
        self.rows = materialize(copies.groupBy("doc_id").agg(F.collect_set(F.struct("whole", "check")).alias("copies")), "substring-copies")
        one = text.groupBy("doc_id").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a = b").select("doc_id")
        self.alone = self.rows.join(one, "doc_id", "left_semi").select("doc_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = remove_repeats(docs)
    return cut.select("doc_id", F.col("n_words__").alias("n_words"), F.col("n_removed__").alias("n_removed"), F.sha2("kept_text__", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their repeats removed from the text and, where it is there, n_chars brought up to date.

    A text that loses nothing stays as it is, white space included; a row whose text has words but keeps none is dropped.
    """
    names = [c if c in ("doc_id", "text", "n_chars") else str(i) for i, c in enumerate(docs.columns)]
    cut = remove_repeats(docs.toDF(*names)).where("n_words__ = 0 or n_removed__ < n_words__")
    text = F.when(F.col("n_removed__") > 0, F.col("kept_text__")).otherwise(F.col("text"))
    new = cut.withColumn("text", text)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.when(F.col("n_removed__") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return new.select(names).toDF(*docs.columns)


def substring_sql(length: int = LENGTH) -> str:
    return rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - {length} + 2)) as i from w where len(words) >= {length}),
windows as (select doc_id, i, array_to_string(words[i:i + {length} - 1], ' ') as k from starts),
firsts as (select k, min(doc_id) as lo from windows group by k having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + {length})) as pos from windows join firsts using (k) where doc_id > lo),
every as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
kept as (select e.doc_id, count(*) filter (where g.pos is not null) as n_removed, string_agg(e.word, ' ' order by e.pos) filter (where g.pos is null) as text from every e left join gone g using (doc_id, pos) group by e.doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
"""
