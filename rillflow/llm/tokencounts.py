"""Token counts of fields or sections by offset-mapped attribution.

Each document is encoded once, whole, so that its tokens are those that a model would see. Token spans in characters come
from the tokens' byte lengths and the text's character starts; they are joined to the sections' character intervals by
binary search over sorted boundaries, for many documents at a time.

Rule for a token that crosses boundaries: it counts for the section that holds most of its characters, and for the earlier
one of equals. A character that several tokens share (parts of its bytes) counts as one character of each. So every token
counts once, and a document's sections add up to its tokens.

Sections are the document's lines, each with the line feed that ends it; ``attribute`` takes any partition of the text
into consecutive parts, given as their lengths in characters.

Defined results: a null or empty text is one empty section without tokens; lengths that fall short of the text leave a last
section for the rest, and what exceeds it is empty; rows are independent, so repeated rows, ties, null ids and empty
tables need nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import map_texts
from rillflow.llm.words import text_slices

RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a rank file, and each token's length in bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(first: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section, crosses) of tokens that hold characters [first, end); section k is [bounds[k], bounds[k + 1])."""
    low = np.searchsorted(bounds, first, "right") - 1
    high = np.searchsorted(bounds, end - 1, "right") - 1
    crosses = low < high
    at = np.flatnonzero(crosses)
    best, most = low[at].copy(), np.zeros(len(at), np.int64)
    for k in range(int((high - low)[at].max(initial=-1)) + 1):
        s = np.minimum(low[at] + k, high[at])
        held = np.minimum(end[at], bounds[s + 1]) - np.maximum(first[at], bounds[s])
        more = (held > most) & (low[at] + k <= high[at])
        best[more], most[more] = s[more], held[more]
    low[at] = best
    return low, crosses


def _line_bounds(data: np.ndarray, chars: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lines of all documents, and each line's document."""
    feeds = np.flatnonzero(data == 10)
    starts = np.setdiff1d(chars[feeds] + 1, edges, assume_unique=False)
    doc = np.searchsorted(edges[1:], starts, "right")
    # every document opens a section, empty ones too
    bounds, of = np.concatenate([edges[:-1], starts]), np.concatenate([np.arange(len(edges) - 1), doc])
    order = np.lexsort((bounds, of))
    return np.append(bounds[order], edges[-1]), of[order]


def attribute(docs: DataFrame, lengths: str | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, section, n_chars, n_tokens, n_crossing) of (doc_id, text): a row per line, or per part of the array ``lengths``."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoder(path, pattern)
        for b in batches:
            for part, data, at in text_slices(b):
                n = part.num_rows
                begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                edges = begins[at]
                ids = [coder.encode_to_numpy(t.as_py() or "", allowed_special=set(), disallowed_special=()) for t in part.column("text")]
                of = np.repeat(np.arange(n), [len(i) for i in ids])
                size = sizes[np.concatenate(ids)] if len(of) else np.zeros(0, np.int64)
                stop = np.cumsum(size)
                first, end = begins[np.minimum(stop - size + 1, len(data))] - 1, begins[stop]
                end = np.maximum(end, first + 1)
                if lengths is None:
                    bounds, owner = _line_bounds(data, begins, edges)
                else:
                    bounds, owner = _given_bounds(part.column(lengths).to_pylist(), edges)
                # searching in one sorted list finds the last of equal bounds, so empty sections get no tokens
                section, crosses = allocate(first, end, bounds)
                counts = np.bincount(section, minlength=len(owner))
                across = np.bincount(section[crosses], minlength=len(owner))
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(np.diff(bounds)), pa.array(counts), pa.array(across)], names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing"]
                )

    columns = ["doc_id", F.col("text").cast("string").alias("text"), *([lengths] if lengths else [])]
    return map_texts(docs.select(*columns), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, section int, n_chars long, n_tokens long, n_crossing long")


def _given_bounds(parts: list[list[int] | None], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds, owner = [], []
    for i, p in enumerate(parts):
        size = int(edges[i + 1] - edges[i])
        cuts = np.minimum(np.cumsum([0, *(max(0, x or 0) for x in p or [])]), size)
        cuts = cuts if cuts[-1] < size else cuts[:-1] if len(cuts) > 1 else cuts
        bounds.append(cuts + edges[i])
        owner += [i] * len(cuts)
    return np.concatenate([*bounds, edges[-1:]]), np.array(owner)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
