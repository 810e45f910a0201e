"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file names each token's bytes. The library's model wants merges: every split of a token into two tokens is one,
in the order of the ranks, so that its merging picks what lowest-rank-first merging picks. Texts are cut by the given
pattern; each distinct piece is mapped to the byte alphabet and encoded once by the library, and a worker remembers the
ids of pieces that it has seen, as packed integers, in two generations of at most ``MEMORY`` pieces: when the younger one is
full the older one goes, and pieces met again move to the younger one (this bounds memory, it drops no work).
Byte offsets are the running sum of token lengths; a character's offset counts the bytes that start one. Decoding reverses
the byte table: the bytes of all ids are gathered from one array of token bytes, so that a character that several tokens
share is whole again.

The pattern is compiled with its classes of letters, numbers and blanks spelt out for the basic plane, as Unicode 16.0 has
them: the encoder that the ids must equal takes later letters for other signs (a test holds every code point against it).
Characters beyond that plane are looked up one by one and stand-ins of their class cut.

Defined results: a null text is empty and has no ids; null ids decode to null; bytes of ids that aren't UTF-8 stay as they
are; lone surrogates can't reach a Spark string; a text of any length is one task's work, and takes memory in proportion
to its own length; rows are never joined or moved, so ties, repeats, empty tables and further columns keep their form, and
columns whose names clash with added ones stay beside them.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import map_texts, numbered

MEMORY = 120_000
LONG_PIECE = 64
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The letters and numbers (first, last) of Unicode 16.0 that Unicode 15.1 doesn't have.
NEWER = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def assigned(c: str) -> bool:
    """Whether Unicode 16.0 knows the character as far as its class matters here."""
    return unicodedata.category(c) != "Cn" or any(a <= ord(c) <= b for a, b in NEWER)


class Cutter:
    """Matches of a pattern of the classes of letters, numbers and blanks, which the standard library has no names for."""

    def __init__(self, pattern: str):
        plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        letters, numbers, blanks = (self._ranges(regex.findall(c, plane)) for c in (r"\p{L}", r"\p{N}", r"\s"))
        spelt = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\s", blanks).replace(r"\p{L}", letters).replace(r"\p{N}", numbers), pattern)
        for name, inside in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{blanks}]"), (r"\S", f"[^{blanks}]")):
            spelt = spelt.replace(name, inside)
        self.compiled = re.compile(spelt)

    @staticmethod
    @lru_cache(maxsize=1 << 14)
    def standin(c: str) -> str:
        """A letter, a number or another sign of the basic plane for a character beyond it."""
        return "\ue000" if not assigned(c) else "\u4e00" if regex.match(r"\p{L}", c) else "\u0661" if regex.match(r"\p{N}", c) else "\ue000"

    @staticmethod
    def _ranges(found: list[str]) -> str:
        codes = np.array([ord(c) for c in found if assigned(c)])
        edge = np.flatnonzero(np.diff(codes) > 1)
        firsts, lasts = codes[np.concatenate([[0], edge + 1])], codes[np.concatenate([edge, [-1]])]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not _BEYOND.search(text):
            return self.compiled.findall(text)
        shown = _BEYOND.sub(lambda m: self.standin(m[0]), text)
        return [text[m.start() : m.end()] for m in self.compiled.finditer(shown)]


def gather(table: np.ndarray, edges: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entries ``at`` of a table of bytes, one behind the other; entry i lies between edges i and i + 1."""
    sizes = np.diff(edges)[at]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(edges[at] - ends + sizes, sizes) + np.arange(total)]


def _packed(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(entries), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in entries])])


class ByteBPE:
    """Encoder and decoder for one rank file; made once in each worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import models

        ranks = read_ranks(path)
        bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            bytes_of[rank] = token
        self.bytes_table, self.edges = _packed(bytes_of)
        self.digits = _packed([b"%d," % i for i in range(len(bytes_of))])
        letters = byte_alphabet()
        self.table = dict(enumerate(letters))
        shown = {t: t.decode("latin-1").translate(self.table) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(shown[a], shown[b]) for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
        # pieces are distinct and remembered here, so the library's own cache would only cost memory
        self.model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0)
        self.find = Cutter(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pattern's matches in each text; after this every one of them is in ``known``."""
        found = [self.find(t) for t in texts]
        if len(self.known) > MEMORY:
            self.older, self.known = {p: i for p, i in self.known.items() if len(p) <= LONG_PIECE}, {}
        todo = []
        for p in set(chain.from_iterable(found)).difference(self.known):
            ids = self.older.get(p)
            if ids is None:
                todo.append(p)
            else:
                self.known[p] = ids
        tokens = self.model.tokenize
        for p in todo:
            self.known[p] = array("i", [t.id for t in tokens(p.encode().decode("latin-1").translate(self.table))]).tobytes()
        return found

    def encode_packed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's begin (and the last one's end)."""
        parts = [b"".join(map(self.known.__getitem__, f)) for f in self.pieces(texts)]
        return np.frombuffer(b"".join(parts), np.int32), np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, at = self.encode_packed(texts)
        return [ids[s:e].tolist() for s, e in zip(at, at[1:], strict=False)]

    def byte_offsets(self, ids: list[int]) -> np.ndarray:
        """The first byte of each token, and the end."""
        return np.concatenate([[0], np.cumsum(np.diff(self.edges)[np.asarray(ids, np.int64)])])

    def char_offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) characters of each token; tokens that share a character both hold it."""
        data = np.frombuffer(text.encode(), np.uint8)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = self.byte_offsets(ids)
        # a byte inside a character belongs to the character that began before it
        return np.maximum(begins[np.minimum(at[:-1] + 1, len(data))] - 1, 0), begins[at[1:]]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return gather(self.bytes_table, self.edges, np.asarray(ids, np.int64)).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return gather(*self.digits, ids).tobytes()[:-1]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def batch_texts(column: pa.Array, limit: int = 1 << 19) -> Iterator[list[str]]:
    """The texts of an Arrow column, nulls as empty, in lists of about ``limit`` characters."""
    rows, size = [], 0
    for x in pc.fill_null(column, ""):
        rows.append(x.as_py())
        size += len(rows[-1])
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


#: What ``transcode`` can add, and its type.
OUTPUTS = {"ids__": "array<int>", "starts__": "array<int>", "ends__": "array<int>", "decoded__": "binary", "n_tokens__": "long", "ids_sha256__": "string", "decoded_sha256__": "string"}


def transcode(docs: DataFrame, outputs: list[str], column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with any of ``OUTPUTS``, made in one pass: each text is encoded, and its ids decoded where that is asked for.

    The digests are those of the decimal ids joined by commas, and of the decoded bytes.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    at = docs.columns.index(column)

    def added(bpe: ByteBPE, texts: list[str]) -> list[pa.Array]:
        ids, edge = bpe.encode_packed(texts)
        each = [ids[s:e] for s, e in zip(edge, edge[1:], strict=False)]
        lists = lambda flat: pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat.astype(np.int32)))
        made: dict[str, pa.Array] = {"ids__": lists(ids), "n_tokens__": pa.array(np.diff(edge))}
        if {"starts__", "ends__"} & {*outputs}:
            spans = [bpe.char_offsets(t, i) for t, i in zip(texts, each, strict=True)]
            made |= {name: lists(np.concatenate([s[k] for s in spans])) for k, name in enumerate(("starts__", "ends__"))}
        if {"decoded__", "decoded_sha256__"} & {*outputs}:
            decoded = [bpe.decode(i) for i in each]
            made |= {"decoded__": pa.array(decoded, pa.binary()), "decoded_sha256__": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())}
        if "ids_sha256__" in outputs:
            made["ids_sha256__"] = pa.array([hashlib.sha256(bpe.decimal(i)).hexdigest() for i in each], pa.string())
        return [made[o] for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            done = 0
            for texts in batch_texts(b.column(at)):
                columns = [*b.slice(done, len(texts)).columns, *added(bpe, texts)]
                yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
                done += len(texts)

    coded = map_texts(*_with_run(docs, run, ", ".join(f"`{len(docs.columns) + i}` {OUTPUTS[o]}" for i, o in enumerate(outputs))))
    return coded.toDF(*docs.columns, *outputs)


def _with_run(df: DataFrame, run: Callable, added: str) -> tuple:
    plain, schema = numbered(df, added)
    return plain, run, schema


def encode(docs: DataFrame, column: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """``docs`` with ids__ array<int> and, if asked for, starts__ and ends__ (character offsets of each token)."""
    return transcode(docs, ["ids__", "starts__", "ends__"] if offsets else ["ids__"], column, path, pattern)


def decode(coded: DataFrame, column: str = "ids__", path: str | None = None) -> DataFrame:
    """``coded`` with decoded__ binary, the bytes of its ids; null ids give null."""
    path = path or public_tokenizers.path(RANKS)
    at = coded.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, public_tokenizers.PATTERN)
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                out = [None if not i.is_valid else bpe.decode(i.values.to_numpy()) for i in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[str(i) for i in range(b.num_columns + 1)])

    done = map_texts(*_with_run(coded, run, f"`{len(coded.columns)}` binary"))
    return done.toDF(*coded.columns, "decoded__")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the text encoded, the ids decoded, both as digests."""
    names = ["n_tokens__", "ids_sha256__", "decoded_sha256__"]
    return transcode(docs, names).select("doc_id", *(F.col(n).alias(n.removesuffix("__")) for n in names))
