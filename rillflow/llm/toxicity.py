"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Kernel: two spans are alike by their common ordered triples of characters, each weighted by ``DECAY`` for every step that
it stretches over; up to ``REACH - 1`` characters may be left out at each step, so gaps and inserted characters lower the
weight and don't break the match. A span is a word with its bounding blanks; a run of single letters ("i d i o t") is one
span. Marks don't count, so "i.d.i.o.t" is the same span again. The kernel is divided by a span's own weight.

Model: landmarks are the words that the labelled sample's toxic and clean documents tell apart, and the clean words that a
first model takes for toxic. A span's vector holds its kernel values to the landmarks, whitened by the landmarks' own
kernel matrix (Nyström). The support vector machine is trained on labelled sentences: texts are cut at line ends and at
marks before a blank, and a sentence stands for itself by its span that is most toxic by the model so far. A document's
label says that some sentence of it is toxic, or that none is: of a toxic document the worst sentence is learnt from, and
those further ones of its worst few that the machine takes for toxic by then; of a clean one its worst few. Words that are
certain by their counts are further toxic rows, once each and with a letter put in at each place. This is repeated
``ROUNDS`` times. Since the vector is linear in the triples' weights, the trained model folds into one table of a weight
per triple, and scoring a text is a lookup for each triple of its characters: whole texts, in numpy, with no loop over
words. A document's value is that of its worst span, turned into a probability by a logistic fit on the training documents.

Bounds: at most ``SAMPLE`` toxic and ``SAMPLE`` clean labelled rows are learnt from, chosen by crc32 order. The first
landmarks are the ``LANDMARKS // 2`` toxic words of greatest excess and the ``LANDMARKS // 4`` commonest clean ones, of 3
to 24 letters (``WORD_LETTERS``); those added later are clean spans, at most ``LANDMARKS // 4`` in each of two rounds.
Toxic words beyond these count only by the triples that they share with landmarks. Spans learnt from are cut to
``SPAN_CHARS`` characters, and of a document at most its ``WORST`` worst sentences are learnt from in a round. Scoring has
no bound: every triple of every whole text counts. Only text is scored.

Defined results: null and empty texts have no span and get the score of the logistic fit's floor; without labels of both
kinds every score is the share of toxic labels (0 if none); rows without doc_id are scored and are not held out; repeated
labels count once (the greatest); repeated rows and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import map_texts, materialize, numbered

DECAY = 0.6
REACH = 3
SAMPLE = 6000
LANDMARKS = 160
ROUNDS = 3
WORST = 4
FLOOR = -3.0
CERTAIN = 5.0
#: Bounds of what is learnt from, never of what is scored: characters of a span, and letters of a first landmark.
SPAN_CHARS = 64
WORD_LETTERS = (3, 24)
#: Marks that end a sentence before a blank.
ENDS = ".!?;:\u2026\u3002\uff01\uff1f"
_SIZE, _BLANK = 64, 63
_SLICE = 1 << 18


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point of the basic plane: letters by lower case, 0 for marks, 63 for blanks."""
    table = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isspace():
            table[cp] = _BLANK
        elif c.isalnum():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 36
    return table


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of texts that are set apart by two blanks, and where each text begins."""
    points = np.frombuffer("".join(f"  {t}" for t in texts).encode("utf-32-le", "replace") + "  ".encode("utf-32-le"), np.uint32)
    found = _classes()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        found = np.where(high, (27 + points % 36).astype(np.uint8), found)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    return found, starts


def _spans(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``c`` without marks and without the blanks between single letters, the running count of its blanks, and its places."""
    blank = c == _BLANK
    alone = np.zeros(len(c), bool)
    alone[1:-1] = ~blank[1:-1] & blank[:-2] & blank[2:] & (c[1:-1] > 0)
    gap = np.zeros(len(c), bool)
    gap[1:-1] = blank[1:-1] & alone[:-2] & alone[2:]
    at = np.flatnonzero((c > 0) & ~gap)
    c = c[at]
    return c, np.cumsum(c == _BLANK, dtype=np.int32), at


def _triples(c: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(first positions, triple codes, weight) of all triples that lie in one span, by their two steps."""
    wide = c.astype(np.int32)
    n = len(c)
    for d in range(1, REACH + 1):
        for e in range(1, REACH + 1):
            m = n - d - e
            if m <= 0:
                continue
            a, b, k = wide[:m], wide[d : d + m], wide[d + e :]
            # no blank strictly inside: the ends may be the span's bounding blanks
            ok = (b != _BLANK) & (upto[d + e - 1 : n - 1] == upto[:m])
            at = np.flatnonzero(ok)
            yield at, (a[at] << 12) | (b[at] << 6) | k[at], DECAY ** (d + e)


def span_values(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end, text) of every span with a triple. ``weights`` is the table of triple weights."""
    c, starts = classes(texts)
    c, upto, place = _spans(c)
    got, own = np.zeros(len(c), np.float32), np.zeros(len(c), np.float32)
    for at, code, w in _triples(c, upto):
        got[at] += weights[code] * np.float32(w)
        own[at] += np.float32(w * w)
    # a span runs from one blank to before the next: the blank's own triples open it
    opens = np.flatnonzero(c == _BLANK)
    value, weight = np.add.reduceat(got, opens), np.add.reduceat(own, opens)
    full = weight > 0
    first, last = place[opens[full]], place[np.append(opens[1:], len(c) - 1)[full]]
    return value[full] / np.sqrt(weight[full]), first + 1, last, np.searchsorted(starts, first, "right") - 1


def sentence_ends(texts: list[str]) -> np.ndarray:
    """Where sentences end in the joined texts of ``classes``: at line ends, and at marks of ``ENDS`` before a blank."""
    points = np.frombuffer("".join(f"  {t}" for t in texts).encode("utf-32-le", "replace") + "  ".encode("utf-32-le"), np.uint32)
    blank = _classes()[np.minimum(points, 0xFFFF)] == _BLANK
    mark = np.isin(points[:-1], np.frombuffer(ENDS.encode("utf-32-le"), np.uint32))
    return np.flatnonzero((mark & blank[1:]) | (points[:-1] == 10))


def worst_spans(texts: list[str], weights: np.ndarray, n: int, by_sentence: bool = False) -> list[list[tuple[str, float]]]:
    """The ``n`` distinct spans of highest value of each text, highest first; with ``by_sentence`` only the highest of each sentence.

    A span that runs over a sentence's end belongs to the sentence that it begins in.
    """
    value, first, last, of = span_values(texts, weights)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    order = np.lexsort((first, -value, of))
    if by_sentence and len(order):
        # texts are set apart by blanks, so that a sentence ends no later than its text does if the text's number counts too
        sentence = np.searchsorted(sentence_ends(texts), first) + of
        order = order[np.argsort(sentence[order], kind="stable")]
        order = order[np.concatenate([[True], np.diff(sentence[order]) != 0])]
        order = order[np.lexsort((first[order], -value[order], of[order]))]
    edge = np.searchsorted(of[order], np.arange(len(texts) + 1))
    out = []
    for t, text in enumerate(texts):
        mine: dict[str, float] = {}
        for i in order[edge[t] : edge[t + 1]]:
            at = starts[t] + 2
            mine.setdefault(text[first[i] - at : last[i] - at].lower()[:SPAN_CHARS], float(value[i]))
            if len(mine) == n:
                break
        out.append(list(mine.items()))
    return out


def highest(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Each text's highest span value, ``FLOOR`` where there is no span."""
    out = np.full(len(texts), FLOOR)
    value, _, _, of = span_values(texts, weights)
    if len(value):
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[edge]] = np.maximum.reduceat(value, edge)
    return np.maximum(out, FLOOR)


def slices(column: pa.Array, limit: int = _SLICE) -> Iterator[list[str]]:
    rows, size = [], 0
    for x in pc.fill_null(column, ""):
        rows.append(x.as_py())
        size += len(rows[-1])
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _sparse(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of the words' triples, divided by each word's own weight."""
    c, starts = classes(words)
    c, upto, place = _spans(c)
    parts = [(np.searchsorted(starts, place[at], "right") - 1, code, np.full(len(at), w)) for at, code, w in _triples(c, upto)]
    word, code, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    own = np.bincount(word, weight * weight, len(words))
    return word, code, weight / np.sqrt(own[word])


class Landmarks:
    """Nyström map of a list of words."""

    def __init__(self, words: list[str]):
        word, code, weight = _sparse(words)
        self.codes, at = np.unique(code, return_inverse=True)
        self.features = np.zeros((len(words), len(self.codes)))
        np.add.at(self.features, (word, at), weight)
        values, vectors = np.linalg.eigh(self.features @ self.features.T + 1e-6 * np.eye(len(words)))
        self.whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T

    def vectors(self, words: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(words), 400):
            word, code, weight = _sparse(words[i : i + 400])
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[at] == code
            x = np.zeros((len(words[i : i + 400]), len(self.codes)))
            np.add.at(x, (word[known], at[known]), weight[known])
            out.append(x @ self.features.T @ self.whiten)
        return np.concatenate(out)

    def table(self, w: np.ndarray) -> np.ndarray:
        """The triple weights whose sum over a span is w times the span's vector."""
        out = np.zeros(_SIZE**3, np.float32)
        out[self.codes] = self.features.T @ (self.whiten @ w)
        return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 2.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both classes weighing the same, by Newton steps over its active rows."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    s = np.where(y > 0, 1.0, -1.0)
    c = cost * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y <= 0).sum()))
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(steps):
        active = s * (x @ w) < 1
        xa, ca = x[active], c[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), xa.T @ (ca * s[active]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the probability of y = 1 given f, lightly held to zero; the slope is never negative."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        r, v = p - y, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * f).sum() + 1e-3 * a, r.sum() + 1e-3 * b])
        h = np.array([[(v * f * f).sum() + 1e-3, (v * f).sum()], [(v * f).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def with_insertions(word: str) -> list[str]:
    """The word with one letter put in, at each place."""
    return [word[:i] + "xeo"[i % 3] + word[i:] for i in range(1, len(word))]


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic) of at most ``size`` labelled rows of either kind that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    picks = None
    for kind in (1, 0):
        few = known.where(F.col("toxic") == kind).orderBy(F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), "doc_id").limit(size)
        picks = few if picks is None else picks.unionByName(few)
    # at most 2 * size rows of two numbers
    return materialize(docs.join(F.broadcast(picks), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").cast("int").alias("toxic")), "toxicity-sample")


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _scored(sample: DataFrame, weights: np.ndarray, n: int) -> list:
    """(toxic, spans, values) of each sample row, with the worst spans of its ``n`` worst sentences."""
    shipped = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in slices(b.column("text")):
                got = worst_spans(texts, shipped.value, n, by_sentence=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("toxic").slice(done, len(texts)), pa.array([[s for s, _ in g] for g in got], pa.list_(pa.string())), pa.array([[v for _, v in g] for g in got], pa.list_(pa.float64()))], names=["toxic", "spans", "values"]
                )
                done += len(texts)

    return map_texts(sample, run, "toxic int, spans array<string>, values array<double>").collect()


class Model:
    """A fitted model: the triple table, the machine's offset, and the logistic fit."""

    def __init__(self, table: np.ndarray, offset: float, slope: float, shift: float):
        self.table, self.offset, self.slope, self.shift = table, offset, slope, shift

    def scores(self, texts: list[str]) -> np.ndarray:
        f = np.maximum(highest(texts, self.table) + self.offset, FLOOR)
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    sample = _sample(docs, labels, sample_rows)
    by_kind = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = by_kind.get(1, 0), by_kind.get(0, 0)
    if not n1 or not n0:
        p = np.clip(n1 / max(1, n0 + n1), 1e-9, 1 - 1e-9)
        return Model(np.zeros(_SIZE**3, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    seen = sample.select("toxic", word.alias("word")).where(F.length("word").between(*WORD_LETTERS)).groupBy("word")
    seen = seen.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    # how many standard errors a word's toxic documents exceed their share by
    share = n1 / (n0 + n1)
    excess = (F.col("a") - share * (F.col("a") + F.col("b"))) / F.sqrt(share * (F.col("a") + F.col("b")) + 1)
    bad = [(r["word"], r["z"]) for r in seen.withColumn("z", excess).where("a > 1 and z > 2").orderBy(F.col("z").desc(), "word").limit(landmarks // 2).collect()]
    good = [r["word"] for r in seen.orderBy(F.col("b").desc(), "word").limit(landmarks // 4).collect()]
    words = list(dict.fromkeys([w for w, _ in bad] + good))
    table, offset, rows = np.zeros(_SIZE**3, np.float32), 0.0, []
    if bad:
        first = Landmarks([w for w, _ in bad])
        z = np.array([z for _, z in bad]) ** 2
        table[first.codes] = first.features.T @ (z / z.sum())
    negative: dict[str, None] = dict.fromkeys(good)
    for k in range(rounds):
        rows = _scored(sample, table, WORST)
        clean = [s for r in rows if not r["toxic"] for s in r["spans"]]
        negative |= dict.fromkeys(clean)
        if k < 2:
            worst = sorted(((v, s) for r in rows if not r["toxic"] for s, v in zip(r["spans"], r["values"], strict=True)), reverse=True)
            words = list(dict.fromkeys([*words, *dict.fromkeys(s for _, s in worst[: 8 * landmarks])]))[: len(words) + landmarks // 4]
        mark = Landmarks(words)
        # of a toxic document its worst sentence, and every further one that the machine so far takes for toxic
        toxic = [(s, v, i) for r in rows if r["toxic"] for i, (s, v) in enumerate(zip(r["spans"], r["values"], strict=True))]
        positive = [s for s, v, i in toxic if i == 0 or (k and v + offset > 0)]
        known_clean = set(negative)
        positive = [s for s in positive if s not in known_clean] or positive
        # words that toxic sentences hold far beyond chance count once more, and with a letter put in
        certain = [w for w, z in bad if z > CERTAIN and w not in known_clean]
        positive += certain + [v for w in certain for v in with_insertions(w)]
        x = [*positive, *negative]
        y = np.array([1] * len(positive) + [0] * len(negative))
        unique, back, count = np.unique(np.array(x, object), return_inverse=True, return_counts=True)
        vectors = mark.vectors(list(unique))[back]
        w, offset = train_svm(vectors, y)
        table = mark.table(w)
    rows = _scored(sample, table, 1)
    f = np.array([max(FLOOR, (r["values"][0] if r["values"] else FLOOR) + offset) for r in rows])
    return Model(table, offset, *logistic(f, np.array([r["toxic"] for r in rows], float)))


def score(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with score__, from the column of texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in slices(b.column(at)):
                yield pa.RecordBatch.from_arrays([*b.slice(done, len(texts)).columns, pa.array(shipped.value.scores(texts))], names=[str(i) for i in range(b.num_columns + 1)])
                done += len(texts)

    plain, schema = numbered(docs, f"`{len(docs.columns)}` double")
    done = map_texts(plain, run, schema)
    return done.toDF(*docs.columns, "score__")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("score__").alias("score"), (F.col("score__") >= 0.5).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model doesn't take for toxic."""
    scored = score(numbered(docs)[0], fit(docs, labels), str(docs.columns.index("text")))
    return scored.where("score__ < 0.5").drop("score__").toDF(*docs.columns)
