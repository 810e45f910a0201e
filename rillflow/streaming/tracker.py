"""The flow tracker on a packet stream: keyed state, closed by FIN or RST, by the cap, and by event-time timers when idle.

State per endpoint pair is the open flow's running sums, so it has the same size however long the flow is. There are two forms.

``track_in_order`` holds rows back, in state, until the watermark has passed their slice of event time, and only then takes them
in, in order: a row that comes late but not behind the watermark joins its flow, and any order of arrival gives the same
flows. Pairs are dealt to buckets that share a state, since calls to the state store, not rows, are what takes time: a
trigger makes a few for each bucket and one or two for each block of held rows, however many pairs there are. A task holds a
bucket's open flows, a million of its rows as they come in, and a block of each million as they are merged.

``track`` takes rows in at once, in order within a trigger, so flows end as soon as their last packet is there. A trigger's rows of
one pair are held in memory: the source's files per trigger bound them. A row that is older than the last one of its open
flow, seen in an earlier trigger, can't be put in its place any more: it joins no flow and is counted, in a row of reason
``LATE`` whose packet_count is the number of such rows of a pair in a trigger. ``flows_of`` and ``late_rows`` tell them apart.

In both forms rows behind the watermark don't reach the tracker; Spark counts those itself (numRowsDroppedByWatermark).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillflow.functions.packets import FLAG_LETTERS
from rillflow.operators.flows import KEY, MAX_PACKETS, TIMEOUT_US, keyed
from rillflow.schema import FEATURES

SUMS = ["first_us", "last_us", "n", "bytes", "nf", "fwd_bytes", "first_f", "last_f", "first_b", "last_b", "header_f", "header_b", "syn", "fin", "rst", "ack", "gaps", "gap_sum", "gap_squares"]
#: The sum of squared gaps may pass 64 bits and is kept as two numbers.
STATE = ", ".join(f"{c} long" for c in [*SUMS, "gap_squares_high"])
LOW = (1 << 62) - 1
#: A row held back: pair, time, place, sizes, direction and flags (a bit for each letter that counts).
HELD = np.dtype([("pair", "<i4"), ("us", "<i8"), ("seq", "<i8"), ("size", "<i4"), ("header", "<i4"), ("fwd", "?"), ("flags", "u1")])
LETTERS = ["".join(c for i, c in enumerate(FLAG_LETTERS) if bits >> i & 1) for bits in range(1 << len(FLAG_LETTERS))]
SLICE_US = 1_000_000
#: Groups of endpoint pairs that share a state, rows of a block held back, and rows that are put into blocks at once.
BUCKETS, BLOCK, HELD_AT_ONCE = 256, 16_384, 1 << 20
LATE = "late"
OUTPUT = "lo_ip string, hi_ip string, lo_port int, hi_port int, proto int, start_us long, end_us long, reason string, " + ", ".join(f"{f} double" for f in FEATURES)


def opened(us: int) -> dict:
    return dict.fromkeys(SUMS, 0) | {"first_us": us, "last_us": us, "first_f": -1, "last_f": -1, "first_b": -1, "last_b": -1}


def add(s: dict, us: int, size: int, header: int, is_fwd: bool, flags: str) -> None:
    """Take one packet into the open flow's sums."""
    if s["n"]:
        gap = us - s["last_us"]
        s["gaps"] += 1
        s["gap_sum"] += gap
        s["gap_squares"] += gap * gap
    s["n"] += 1
    s["last_us"] = us
    s["bytes"] += size
    side = "f" if is_fwd else "b"
    s[f"first_{side}"] = us if s[f"first_{side}"] < 0 else s[f"first_{side}"]
    s[f"last_{side}"] = us
    s[f"header_{side}"] += header
    if is_fwd:
        s["nf"] += 1
        s["fwd_bytes"] += size
    for letter, name in (("S", "syn"), ("F", "fin"), ("R", "rst"), ("A", "ack")):
        s[name] += letter in flags


def features(s: dict) -> list[float]:
    """The twenty features, in order, of a flow's sums."""
    nb, back = s["n"] - s["nf"], s["bytes"] - s["fwd_bytes"]
    mean = lambda n, a, b: (b - a) / ((n - 1) * 1e6) if n > 1 else 0.0
    # whole numbers up to the root
    std = math.sqrt(s["gaps"] * s["gap_squares"] - s["gap_sum"] ** 2) / (s["gaps"] * 1e6) if s["gaps"] else 0.0
    return [
        *(max((s["last_us"] - s["first_us"]) / 1e6, 1e-6), s["n"], s["bytes"], s["nf"], nb, s["fwd_bytes"], back),
        *(s["bytes"] / max(s["n"], 1), s["fwd_bytes"] / max(s["nf"], 1), back / max(nb, 1)),
        *(mean(s["nf"], s["first_f"], s["last_f"]), mean(nb, s["first_b"], s["last_b"]), mean(s["n"], s["first_us"], s["last_us"]), std),
        *(s["header_f"], s["header_b"], s["syn"], s["fin"], s["rst"], s["ack"]),
    ]


def to_state(s: dict) -> tuple:
    return *(s[c] & LOW if c == "gap_squares" else s[c] for c in SUMS), s["gap_squares"] >> 62


def from_state(known: tuple) -> dict:
    s = dict(zip(SUMS, known, strict=False))
    return s | {"gap_squares": (known[len(SUMS)] << 62) + s["gap_squares"]}


def in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["seq"], rows["us"]))]


class Tracker(StatefulProcessor):
    def __init__(self, timeout_us: int, max_packets: int, min_packets: int):
        self.timeout_us, self.max_packets, self.min_packets = timeout_us, max_packets, min_packets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", STATE)

    def _close(self, key: tuple, s: dict, reason: str, out: list) -> None:
        if s["n"] >= self.min_packets:
            out.append([*key, s["first_us"], s["last_us"], reason, *map(float, features(s))])

    def _take(self, key: tuple, s: dict | None, us: int, size: int, header: int, fwd: bool, flags: str, out: list) -> dict | None:
        """The open flow after one packet, the next in order."""
        if s and us - s["last_us"] > self.timeout_us:
            self._close(key, s, "idle", out)
            s = None
        s = s or opened(us)
        add(s, us, size, header, fwd, flags)
        ends = "F" in flags or "R" in flags
        if ends or s["n"] >= self.max_packets:
            self._close(key, s, "fin_rst" if ends else "cap", out)
            return None
        return s

    def _frame(self, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def _due(self, s: dict) -> int:
        # timers fire at whole milliseconds, after the last one at which the flow is still open
        return (s["last_us"] + self.timeout_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts_us", "pkt_seq"])
        batch["flags"] = batch["flags"].fillna("")
        known = self.flow.get() if self.flow.exists() else None
        s = from_state(known) if known else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        out: list = []
        late: list[int] = []
        for us, size, header, fwd, flags in batch[["ts_us", "pkt_len", "header_len", "is_fwd", "flags"]].itertuples(index=False):
            if s and us < s["last_us"]:
                late.append(int(us))
                continue
            s = self._take(key, s, int(us), int(size), int(header), bool(fwd), flags, out)
        if s:
            self.flow.update(to_state(s))
            self.handle.registerTimer(self._due(s))
        else:
            self.flow.clear()
        if late:
            out.append([*key, min(late), max(late), LATE, *(float(len(late)) if f == "packet_count" else 0.0 for f in FEATURES)])
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list = []
        if self.flow.exists():
            self._close(key, from_state(self.flow.get()), "idle", out)
            self.flow.clear()
        yield from self._frame(out)

    def close(self) -> None:
        pass


class OrderedTracker(Tracker):
    """Tracks all pairs of a bucket; a pair is known by its key as JSON text, and within a call by its place in ``keys``.

    Rows wait in ``held``, in blocks that are each in order of time, until the watermark has passed their slice. A block's key
    is its first time, with a number for blocks that begin alike. ``flow`` lists the bucket's open flows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "first_us long, number long", "pairs string, rows binary")
        self.flow = handle.getListState("flow", f"pair string, {STATE}")

    def _begin(self) -> None:
        self.codes: dict[str, int] = {}
        self.keys: list[list] = []

    def _code(self, pair: str) -> int:
        if pair not in self.codes:
            self.codes[pair] = len(self.keys)
            lo_ip, hi_ip, *numbers = json.loads(pair)
            self.keys.append([lo_ip, hi_ip, *(n if n is None else int(n) for n in numbers)])
        return self.codes[pair]

    def _coded(self, pairs: Iterable[str]) -> np.ndarray:
        return np.array([self._code(p) for p in pairs], "<i4")

    def _rows(self, chunk: pd.DataFrame) -> np.ndarray:
        rows = np.zeros(len(chunk), HELD)
        for name, column in (("us", "ts_us"), ("seq", "pkt_seq"), ("size", "pkt_len"), ("header", "header_len"), ("fwd", "is_fwd")):
            rows[name] = chunk[column].to_numpy()
        at, pairs = pd.factorize(chunk["pair"])
        rows["pair"] = self._coded(pairs)[at]
        at, flags = pd.factorize(chunk["flags"].fillna(""))
        rows["flags"] = np.array([sum((c in f) << i for i, c in enumerate(FLAG_LETTERS)) for f in flags], "u1")[at]
        return rows

    def _hold(self, rows: np.ndarray) -> None:
        rows, pairs = in_order(rows), list(self.codes)
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            used, block["pair"] = np.unique(block["pair"], return_inverse=True)
            key = (int(block["us"][0]), 0)
            while self.held.containsKey(key):
                key = (key[0], key[1] + 1)
            self.held.updateValue(key, ("\n".join(pairs[i] for i in used), block.tobytes()))

    def _complete(self, edge: int) -> Iterator[np.ndarray]:
        """The rows held from before ``edge``, in order and in parts: blocks are merged as their times overlap."""
        due = sorted(k for k in map(tuple, self.held.keys()) if k[0] < edge)
        left = np.empty(0, HELD)
        for k, after in zip(due, [*(k[0] for k in due[1:]), edge], strict=False):
            pairs, data = self.held.getValue(k)
            self.held.removeKey(k)
            block = np.frombuffer(bytes(data), HELD).copy()
            block["pair"] = self._coded(pairs.split("\n"))[block["pair"]]
            rows = np.concatenate([left, block])
            now = rows["us"] < after
            left = rows[~now]
            yield in_order(rows[now])
        self._hold(left)

    def _advance(self, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Take in the slices that are complete, close what is idle by then, and set the timer for what comes next."""
        edge = watermark_ms * 1000 // SLICE_US * SLICE_US
        out: list = []
        flows = {self._code(pair): from_state(known) for pair, *known in (self.flow.get() if self.flow.exists() else ())}
        for rows in self._complete(edge):
            for start in range(0, len(rows), BLOCK):
                for pair, us, _, size, header, fwd, bits in rows[start : start + BLOCK].tolist():
                    s = self._take(self.keys[pair], flows.pop(pair, None), us, size, header, fwd, LETTERS[bits], out)
                    if s:
                        flows[pair] = s
                yield from self._frame(out)
                out.clear()
        for pair in [p for p, s in flows.items() if s["last_us"] + self.timeout_us < edge]:
            self._close(self.keys[pair], flows.pop(pair), "idle", out)
        yield from self._frame(out)
        if flows:
            pairs = list(self.codes)
            self.flow.put([(pairs[p], *to_state(s)) for p, s in flows.items()])
        else:
            self.flow.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [k[0] // SLICE_US + 1 for k in self.held.keys()] + [(s["last_us"] + self.timeout_us) // SLICE_US + 1 for s in flows.values()]
        if ends:
            self.handle.registerTimer(min(ends) * SLICE_US // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._begin()
        chunks: list[np.ndarray] = []
        for chunk in rows:
            chunks.append(self._rows(chunk))
            if sum(map(len, chunks)) >= HELD_AT_ONCE:
                self._hold(np.concatenate(chunks))
                chunks = []
        if chunks:
            self._hold(np.concatenate(chunks))
        yield from self._advance(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._begin()
        yield from self._advance(timerValues.getCurrentWatermarkInMs())


PASSED = ["ts", "ts_us", "pkt_seq", "pkt_len", "header_len", "is_fwd", "flags"]


def _keyed(packets: DataFrame) -> DataFrame:
    return keyed(packets.withColumn("ts_us", F.unix_micros("ts")))


def track(packets: DataFrame, timeout_us: int = TIMEOUT_US, max_packets: int = MAX_PACKETS, min_packets: int = 2) -> DataFrame:
    """Closed flows of a packet stream that has a watermark on ts, and counts of late rows. Needs the RocksDB state store."""
    rows, tracker = _keyed(packets).select(*KEY, *PASSED), Tracker(timeout_us, max_packets, min_packets)
    return rows.groupBy(*KEY).transformWithStateInPandas(tracker, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def track_in_order(packets: DataFrame, timeout_us: int = TIMEOUT_US, max_packets: int = MAX_PACKETS, min_packets: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """Closed flows of a packet stream that has a watermark on ts, whatever the order in which rows ahead of it come.

    A checkpoint is bound to its number of ``buckets``.
    """
    bucket, pair = F.pmod(F.xxhash64(*KEY), F.lit(buckets)), F.to_json(F.array(*[F.col(c).cast("string") for c in KEY]))
    rows, tracker = _keyed(packets).select(bucket.alias("bucket"), pair.alias("pair"), *PASSED), OrderedTracker(timeout_us, max_packets, min_packets)
    return rows.groupBy("bucket").transformWithStateInPandas(tracker, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The flows that are open in the state of a stopped tracker's checkpoint: the endpoint pair and the flow's sums."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "flow").load()
    sums = ("first_us", "last_us", "n", "bytes")
    if "list_element" not in state.columns:  # of ``track``
        return state.select(*[F.col(f"key.{c}").alias(c) for c in KEY], *[F.col(f"value.{c}").alias(c) for c in sums])
    pair = F.from_json("list_element.pair", "array<string>")
    types = dict.fromkeys(KEY[:2], "string") | dict.fromkeys(KEY[2:], "int")
    return state.select(*[F.get(pair, F.lit(i)).cast(types[c]).alias(c) for i, c in enumerate(KEY)], *[F.col(f"list_element.{c}").alias(c) for c in sums])


def flows_of(tracked: DataFrame) -> DataFrame:
    return tracked.where(F.col("reason") != LATE)


def late_rows(tracked: DataFrame) -> DataFrame:
    """(endpoint pair, rows) of rows that came too late for their flow; a pair has a row for each trigger that had some."""
    return tracked.where(F.col("reason") == LATE).select(*KEY, F.col("packet_count").cast("long").alias("rows"))
