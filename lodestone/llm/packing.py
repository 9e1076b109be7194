"""Sequence packing by cutting-stock column generation.

A document's ids are cut into pieces of ``seq_len`` and one remainder. Piece
lengths fall into bins of ``unit`` tokens; their histogram is all that the
optimiser sees (at most ``seq_len / unit`` numbers). A linear program over
patterns (multisets of bins that fit a sequence) is solved by column
generation: a revised simplex holds the basis, a knapsack dynamic program
prices new patterns. Patterns are rounded down and the few pieces left over
are placed best-fit. Bins are then dealt to ranked pieces: every task counts
its own pieces per bin, prefix sums over (task, bin) give global ranks, and a
rank determines sequence and slot. No group of pieces meets in one task but
the pieces of one sequence.

Defined results: null text is empty (one end id); repeated rows, and rows with
a null doc_id, are packed as often as they occur; pieces of equal length are
dealt in the order of task and place; a text of any length is cut whole; only
doc_id and text are read, so other columns may have any name; an empty table
gives no pieces. If column generation ends early (``max_steps``), it warns;
the sequences are still valid.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textbuf import text_slices
from lodestone.llm.tokens import encoder
from lodestone.session import load, materialize

SEQ_LEN = 1024
UNIT = 8
SLICE = 4 << 20


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and item counts of an unbounded knapsack; item ``i`` has weight ``i + 1``."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        value = best[c - 1 :: -1][: len(prices)] + prices[:c]
        i = int(value.argmax())
        best[c], pick[c] = best[c - 1], -1
        if value[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = value[i], i
    counts, c = np.zeros(len(prices), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= pick[c] + 1
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, max_steps: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Optimal fractional patterns (rows) and their multiplicities for item weights 1 to ``len(demand)`` = capacity."""
    capacity = len(demand)
    used = np.flatnonzero(demand)
    m = len(used)
    patterns = np.zeros((m, capacity), np.int64)
    patterns[np.arange(m), used] = capacity // (used + 1)
    inverse = np.diag(1.0 / (capacity // (used + 1)))
    x = inverse @ demand[used]
    for _ in range(max_steps):
        duals = np.zeros(capacity)
        duals[used] = inverse.sum(0)
        value, pattern = knapsack(np.where(demand > 0, duals, -1.0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ pattern[used]
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * direction
        x[out] = step
        x = np.maximum(x, 0)
        patterns[out] = pattern
        inverse[out] /= direction[out]
        rest = np.arange(m) != out
        inverse[rest] -= np.outer(direction[rest], inverse[out])
    else:
        warnings.warn(f"column generation stopped after {max_steps} steps; its patterns are valid but may pack less tightly", stacklevel=2)
    return patterns, x


@dataclass
class Plan:
    """Per bin: first rank, first sequence, pieces per sequence and first slot of each run of sequences."""

    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    sequences: int = 0

    def add(self, pattern: np.ndarray, times: int, cursor: np.ndarray) -> None:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            self.runs.setdefault(int(i), []).append((int(cursor[i]), self.sequences, int(pattern[i]), slot))
            cursor[i] += times * pattern[i]
            slot += int(pattern[i])
        self.sequences += times

    def place(self, bins: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, slot = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
        for b in np.unique(bins):
            table = np.array(self.runs[int(b)], np.int64)
            at = bins == b
            row = table[np.searchsorted(table[:, 0], ranks[at], "right") - 1]
            inside = ranks[at] - row[:, 0]
            seq[at], slot[at] = row[:, 1] + inside // row[:, 2], row[:, 3] + inside % row[:, 2]
        return seq, slot


def best_fit(rest: np.ndarray) -> list[np.ndarray]:
    """Patterns for the pieces that rounding leaves, largest first into the fullest sequence that takes it."""
    capacity, out, room = len(rest), [], []
    for i in range(capacity - 1, -1, -1):
        for _ in range(int(rest[i])):
            fits = [k for k, r in enumerate(room) if r >= i + 1]
            if fits:
                k = min(fits, key=room.__getitem__)
            else:
                k = len(out)
                out.append(np.zeros(capacity, np.int64))
                room.append(capacity)
            out[k][i] += 1
            room[k] -= i + 1
    return out


def make_plan(histogram: np.ndarray) -> Plan:
    """From the number of pieces per bin to the place of every rank."""
    plan, cursor = Plan(), np.zeros(len(histogram), np.int64)
    if not histogram.sum():
        return plan
    patterns, times = column_generation(histogram.astype(float))
    rest = histogram.astype(np.int64).copy()
    for pattern, x in sorted(zip(patterns, np.floor(times + 1e-9).astype(int), strict=True), key=lambda p: -p[1]):
        x = min(x, min((rest[i] // pattern[i] for i in np.flatnonzero(pattern)), default=0))
        if x > 0:
            plan.add(pattern, int(x), cursor)
            rest -= x * pattern
    for pattern in best_fit(rest):
        plan.add(pattern, 1, cursor)
    return plan


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bin", pa.int32()), ("shard", pa.int64()), ("rank", pa.int64())])


def _cutter(end_id: int, seq_len: int, unit: int, vocab: str | None):
    def run(batches):
        from pyspark import TaskContext

        shard, counts, enc = TaskContext.get().partitionId(), np.zeros(seq_len // unit, np.int64), encoder(vocab)
        for s in text_slices(batches, max_bytes=SLICE):
            ids, row = enc.encode(s)
            wide = np.insert(ids, row[1:], end_id).astype("<u4")
            total = np.diff(row) + 1
            first = np.append(0, np.cumsum(total))[:-1]
            n = -(-total // seq_len)
            doc = np.repeat(np.arange(s.n), n)
            start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * seq_len
            length = np.minimum(seq_len, total[doc] - start)
            at = first[doc] + start
            crc = np.fromiter((zlib.crc32(wide[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
            bins = (length - 1) // unit
            rank = np.zeros(len(bins), np.int64)
            order = np.argsort(bins, kind="stable")
            here = np.bincount(bins, minlength=len(counts))
            rank[order] = np.arange(len(bins)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(counts, here)
            counts += here
            yield pa.record_batch([s.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(total[doc]), pa.array(bins.astype(np.int32)), pa.array(np.full(len(bins), shard)), pa.array(rank)], schema=_PIECES)

    return run


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, end_id: int = 0, unit: int = UNIT, vocab: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, shard long, rank long"
    pieces = materialize(own.mapInArrow(_cutter(end_id, seq_len, unit, vocab), schema), "packing-pieces")
    by_task = pieces.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bin").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = np.zeros(seq_len // unit, np.int64)
    for b, n in by_task.groupBy("bin").agg(F.sum("n")).collect():  # one row a bin
        histogram[b] = n
    plan = make_plan(histogram)
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            seq, slot = plan.place(col["bin"].to_numpy(), col["rank"].to_numpy())
            yield pa.record_batch([*(col[k] for k in keep), pa.array(seq), pa.array(slot)], names=[*keep, "sequence_id", "slot"])

    ranked = pieces.join(first, ["shard", "bin"]).select(*keep, "bin", (F.col("rank") + F.col("first")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*keep, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def packed_tokens(docs: DataFrame, pieces: DataFrame, seq_len: int = SEQ_LEN, end_id: int = 0, pad_id: int = 0, vocab: str | None = None) -> DataFrame:
    """The sequences themselves (documents need distinct doc_ids): sequence_id, input_ids array, n_tokens."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches):
        for s in text_slices(batches, max_bytes=SLICE):
            ids, row = encoder(vocab).encode(s)
            lists = [np.append(ids[row[i] : row[i + 1]], end_id) for i in range(s.n)]
            yield pa.record_batch([s.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    ids = own.mapInArrow(encode, "doc_id long, ids array<int>")
    cut = ids.join(pieces, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("part"))
    rows = cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids"))
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(seq_len) - F.size("ids"))).alias("input_ids"), F.size("ids").alias("n_tokens"))


def op5_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
