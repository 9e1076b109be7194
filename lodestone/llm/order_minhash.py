"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its lower-cased words. Its k-mers are ``K``
words long and carry their occurrence number, so a repeated k-mer counts as
often as it occurs. Each of ``SKETCHES`` sketches takes the ``L`` k-mers of
smallest hash and keeps them in text order; two documents share a sketch with
a probability that follows their edit similarity, not only their set overlap.
A text of up to ``BRIEF`` words has few ``K``-mers, so it (also) has
``BRIEF_SKETCHES`` sketches over ``BRIEF_K``-mers; texts from
``SIMILARITY * BRIEF`` words on have the sketches over ``K``-mers. Any two
texts that can be similar enough therefore have one kind in common.

Candidates are documents that share a sketch. Pairs below ``SHORT`` words
can differ in one word at most; they are candidates if their words are equal
once one word is left out on either side, which loses none. Two candidates are linked if the
edit similarity of their words (1 - edit distance / longer length) is at
least ``SIMILARITY``; the distance is computed by dynamic programming in a
diagonal band that doubles until the result is certain.

Scale. Equal texts are one class before sketching. A shared sketch, or a
short text without one word, is a bucket. Entries are put in ranges of (bucket,
document), so a large bucket is split over tasks. Every member is first aligned with the bucket's smallest document
(a star, not all pairs). Only buckets whose members then lie in different
components are looked at again, by bands of length (documents of other than
neighbouring bands cannot be similar enough) and in blocks of bounded rows and
words: first by two lower bounds of the distance (lengths and word histograms)
that lose no link and need no texts. Each document that has partners left is
aligned with the few of least bound; in blocks that still hold several
components all other pairs that pass are aligned, best first, unless earlier
links have joined their components. So no
pair that shares a bucket and is similar enough stays unconnected, and a bucket
of any size is split into blocks of bounded size.

Defined results: null text is empty; empty texts (no words) form classes by
equal text only; documents with fewer words than a k-mer are one k-mer; rows with
equal doc_id and text are one document; two texts under one doc_id share its
class; a null doc_id has class null; ties go to the smaller doc_id; texts of any
length are taken whole; only the columns doc_id and text are read, so others may
have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components, joined_components, one_round
from lodestone.llm.textbuf import ALNUM, TextSlice, mix64, runs, span_hashes, text_slices
from lodestone.session import load, materialize

K, L, SKETCHES, SIMILARITY = 3, 2, 24, 0.8
BRIEF, BRIEF_K, BRIEF_SKETCHES = 100, 2, 24
SHORT = 10  # pairs of fewer words are found exactly
HISTOGRAM = 256
#: Copies of a hub's words; rows and words of a part of a bucket.
HUB_ROWS, PART_ROWS, PART_WORDS = 256, 1024, 1 << 20
ALIGN_PAIRS, ALIGN_BYTES = 4096, 32 << 20
LONG = 512  # words from which runs of words are compared before an alignment
NEAREST = 4  # partners of least bound that are aligned before the rest
CELLS = 1 << 22  # of the arrays that align a group of pairs
BROADCAST_IDS = 1_000_000
SKETCH_SLICE = 1 << 20
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a lower-cased slice and the word offsets of its rows."""
    starts, ends, row_at = runs(ALNUM[s.data], s.offs)
    return span_hashes(s.data, starts, ends), row_at


def kmers(words: np.ndarray, row_at: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes in text order and their row offsets; a short row is one k-mer."""
    size = np.diff(row_at)
    count = np.where(size > 0, np.maximum(size - k + 1, 1), 0)
    at = np.append(0, np.cumsum(count))
    first = np.repeat(row_at[:-1] - at[:-1], count) + np.arange(at[-1])
    left = np.repeat(row_at[1:], count) - first
    padded = np.append(words, np.zeros(k, np.uint64))
    h = np.zeros(at[-1], np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(0x100000001B3) + np.where(left > j, padded[first + j], np.uint64(0)))
    row = np.repeat(np.arange(len(size)), count)
    key = h ^ mix64(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    if same.any():
        block = np.flatnonzero(~same)
        rank = np.arange(len(h)) - np.repeat(block, np.diff(np.append(block, len(h))))
        label = np.zeros(len(h), np.uint64)
        label[order] = rank.astype(np.uint64)
        h = np.where(label > 0, mix64(h + label * np.uint64(0x9E3779B97F4A7C15)), h)
    return h, at


def sketch(h: np.ndarray, at: np.ndarray, sketches: int = SKETCHES, depth: int = L) -> np.ndarray:
    """Order MinHash values, rows x sketches; rows without k-mers get 0.

    The low bits of a permuted hash are replaced by the place in the row, so one minimum gives value and place.
    """
    size = np.diff(at)
    n, full = len(size), np.flatnonzero(size)
    out = np.zeros((n, sketches), np.uint64)
    if not len(full):
        return out
    begin = at[full]
    place = (np.arange(len(h)) - np.repeat(begin, size[full])).astype(np.uint64)
    low = np.uint64((1 << max(1, int(size.max()).bit_length())) - 1)
    padded, x = np.append(h, np.uint64(0)), np.empty(len(h), np.uint64)
    for i in range(sketches):
        np.multiply(h, np.uint64(0xD6E8FEB86659FD93 * (2 * i + 1) & int(_MAX)), out=x)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x &= ~low
        x |= place
        order = np.full((len(full), depth), len(h), np.int64)
        for d in range(depth):
            least = np.minimum.reduceat(x, begin)
            there = size[full] > d
            order[there, d] = begin[there] + (least[there] & low).astype(np.int64)
            if d < depth - 1:
                x[order[there, d]] = _MAX
        order.sort(1)
        value = np.full(len(full), np.uint64(i + 1))
        for d in range(depth):
            value = mix64(value * np.uint64(0x100000001B3) + padded[order[:, d]])
        out[full, i] = value
    return out


def all_sketches(words: np.ndarray, row_at: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Rows x (``SKETCHES`` + ``BRIEF_SKETCHES``); 0 where a row has no sketch of that kind."""
    size = np.diff(row_at)
    out = np.zeros((len(size), SKETCHES + BRIEF_SKETCHES), np.uint64)
    for rows, k, lo, hi, salt in ((size >= similarity * BRIEF - 1, K, 0, SKETCHES, 0), (size <= BRIEF, BRIEF_K, SKETCHES, SKETCHES + BRIEF_SKETCHES, 0x9E3779B97F4A7C15)):
        rows = np.flatnonzero(rows & (size > 0))
        if len(rows):
            mine = words[np.repeat(row_at[rows] - np.append(0, np.cumsum(size[rows]))[:-1], size[rows]) + np.arange(size[rows].sum())]
            value = sketch(*kmers(mine, np.append(0, np.cumsum(size[rows])), k), sketches=hi - lo)
            out[rows, lo:hi] = mix64(value ^ np.uint64(salt)) | np.uint64(1)
    return out


def short_keys(words: np.ndarray, row_at: np.ndarray) -> list[np.ndarray]:
    """Per row of 4 to ``SHORT - 1`` words: hashes of all words and of all but each one; else nothing."""
    out = [np.zeros(0, np.int64)] * (len(row_at) - 1)
    for n in range(4, SHORT):
        rows = np.flatnonzero(np.diff(row_at) == n)
        if not len(rows):
            continue
        mine = words[row_at[rows][:, None] + np.arange(n)]
        keys = []
        for skip in range(-1, n if n > 4 else 0):
            h = np.full(len(rows), 0x5851F42D4C957F2D, np.uint64)
            for j in range(n):
                if j != skip:
                    h = mix64(h * np.uint64(0x100000001B3) + mine[:, j])
            keys.append(h)
        for row, h in zip(rows, np.stack(keys, 1).view(np.int64), strict=True):
            out[row] = np.unique(h)
    return out


_SIG = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.binary()), ("n_words", pa.int32()), ("sketch", pa.list_(pa.int64())), ("short", pa.list_(pa.int64()))])


def _signatures(batches):
    from pyspark import TaskContext

    row, width = TaskContext.get().partitionId() << 40, SKETCHES + BRIEF_SKETCHES
    for s in text_slices(batches, lower=True, max_bytes=SKETCH_SLICE):
        raw, raw_offs = _original(s)
        digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(raw_offs[:-1], raw_offs[1:], strict=True)]
        words, row_at = word_hashes(s)
        sk = all_sketches(words, row_at).view(np.int64)
        values = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * width), pa.array(sk.ravel()))
        short = pa.array(short_keys(words, row_at), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(row + np.arange(s.n)), s.column("doc_id"), pa.array(digests, pa.binary()), pa.array(np.diff(row_at).astype(np.int32)), values, short], schema=_SIG)
        row += s.n


def _original(s: TextSlice) -> tuple[memoryview, list[int]]:
    from lodestone.llm.textbuf import string_buffers

    data, offs = string_buffers(s.column("text"))
    return memoryview(np.ascontiguousarray(data)), offs.tolist()


_WORDS = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("histogram", pa.binary())])


def _word_rows(batches):
    for s in text_slices(batches, lower=True):
        words, row_at = word_hashes(s)
        short = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = [short[a:b] for a, b in zip(row_at[:-1].tolist(), row_at[1:].tolist(), strict=True)]
        counts = [np.minimum(np.bincount(w % HISTOGRAM, minlength=HISTOGRAM), 255).astype(np.uint8).tobytes() for w in rows]
        yield pa.record_batch([s.column("doc_id"), pa.array([w.tobytes() for w in rows], pa.binary()), pa.array(counts, pa.binary())], schema=_WORDS)


def _shared(batches):
    """From entries sorted by bucket those whose bucket occurs again in this partition, or lies at its edge."""
    held, known = None, True  # the last row, and whether it is to be kept; the first row is at the edge
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks().to_batches()[0]
        bucket = rows.column(0).to_numpy()
        keep = np.zeros(len(bucket), bool)
        keep[0] = known
        again = bucket[1:] == bucket[:-1]
        keep[1:] |= again
        keep[:-1] |= again
        held, known = rows.slice(len(bucket) - 1), bool(keep[-1])
        yield rows.slice(0, len(bucket) - 1).filter(pa.array(keep[:-1]))
    if held is not None:
        yield held


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common beginning and end, which cost nothing in an optimal alignment."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    p = int(differ[0]) if len(differ) else n
    a, b, n = a[p:], b[p:], n - p
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    q = int(differ[0]) if len(differ) else n
    return a[: len(a) - q], b[: len(b) - q]


def bag_bound(a: np.ndarray, b: np.ndarray, bins: int = 1024) -> int:
    """A lower bound of the edit distance: half the difference of the word histograms, or of the lengths."""
    diff = np.bincount(a % bins, minlength=bins) - np.bincount(b % bins, minlength=bins)
    return max(-(-int(np.abs(diff).sum()) // 2), abs(len(a) - len(b)))


def _grams(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-word runs and how often each occurs."""
    x = a.astype(np.uint64)
    return np.unique(mix64(mix64(x[:-2] * np.uint64(0x100000001B3) + x[1:-1]) + x[2:]), return_counts=True)


def gram_bound(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """A lower bound of the edit distance: one edit ends at most three of the longer text's runs."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return -(-(max(a[1].sum(), b[1].sum()) - np.minimum(a[1][i], b[1][j]).sum()) // 3)


#: Half widths of bands.
_BANDS = np.sort(np.append(8 * 2 ** np.arange(40), 96 * 2 ** np.arange(36)))


def banded_distance(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Edit distance of every pair of id arrays, or a number above its limit.

    A path that leaves the ``w`` diagonals on either side and ends ``d``
    diagonals away costs at least 2 (w + 1) - d, so a smaller result is certain,
    and no band wider than (limit + d) / 2 is needed. Each pair starts with a
    band for 5/4 of its lower bound and widens it until the result is certain;
    pairs of one band advance in lockstep.
    """
    limits = np.asarray(limits, np.int64)
    out = limits + 1
    short = [_trim(a, b) for a, b in pairs]
    bound = np.array([bag_bound(a, b) for a, b in short], np.int64)
    apart = np.array([abs(len(a) - len(b)) for a, b in short], np.int64)
    longest = np.array([max(len(a), len(b)) for a, b in short], np.int64)
    at = lambda need: np.searchsorted(_BANDS, np.maximum(need, 1))
    most = at(np.minimum((limits + apart + 1) // 2, longest))
    # texts of some length have much the same words whatever they say: compare runs of words before aligning them
    grams: dict[int, tuple] = {}
    for i in np.flatnonzero((bound <= limits) & (longest >= LONG) & (np.minimum([len(a) for a, _ in pairs], [len(b) for _, b in pairs]) > 2)):
        one, two = (grams.get(id(x)) or grams.setdefault(id(x), _grams(x)) for x in pairs[i])
        bound[i] = max(bound[i], gram_bound(one, two))
    band = np.minimum(at((bound * 5 // 4 + apart + 1) // 2), most)
    todo = np.flatnonzero(bound <= limits)
    while len(todo):
        again = []
        for w_at in np.unique(band[todo]):
            mine, w = todo[band[todo] == w_at], int(_BANDS[w_at])
            mine = mine[np.argsort(longest[mine], kind="stable")]
            start = 0
            while start < len(mine):
                # shortest first: the group takes as many pairs as fit with the length of its last
                size = longest[mine[start : start + 256]] + 2 * w + 2
                fit = max(1, int((size * np.arange(1, len(size) + 1) <= CELLS).sum()))
                group = mine[start : start + fit]
                start += fit
                got = _band([short[i] for i in group], w)
                sure = (got <= 2 * w + 1 - apart[group]) | (band[group] >= most[group])
                done = group[sure]
                out[done] = np.where(got[sure] <= limits[done], got[sure], limits[done] + 1)
                again.append(group[~sure])
        todo = np.concatenate(again)
        band[todo] += 1
    return out


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Distances within ``band`` diagonals on either side; exact where the result is at most ``band``."""
    n, m = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    rows, width = int(n.max(initial=0)), 2 * band + 1
    cell = np.int16 if band < 8000 else np.int32
    big = cell(2 * band + 2)  # values above the band need no more than to stay above it
    a = np.zeros((rows, len(pairs)), np.uint32)
    b = np.zeros((int(max(m.max(initial=0), rows)) + width, len(pairs)), np.uint32)
    outside = np.ones(b.shape, bool)
    for i, (x, y) in enumerate(pairs):
        a[: len(x), i], b[band : band + len(y), i], outside[band : band + len(y), i] = x, y, False
    k = np.arange(width)[:, None]
    row = np.where((k >= band) & (k - band <= m), np.minimum(k - band, int(big)), int(big)).astype(cell)
    out = np.full(len(pairs), int(big), np.int64)
    last = m - n + band
    fits, pick = (last >= 0) & (last < width), np.clip(last, 0, width - 1)
    ramp = np.arange(width, dtype=cell)[:, None]
    for i in range(rows + 1):
        if i:
            step = row + ((b[i - 1 : i - 1 + width] != a[i - 1]) | outside[i - 1 : i - 1 + width])
            np.minimum(step[:-1], row[1:] + cell(1), out=step[:-1])
            if i < band:
                step[: band - i] = big
            if i <= band:
                step[band - i] = min(i, int(big))
            step -= ramp
            row = np.minimum.accumulate(step, axis=0)
            row += ramp
            np.minimum(row, big, out=row)
            if i < band:
                row[: band - i] = big
        done = np.flatnonzero((n == i) & fits)
        if len(done):
            out[done] = row[pick[done], done]
    return out


def _lots(batches) -> Iterator[pa.Table]:
    """Rows in lots of up to ``ALIGN_PAIRS`` and about ``ALIGN_BYTES``."""
    held, size, rows = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append(part)
            size, rows = size + part.nbytes, rows + part.num_rows
            if size >= ALIGN_BYTES or rows >= ALIGN_PAIRS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _align(similarity: float):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for lot in _lots(batches):
            u, v = lot.column("u").to_numpy(), lot.column("v").to_numpy()
            pairs = [(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(lot.column("a").to_pylist(), lot.column("b").to_pylist(), strict=True)]
            limits = _limits(np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs]), similarity)
            ok = banded_distance(pairs, limits) <= limits
            if ok.any():
                yield pa.record_batch([pa.array(u[ok]), pa.array(v[ok])], schema=schema)

    return run


def verify(pairs: DataFrame, words: DataFrame, similarity: float, hub_rows: int = HUB_ROWS) -> DataFrame:
    """The pairs (u, v) whose alignment is similar enough. u may be in any number of pairs; its words are copied per ``hub_rows`` of them."""
    hubs = pairs.groupBy("u").agg(F.ceil(F.count("*") / hub_rows).cast("int").alias("parts"))
    left = words.join(hubs, words["doc_id"] == hubs["u"]).select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.col("words").alias("a"))
    dealt = pairs.join(hubs, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    right = dealt.join(words.select(F.col("doc_id").alias("v"), F.col("words").alias("b")), "v")
    both = right.join(left.drop("parts"), ["u", "part"]).select("u", "v", "a", "b")
    return both.mapInArrow(_align(similarity), "u long, v long")


def _limits(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor((1 - similarity) * np.maximum(x, y) + 1e-9).astype(np.int64)


_CELL = ["bucket", "band", "i", "j"]


def _filter(similarity: float):
    """The rows of sorted blocks that have a partner of another component which the two bounds do not rule out, with the partner of least bound."""

    def passing(t: pa.Table, starts: np.ndarray) -> pa.Table:
        i, j, part, up, size, comp = (t.column(c).to_numpy() for c in ("i", "j", "part", "up", "n_words", "component"))
        hist = np.frombuffer(t.column("histogram").combine_chunks().buffers()[2], np.uint8)
        first = t.column("histogram").combine_chunks().offset * HISTOGRAM
        hist = hist[first : first + HISTOGRAM * len(i)].reshape(-1, HISTOGRAM)
        ends = np.append(starts[1:], len(i))
        later = np.repeat(ends, ends - starts) - np.arange(len(i)) - 1
        least, partner, row = np.full(len(i), 1 << 30, np.int64), np.zeros(len(i), np.int64), 0
        while row < len(i):
            to = max(row + 1, int(np.searchsorted(np.cumsum(later[row:]), 1 << 19)) + row)
            n = later[row:to]
            a = np.repeat(np.arange(row, to), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            limit = _limits(size[a], size[b], similarity)
            ok = (comp[a] != comp[b]) & ~(up[a] & up[b]) & ((i[a] == j[a]) | (part[a] != part[b])) & (np.abs(size[a] - size[b]) <= limit)
            a, b, limit = a[ok], b[ok], limit[ok]
            for at in range(0, len(a), 1 << 13):
                x, y = a[at : at + (1 << 13)], b[at : at + (1 << 13)]
                bound = np.abs(hist[x].astype(np.int16) - hist[y]).sum(1)
                close = bound <= 2 * limit[at : at + (1 << 13)]
                for own, other in ((x[close], y[close]), (y[close], x[close])):
                    order = np.lexsort((other, bound[close], own))
                    own, other, cost = own[order], other[order], bound[close][order]
                    head = np.append(True, own[1:] != own[:-1])[: len(own)]
                    better = cost[head] < least[own[head]]
                    least[own[head][better]], partner[own[head][better]] = cost[head][better], other[head][better]
            row = to
        hit = np.flatnonzero(least < 1 << 30)
        kept = t.drop_columns(["histogram"]).take(pa.array(hit))
        kept = kept.append_column("partner", pa.array(t.column("rep").to_numpy()[partner[hit]]))
        return kept.append_column("bound", pa.array(least[hit].astype(np.int32)))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in _CELL])
            starts = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1)
            done, held = rows.slice(0, starts[-1]), rows.slice(starts[-1])
            if done.num_rows:
                yield from passing(done.combine_chunks(), starts[:-1]).to_batches()
        if held is not None:
            yield from passing(held.combine_chunks(), np.zeros(1, np.int64)).to_batches()

    return run


def _second_look(similarity: float):
    """Links of a block across components; a component that is joined is not looked at again.

    Every pair of the block ends in one component, is ruled out by a lower
    bound, or is aligned; a pair with several shared sketches is left to the
    bucket of one of them. In a bucket of short texts, those with a shared sketch are left out. At most one link is written for each joined component.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rep")
        part, up, rep, comp, size = (pdf[c].to_numpy() for c in ("part", "up", "rep", "component", "n_words"))
        words = [np.frombuffer(x, np.uint32) for x in pdf["words"]]
        hist = np.stack([np.frombuffer(x, np.uint8) for x in pdf["histogram"]]).astype(np.int16)
        sk, bucket, whole = np.array(pdf["sketch"].tolist()), pdf["bucket"].iloc[0], pdf["i"].iloc[0] == pdf["j"].iloc[0]
        here = np.flatnonzero((sk == bucket).any(0))  # none if the bucket is one of short texts
        _, root = np.unique(comp, return_inverse=True)
        queue: dict[int, np.ndarray] = {}
        for i in range(len(rep) - 1):
            c = np.arange(i + 1, len(rep))
            limit = _limits(size[c], size[i], similarity)
            fits = (root[c] != root[i]) & ~(up[c] & up[i]) & (whole | (part[c] != part[i])) & (np.abs(size[c] - size[i]) <= limit)
            c, limit = c[fits], limit[fits]
            if not len(c):
                continue
            same = (sk[c] == sk[i]) & (sk[i] != 0)
            if len(here):
                # a pair is the business of one of its shared sketches, by a hash, so that no bucket has most pairs
                times = same.sum(1)
                turn = mix64((rep[c] ^ rep[i]).astype(np.uint64)) % np.maximum(times, 1).astype(np.uint64)
                mine = same[:, here[0]] & (same[:, : here[0]].sum(1) == turn)
            else:
                mine = ~same.any(1)
            bound = np.abs(hist[c] - hist[i]).sum(1) / 2
            ok = mine & (bound <= limit)
            if ok.any():
                queue[i] = c[ok][np.argsort(bound[ok], kind="stable")]
        links = []
        while queue:
            pairs = []
            for i in list(queue):
                left = queue[i][root[queue[i]] != root[i]]
                if not len(left):
                    del queue[i]
                    continue
                pairs += [(i, j) for j in left[:2]]
                queue[i] = left[2:]
            if not pairs:
                break
            limit = np.array([int((1 - similarity) * max(size[i], size[j]) + 1e-9) for i, j in pairs])
            close = banded_distance([(words[i], words[j]) for i, j in pairs], limit) <= limit
            for (i, j), ok in zip(pairs, close, strict=True):
                if ok and root[i] != root[j]:
                    links.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if it was counted to be small; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), n_words."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = materialize(own.mapInArrow(_signatures, "row long, doc_id long, text_hash binary, n_words int, sketch array<long>, short array<long>"), "omh-signatures")
    # equal texts first: one row stands for each
    known = sig.where(F.col("doc_id").isNotNull())
    pick = materialize(known.groupBy("text_hash").agg(F.min(F.struct("doc_id", "row")).alias("s")).select("text_hash", F.col("s.doc_id").alias("rep"), F.col("s.row").alias("first")), "omh-representatives")
    copies = materialize(known.select("text_hash", "row").join(pick, "text_hash").where("row <> first").select("row"), "omh-copies")
    reps = known.join(_few(copies), "row", "left_anti").where("n_words > 0").select(F.col("doc_id").alias("rep"), "n_words", "sketch", "short")
    keys = F.concat(F.array_remove("sketch", F.lit(0).cast("long")), "short")
    entries = reps.select(F.explode(keys).alias("bucket"), "rep", "n_words")
    ranged = entries.repartitionByRange("bucket", "rep").sortWithinPartitions("bucket", "rep")
    shared = materialize(ranged.mapInArrow(_shared, "bucket long, rep long, n_words int"), "omh-shared")
    heads = shared.groupBy("bucket").agg(F.min(F.struct("rep", "n_words")).alias("head"), F.count("*").alias("size")).where(F.col("size") > 1)
    heads = materialize(heads.select("bucket", "head"), "omh-heads")
    members = materialize(shared.join(heads, "bucket").select("bucket", "rep", "n_words", "head"), "omh-buckets")
    close = F.greatest("n_words", "head.n_words") - F.least("n_words", "head.n_words") <= F.floor(F.lit(1 - similarity) * F.greatest("n_words", "head.n_words") + F.lit(1e-9))
    stars = materialize(members.where((F.col("rep") != F.col("head.rep")) & close).select(F.col("head.rep").alias("u"), F.col("rep").alias("v")).distinct(), "omh-stars")
    wanted = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "omh-candidates")
    words = materialize(own.join(_few(wanted), "doc_id", "left_semi").mapInArrow(_word_rows, "doc_id long, words binary, histogram binary").dropDuplicates(["doc_id"]), "omh-words")
    links = materialize(verify(stars, words, similarity), "omh-links")
    left = materialize(_open_blocks(members, words, one_round(links), similarity), "omh-left")
    # the few partners of least bound first: they join most of what is left, each aligned once and not in every block
    best = left.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct("bound", "partner"))), 1, NEAREST).alias("near"))
    pairs = best.select("rep", F.explode("near.partner").alias("partner")).select(F.least("rep", "partner").alias("u"), F.greatest("rep", "partner").alias("v")).distinct()
    links = materialize(links.unionByName(verify(materialize(pairs, "omh-nearest"), words, similarity)), "omh-links-nearest")
    final = components(links)
    more = materialize(_other_links(left.drop("partner", "bound"), reps, words, final, similarity).distinct(), "omh-links-second")
    if not more.isEmpty():
        final = joined_components(final, more)
    by_text = materialize(pick.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("text_hash", F.coalesce("component", "rep").alias("class_id")), "omh-classes")
    return sig.join(by_text, "text_hash", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_words")


def _open_blocks(members: DataFrame, words: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Rows of blocks with several components that have a possible partner in another one.

    A pair is similar enough only if its lengths differ by a factor of ``similarity`` at most. So a document is
    compared within its own band of lengths, and (``up``) with the documents of the band below.
    """
    tagged = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n_words", F.coalesce("component", "rep").alias("component"))
    tagged = materialize(tagged, "omh-tagged")
    several = F.min("component") < F.max("component")
    mixed = tagged.groupBy("bucket").agg(several.alias("several")).where("several").select("bucket")
    band = F.floor(F.log(F.col("n_words").cast("double")) / F.lit(-float(np.log(similarity)))).cast("int")
    place = materialize(tagged.join(mixed, "bucket").withColumn("band", band), "omh-mixed")
    both = place.select("bucket", "rep", "n_words", "component", F.posexplode(F.array(F.col("band"), F.col("band") - 1)).alias("up", "band")).withColumn("up", F.col("up") == 1)
    parts = F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n_words") / PART_WORDS)).cast("int")
    cells = both.groupBy("bucket", "band").agg(parts.alias("parts"), several.alias("several"), F.bool_and("up").alias("above")).where("several and not above").drop("several", "above")
    sized = both.join(materialize(cells, "omh-cells"), ["bucket", "band"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    sized = sized.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sized = sized.select("bucket", "band", F.least("part", "x").alias("i"), F.greatest("part", "x").alias("j"), "part", "up", "rep", "n_words", "component")
    light = sized.join(words.select(F.col("doc_id").alias("rep"), "histogram"), "rep").select(*sized.columns, "histogram")
    light = light.repartition(*_CELL).sortWithinPartitions(*_CELL)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema.fields)
    return light.mapInArrow(_filter(similarity), f"{columns}, partner long, bound int")


def _other_links(left: DataFrame, reps: DataFrame, words: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Links of the blocks that still hold several components."""
    now = left.drop("component").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    now = materialize(now.select(*left.columns), "omh-relabelled")
    cells = now.groupBy(*_CELL).agg((F.min("component") < F.max("component")).alias("several")).where("several").drop("several")
    now = materialize(now.join(cells, _CELL), "omh-open")
    needed = materialize(now.select("rep").distinct(), "omh-open-ids")
    payload = words.withColumnRenamed("doc_id", "rep").join(_few(needed), "rep", "left_semi").join(reps.select("rep", "sketch"), "rep")
    return now.join(payload, "rep").groupBy(*_CELL).applyInPandas(_second_look(similarity), "u long, v long")


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
