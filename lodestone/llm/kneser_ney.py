"""Quality classifier: interpolated modified Kneser-Ney over character n-grams.

Characters are taken as they are (no classes, no folding), so the count tables
grow with the trusted text. Every task counts its own n-grams of the trusted
texts; counts are summed and joined in shards by n-gram: with the totals of
their context, with the counts of counts that give the three discounts, and
with the probabilities of the order below, whose counts are continuation
counts. The model is a set of tables in the shared folder, one pair (n-gram
probabilities, back-off weights) for each order; it is never broadcast or
collected.

Scoring. Documents are read in blocks of about ``BLOCK_BYTES``. A block's
distinct n-grams are joined to the model in shards, order by order (a left
join for the n-gram, one for the weight of its context), and the answers are
written to the shared folder as one file for each block. The documents are
then read once more, block by block, and every n-gram finds its
log-probability in the file of its block. So what is shuffled is a block's
distinct n-grams, not an entry for every n-gram of every document (which would
be several times the text).

A document's perplexity is compared with a quantile for its language. The
quantiles come from ``HELD_OUT`` of the trusted documents, which are not
counted, times ``MARGIN`` (see the README for the shares that this keeps).

The blocks of the two readings must agree, so ``docs`` must be a plan that
gives the same rows in the same order each time, such as a scan of a table; a
block without its file raises an error.

Defined results: null or empty text is rejected (perplexity null); languages
with fewer than ``MIN_TRUSTED`` held-out documents, null among them, use the
quantile over all languages; without held-out trusted documents nothing is
rejected but empty texts; a doc_id with contradicting or null labels is not
trusted; repeated rows give repeated results; equal texts of one language
give equal results; a text of any length is scored whole, as a block of its
own if it is longer than a block; an empty table gives no rows; ``classify``
reads doc_id, text and lang only, ``keep_good`` returns all columns as they
are, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textbuf import give_back, mix64, segment_sums, string_buffers
from lodestone.llm.token_files import filesystem
from lodestone.session import load, materialize, shared_dir

ORDER = 4
QUANTILE = 0.995
MARGIN = 1.02
#: One in so many trusted documents is held out for the quantiles.
HELD_OUT = 5
GRID = 1000  # bins per unit of log-perplexity
MIN_TRUSTED = 20
BROADCAST_IDS = 2_000_000
BLOCK_BYTES = 32 << 20
SLICE = 1 << 20
SLOT_BITS = 20
START = "\x02"  # stands before the first character

_ODD = mix64(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@dataclass
class Chars:
    """Code points of some rows, each row after ``order - 1`` boundary symbols; the code of the n-gram that ends at every character."""

    points: np.ndarray
    codes: np.ndarray
    ends: np.ndarray
    offs: np.ndarray


def characters(data: np.ndarray, offs: np.ndarray, order: int) -> Chars:
    """n-grams of UTF-8 rows (bytes and byte offsets)."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    at = before[offs]
    n, pad = np.diff(at), order - 1
    row = np.repeat(np.arange(len(n)), n)
    ends = np.arange(len(points)) + (row + 1) * pad
    full = np.full(len(points) + pad * len(n), ord(START), np.uint32)
    full[ends] = points
    wide = full.astype(np.uint64) + np.uint64(1)
    h = wide * _ODD[0]
    for k in range(1, order):
        h[k:] += wide[:-k] * _ODD[k]
    return Chars(full, mix64(h)[ends], ends, at)


def gram_codes(grams: pa.Array, order: int) -> np.ndarray:
    """Codes of n-grams given as strings of ``order`` characters."""
    data, offs = string_buffers(grams)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).reshape(-1, order)
    h = np.zeros(len(points), np.uint64)
    for k in range(order):
        h += (points[:, order - 1 - k].astype(np.uint64) + np.uint64(1)) * _ODD[k]
    return mix64(h)


def _slot(codes: np.ndarray) -> np.ndarray:
    """The top bits of a code: its place in a table of 2 ** ``SLOT_BITS`` entries."""
    return (codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _places(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """A place of every code of ``wanted`` (sorted, distinct) in ``codes``."""
    flag = np.zeros(1 << SLOT_BITS, bool)
    flag[_slot(wanted)] = True
    near = np.flatnonzero(flag[_slot(codes)])
    at = np.minimum(np.searchsorted(wanted, codes[near]), len(wanted) - 1)
    hit = wanted[at] == codes[near]
    out = np.zeros(len(wanted), np.int64)
    out[at[hit]] = near[hit]
    return out


def _distinct(slices, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, characters (rows x order) and counts of the distinct n-grams."""
    codes, points, counts = np.zeros(0, np.uint64), np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
    for data, offs in slices:
        if not len(data):
            continue
        c = characters(data, offs, order)
        u, n = np.unique(c.codes, return_counts=True)
        at = np.searchsorted(codes, u)
        known = np.zeros(len(u), bool)
        inside = at < len(codes)
        known[inside] = codes[at[inside]] == u[inside]
        counts[at[known]] += n[known]
        if not known.all():
            new = ~known
            spell = c.points[c.ends[_places(c.codes, u[new])][:, None] + np.arange(1 - order, 1)]
            codes, points, counts = np.append(codes, u[new]), np.concatenate([points, spell]), np.append(counts, n[new])
            by = np.argsort(codes, kind="stable")
            codes, points, counts = codes[by], points[by], counts[by]
    return codes, points, counts


class Lookup:
    """Values by code: one table entry for most codes, a search for those whose entry another code has."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values
        self.owner = np.zeros(1 << SLOT_BITS, np.int32)
        self.owner[_slot(codes)] = np.arange(len(codes), dtype=np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.owner[_slot(codes)]
        miss = np.flatnonzero(self.codes[at] != codes)
        if len(miss):
            at[miss] = np.searchsorted(self.codes, codes[miss])
        return self.values[at]


def _strings(points: np.ndarray) -> pa.Array:
    joined, k = np.ascontiguousarray(points).astype("<u4").tobytes().decode("utf-32-le"), points.shape[1]
    return pa.array([joined[i : i + k] for i in range(0, len(joined), k)], pa.string())


def _slices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a text column in pieces of about ``SLICE`` bytes."""
    data, offs = string_buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1)
        yield data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def blocks(batches, most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with at most ``most`` bytes of text (or one longer text), with a key made from their texts. The cuts do not depend on the batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offs = string_buffers(_text(batch))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(offs, offs[lo] + most - size, "right")) - 1
            if not held:
                hi = max(hi, lo + 1)
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
                lo = hi
            if lo < n:
                yield _keyed(held)
                held, size = [], 0
    if held:
        yield _keyed(held)
    give_back()


def _keyed(held: list[pa.RecordBatch]) -> tuple[int, pa.RecordBatch]:
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    data, offs = string_buffers(_text(whole))
    h = hashlib.blake2b(np.ascontiguousarray(data), digest_size=8)
    h.update(np.diff(offs).tobytes())
    return int.from_bytes(h.digest(), "little", signed=True), whole


def _count(order: int):
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def run(batches):
        for _, rows in blocks(batches):
            _, points, n = _distinct(_slices(_text(rows)), order)
            if len(n):
                yield pa.record_batch([_strings(points), pa.array(n)], schema=schema)

    return run


def _requests(order: int):
    schema = pa.schema([("block", pa.int64()), ("gram", pa.string())])

    def run(batches):
        for key, rows in blocks(batches):
            _, points, _ = _distinct(_slices(_text(rows)), order)
            if len(points):
                yield pa.record_batch([pa.array(np.full(len(points), key)), _strings(points)], schema=schema)

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids whose labels all say quality 1."""
    own = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    own = own.agg(F.min("quality").alias("low"), F.count_if(F.col("quality").isNull()).alias("gaps"))
    return own.where((F.col("low") == 1) & (F.col("gaps") == 0)).select("doc_id")


def held_out() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0


def restrict(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among ``ids``: broadcast if the ids were counted to be few, else a shuffle join."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from the counts of counts."""
    n = counts.agg(*(F.count_if(F.col("n") == k) for k in range(1, 5))).first()
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


@dataclass
class Counts:
    """The model: for each order, probabilities (gram, p) and back-off weights (context, weight); the probability below order 1."""

    order: int
    grams: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    base: float


def _context(k: int) -> F.Column:
    return F.substring("gram", 1, k - 1) if k > 1 else F.lit("")


def fit(text: DataFrame, order: int = ORDER) -> Counts:
    """The model of the texts in column ``text``."""
    full = text.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(order), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    by_order = {order: materialize(full, "kn-counts")}
    for k in range(order - 1, 0, -1):
        by_order[k] = materialize(by_order[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"kn-counts-{k}")
    base = 1.0 / (by_order[1].count() + 1)  # one more for the characters that were not seen
    grams, weights, lower = {}, {}, None
    n = F.col("n")
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(by_order[k])
        rows = by_order[k].withColumn("context", _context(k))
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), *(F.count_if(c).alias(x) for x, c in (("one", n == 1), ("two", n == 2), ("more", n >= 3))))
        totals = totals.select("context", "total", ((d1 * F.col("one") + d2 * F.col("two") + d3 * F.col("more")) / F.col("total")).alias("weight"))
        totals = materialize(totals, f"kn-weights-{k}")
        own = (n - F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)) / F.col("total")
        joined = rows.join(totals, "context").select("gram", "weight", own.alias("own"))
        if lower is None:
            p = joined.select("gram", (F.col("own") + F.col("weight") * base).alias("p"))
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            p = joined.join(below, F.substring("gram", 2, k - 1) == F.col("suffix")).select("gram", (F.col("own") + F.col("weight") * F.col("below")).alias("p"))
        lower = grams[k] = materialize(p, f"kn-order-{k}")
        weights[k] = totals.select("context", "weight")
    return Counts(order, grams, weights, base)


def resolve(grams: DataFrame, model: Counts) -> DataFrame:
    """Log-probability (gram, logp) of distinct n-grams of the highest order, seen or not: joins with one order after the other."""
    now, done = grams.select("gram", F.lit(1.0).alias("w")), []
    for k in range(model.order, 0, -1):
        tail = F.substring("gram", model.order - k + 1, k)
        found = now.withColumn("tail", tail).join(model.grams[k].select(F.col("gram").alias("tail"), "p"), "tail", "left")
        found = materialize(found.select("gram", "w", "p"), f"kn-found-{k}")
        done.append(found.where("p is not null").select("gram", F.log(F.col("w") * F.col("p")).alias("logp")))
        left = found.where("p is null").select("gram", "w").withColumn("context", F.substring("gram", model.order - k + 1, k - 1) if k > 1 else F.lit(""))
        now = left.join(model.weights[k], "context", "left").select("gram", (F.col("w") * F.coalesce("weight", F.lit(1.0))).alias("w"))
    done.append(now.select("gram", F.log(F.col("w") * F.lit(model.base)).alias("logp")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _answer_writer(folder: str, order: int):
    schema = pa.schema([("block", pa.int64()), ("n", pa.int64())])

    def run(key, table):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        codes = gram_codes(table.column("gram").combine_chunks(), order)
        codes, first = np.unique(codes, return_index=True)
        logp = table.column("logp").to_numpy()[first]
        name, block = f"{path}/{uuid.uuid4().hex}.tmp", key[0].as_py()
        batch = pa.record_batch([pa.array(codes), pa.array(logp)], names=["code", "logp"])
        with fs.open_output_stream(name) as f, pa.ipc.new_file(f, batch.schema) as w:
            w.write_batch(batch)
        fs.move(name, f"{path}/{block}.arrow")
        return pa.table({"block": pa.array([block], pa.int64()), "n": pa.array([len(codes)], pa.int64())}, schema=schema)

    return run


def write_answers(docs: DataFrame, model: Counts) -> str:
    """Writes the log-probabilities that every block of ``docs`` needs; returns their folder."""
    folder = f"{shared_dir(docs.sparkSession)}/kn-answers/{uuid.uuid4().hex}"
    requests = materialize(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_requests(model.order), "block long, gram string"), "kn-requests")
    answers = materialize(resolve(requests.select("gram").distinct(), model), "kn-answers")
    per_block = requests.join(answers, "gram").select("block", "gram", "logp").groupBy("block")
    materialize(per_block.applyInArrow(_answer_writer(folder, model.order), "block long, n long"), "kn-blocks")
    return folder


def _answers(fs, path: str) -> Lookup:
    """Log-probabilities of a block's n-grams by code."""
    try:
        with fs.open_input_file(path) as f:
            got = pa.ipc.open_file(f).read_all()
    except FileNotFoundError:
        raise RuntimeError("the documents differ between two readings; write them as a table first") from None
    return Lookup(got.column("code").to_numpy(), got.column("logp").to_numpy())


def _score(folder: str, order: int):
    """From batches to (block's rows, log-perplexity of each; nan for empty texts)."""

    def run(batches):
        fs, path = filesystem(folder)
        for key, rows in blocks(batches):
            answers, out = None, []
            for data, offs in _slices(_text(rows)):
                if not len(data):
                    out.append(np.full(len(offs) - 1, np.nan))
                    continue
                if answers is None:
                    answers = _answers(fs, f"{path}/{key}.arrow")
                c = characters(data, offs, order)
                total, n = segment_sums(answers(c.codes), c.offs), np.diff(c.offs)
                out.append(np.where(n > 0, -total / np.maximum(n, 1), np.nan))
            yield rows, np.floor(np.concatenate(out) * GRID) / GRID

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def log_perplexity(docs: DataFrame, model: Counts) -> DataFrame:
    """Per document: doc_id, lang, log_perplexity (mean over its characters; null for empty texts)."""
    score = _score(write_answers(docs, model), model.order)

    def run(batches):
        for b, logp in score(batches):
            yield pa.record_batch([b.column(0), b.column(2), pa.array(logp, from_pandas=True)], names=["doc_id", "lang", "log_perplexity"])

    return _plain(docs).mapInArrow(run, "doc_id long, lang string, log_perplexity double")


@dataclass
class QualityModel:
    """Fitted tables and the thresholds by language ("" for all)."""

    counts: Counts
    thresholds: dict[str, float]

    def limit(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds.get("", np.inf))


def quantiles(scored: DataFrame, quantile: float) -> dict[str, float]:
    """The quantile of log_perplexity for every language with enough rows, and over all ("")."""
    bins = scored.where("log_perplexity is not null").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("log_perplexity") * GRID + 0.5).alias("bin")).agg(F.count("*").alias("n"))
    bins = materialize(bins, "kn-bins")
    each = bins.where(F.col("lang") != "").unionByName(bins.groupBy(F.lit("").alias("lang"), "bin").agg(F.sum("n").alias("n")))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    every = F.sum("n").over(Window.partitionBy("lang"))
    enough = F.col("every") >= F.when(F.col("lang") == "", 1).otherwise(MIN_TRUSTED)
    cut = each.select("lang", "bin", below.alias("below"), every.alias("every")).where((F.col("below") >= F.col("every") * quantile) & enough)
    return {r["lang"]: r["bin"] / GRID for r in cut.groupBy("lang").agg(F.min("bin").alias("bin")).collect()}  # one row a language


def fit_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, order: int = ORDER) -> QualityModel:
    """Fits the model on the trusted rows of ``docs`` that are not held out, and takes the quantiles over those that are."""
    trusted = materialize(trusted_ids(labels), "kn-trusted")
    model = fit(restrict(_plain(docs), trusted.where(~held_out())), order)
    test = materialize(restrict(_plain(docs), trusted.where(held_out())), "kn-held-out")
    return QualityModel(model, {k: v * margin for k, v in quantiles(log_perplexity(test, model), quantile).items()})


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per document: doc_id, lang, log_perplexity, threshold, keep."""
    score = _score(write_answers(docs, model.counts), model.counts.order)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("log_perplexity", pa.float64()), ("threshold", pa.float64()), ("keep", pa.bool_())])

    def run(batches):
        for b, logp in score(batches):
            limit = np.array([model_limit(x) for x in b.column(2).to_pylist()], float)
            keep = ~np.isnan(logp) & ~(logp > limit)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(logp, from_pandas=True), pa.array(limit), pa.array(keep)], schema=schema)

    model_limit = QualityModel(None, model.thresholds).limit
    return _plain(docs).mapInArrow(run, "doc_id long, lang string, log_perplexity double, threshold double, keep boolean")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    score = _score(write_answers(docs, model.counts), model.counts.order)
    model_limit = QualityModel(None, model.thresholds).limit

    def run(batches):
        for b, logp in score(batches):
            langs = b.column(b.schema.get_field_index("lang")).to_pylist()
            limit = np.array([model_limit(x) for x in langs], float)
            yield b.filter(pa.array(~np.isnan(logp) & ~(logp > limit)))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return classify(docs, fit_quality(docs, load(spark, sf_dir, "labels")))
