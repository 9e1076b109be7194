"""Language identification by script ranges, per-word scores and Viterbi.

A word's script (from its code points) narrows the languages it can belong
to. Each remaining language scores the word by hashed character n-grams with
word edges, as the logarithm of how much likelier the n-grams are in the
language than if all were equally likely. One more state, the unknown one,
scores 0 for any word: it takes words whose script no language uses and words
that fit every language badly. A Viterbi pass over the words of a text, with
one penalty for any switch of state, labels spans; mixed texts so give several
spans. The prediction is the language with the most letters under its spans;
its score is their share of all letters, those of unknown spans among them.

The n-gram counts come from a bounded sample (about ``fit_rows`` rows, the same
number for each language where it has so many, chosen by a hash of doc_id and
text) of rows with a non-null language; the model has a fixed size
(``BUCKETS`` x languages) and travels with the task.

Letters are the characters of Unicode category L; marks (category M) belong to
the word they stand in and count for it.

Defined results: a text that is null or has no letter is ``und`` with score
0; a text with letters, all of them under unknown spans, has the language
whose word scores add up to most and score 0; equal letters go to the language
that sorts first; repeated rows give repeated results, equal texts equal ones;
a text of any length is labelled whole; without a learned language all is
``und``; only doc_id, text (and lang to learn from) are read, so other columns
may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbuf import LETTERS, TextSlice, mix64, runs, span_hashes, text_slices
from lodestone.session import load

BUCKETS = 1 << 16
FIT_ROWS = 8000
SWITCH = 6.0
#: Count that an n-gram has without being seen; least logarithm of a likelihood ratio, so that unseen ones weigh alike after small and large samples.
PSEUDO, LEAST = 0.05, -4.0
UND = "und"
#: First code point of each script range and its name.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other")]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_AT = np.array([at for at, _ in SCRIPTS])
_SCRIPT_ID = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


@cache
def _categories() -> np.ndarray:
    """1 for letters, 2 for marks, 0 for the rest, by code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            out[cp] = 1 if kind == "L" else 2
    return out


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at ``at``."""
    lead = data[at].astype(np.int64)
    get = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F
    two, three = (lead & 0x1F) << 6 | get(1), (lead & 0x0F) << 12 | get(1) << 6 | get(2)
    four = ((lead & 0x07) << 18 | get(1) << 12 | get(2) << 6 | get(3)) & 0x1FFFFF
    return np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, np.minimum(four, 0x10FFFF))))


def letter_mask(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of letters and marks, and the first bytes of letters."""
    mask = LETTERS[data]
    mask[data >= 0x80] = False
    first = mask.copy()
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        kind = _categories()[code_points(data, lead)]
        first[lead[kind == 1]] = True
        size = np.where(data[lead] >= 0xF0, 4, np.where(data[lead] >= 0xE0, 3, 2))
        for k in range(4):
            at = lead[(size > k) & (kind > 0)] + k
            mask[at[at < len(data)]] = True
    return mask, first


@dataclass
class Words:
    """Words of a slice: distinct word of each place, row offsets, letters; and the distinct words."""

    index: np.ndarray
    row_at: np.ndarray
    size: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(s: TextSlice) -> Words:
    mask, letters = letter_mask(s.data) if len(s.data) else (np.zeros(0, bool), np.zeros(0, bool))
    starts, ends, row_at = runs(mask, s.offs)
    if len(starts):
        before = np.append(0, np.cumsum(letters))
        real = before[ends] > before[starts]  # not marks alone
        if not real.all():
            row_at = np.append(0, np.cumsum(real))[row_at]
            starts, ends = starts[real], ends[real]
    _, first, index = np.unique(span_hashes(s.data, starts, ends), return_index=True, return_inverse=True)
    return Words(index, row_at, ends - starts, first, starts, ends)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 4-byte-grams of the words with their edges: bucket of each and word offsets."""
    size = ends - starts + 2
    at = np.append(0, np.cumsum(size))
    padded = np.zeros(at[-1], np.uint64)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    padded[inner] = data[np.repeat(starts - at[:-1] - 1, size)[inner] + np.flatnonzero(inner)]
    left = np.repeat(at[1:], size) - np.arange(at[-1])
    grams, value = [], padded
    for n in range(1, 5):
        h = (mix64(value + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        grams.append(np.where(left >= n, h, -1))
        nxt = np.zeros_like(padded)
        nxt[: len(padded) - n] = padded[n:]
        value = value << np.uint64(8) | nxt
    return np.stack(grams, 1), at


def word_scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of the first character of each word."""
    return _SCRIPT_ID[np.searchsorted(_SCRIPT_AT, code_points(data, starts), "right") - 1]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray

    def score(self, s: TextSlice, w: Words) -> np.ndarray:
        """Log-score of each distinct word under each language and, last, the unknown state."""
        starts, ends = w.starts[w.first], w.ends[w.first]
        if not len(starts):
            return np.zeros((0, len(self.langs) + 1), np.float32)
        grams, at = word_features(s.data, starts, ends)
        table = np.vstack([self.logp, np.zeros((1, len(self.langs)), np.float32)])
        total = np.add.reduceat(table[grams].sum(1), at[:-1], axis=0)
        letters = np.add.reduceat(table[grams[:, 0]].max(1), at[:-1])
        bias = np.where(self.allowed[word_scripts(s.data, starts)], 0, -1e4)
        return np.column_stack([total + bias, letters]).astype(np.float32)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Counts hashed n-grams per language over a bounded sample of rows with a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = dict(known.groupBy("lang").count().orderBy("lang").collect())  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    shares = docs.sparkSession.createDataFrame([(x, int(min(1.0, fit_rows / len(langs) / sizes[x]) * (1 << 30))) for x in langs], "lang string, share long")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share")
    sample = known.join(F.broadcast(shares), "lang").where(drawn).select("lang", "text")  # one row a language
    code = {x: i for i, x in enumerate(langs)}
    schema = pa.schema([("counts", pa.binary())])
    shape = (BUCKETS + len(SCRIPT_NAMES), len(langs))

    def count(batches):
        counts = np.zeros(shape, np.int64)
        for s in text_slices(batches, lower=True):
            w = words_of(s)
            if not len(w.starts):
                continue
            row_lang = np.array([code.get(x, -1) for x in s.column("lang").to_pylist()])
            lang = row_lang[np.repeat(np.arange(s.n), np.diff(w.row_at))]
            pair = lang * len(w.first) + w.index
            pair, times = np.unique(pair[lang >= 0], return_counts=True)
            word, lang = pair % len(w.first), pair // len(w.first)
            grams, at = word_features(s.data, w.starts[w.first], w.ends[w.first])
            for k in np.unique(lang):
                weight = np.zeros(len(w.first))
                weight[word[lang == k]] = np.sqrt(times[lang == k])
                each = np.repeat(weight, np.diff(at))
                for g in grams.T:
                    ok = g >= 0
                    counts[:BUCKETS, k] += np.bincount(g[ok], each[ok], BUCKETS).astype(np.int64)
                counts[BUCKETS:, k] += np.bincount(word_scripts(s.data, w.starts[w.first]), weight, len(SCRIPT_NAMES)).astype(np.int64)
        yield pa.record_batch([[counts.tobytes()]], schema=schema)

    counts = sum(np.frombuffer(r[0], np.int64).reshape(shape) for r in sample.repartition(8).mapInArrow(count, "counts binary").toLocalIterator())
    grams, scripts = counts[:BUCKETS].astype(float), counts[BUCKETS:]
    p = (grams + PSEUDO) / (grams.sum(0) + PSEUDO * BUCKETS)
    return Model(langs, (np.maximum(np.log(p * BUCKETS), LEAST) * 0.5).astype(np.float32), scripts >= np.maximum(1, 0.001 * scripts.sum(0)))


def viterbi(score: np.ndarray, row_at: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of every word; rows run in lockstep, longest first, so each step is one numpy call for all of them."""
    n, k = score.shape
    path = np.zeros(n, np.int16)
    size = np.diff(row_at)
    order = np.argsort(-size, kind="stable")
    size, at = size[order], row_at[:-1][order]
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    back = np.zeros((n, k), bool)
    from_best = np.zeros(n, np.int16)
    live = score[at[: alive[0]]].copy() if len(alive) else None
    final = np.zeros((len(size), k), np.float32)
    for t in range(1, len(alive)):
        m = alive[t]
        if m < len(live):
            final[m : len(live)] = live[m:]
            live = live[:m]
        best = live.argmax(1)
        switch = live[np.arange(m), best][:, None] - penalty
        here = at[:m] + t
        back[here] = live < switch
        from_best[here] = best
        live = np.maximum(live, switch) + score[here]
    if live is not None:
        final[: len(live)] = live
    state = final.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        here = at[:m] + t
        path[here] = state[:m]
        moved = back[here, state[:m]]
        state[:m] = np.where(moved, from_best[here], state[:m])
    return path


def label(s: TextSlice, model: Model) -> tuple[np.ndarray, np.ndarray, Words]:
    """Letters of each row under each language and the unknown state, the state of every word, and the words."""
    w, k = words_of(s), len(model.langs) + 1
    path = viterbi(model.score(s, w)[w.index], w.row_at) if len(w.index) and k > 1 else np.full(len(w.index), k - 1, np.int16)
    row = np.repeat(np.arange(s.n), np.diff(w.row_at))
    share = np.bincount(row * k + path, w.size, s.n * k).reshape(s.n, -1)
    return share, path, w


def decide(s: TextSlice, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a row has letters, its language (by number) and the share of its letters under that."""
    share, _, w = label(s, model)
    total, k = share.sum(1), len(model.langs)
    ok = (total > 0) & (k > 0)
    if not k:
        return ok, np.zeros(s.n, int), np.zeros(s.n)
    best = share[:, :k].argmax(1)
    for i in np.flatnonzero(ok & (share[:, :k].max(1) == 0)):  # all unknown
        words = w.index[w.row_at[i] : w.row_at[i + 1]]
        best[i] = model.score(s, w)[words, :k].astype(float).sum(0).argmax()
    return ok, best, np.where(ok, share[np.arange(s.n), best] / np.maximum(total, 1), 0.0)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (share of the letters under the prediction)."""

    def run(batches):
        for s in text_slices(batches, lower=True):
            ok, best, score = decide(s, model)
            names = [model.langs[b] if o else UND for b, o in zip(best, ok, strict=True)]
            ids = s.column("doc_id")
            held = [None if d is None else zlib.crc32(str(d).encode()) % 4 == 2 for d in ids.to_pylist()]
            yield pa.record_batch([ids, pa.array(held, pa.bool_()), pa.array(names, pa.string()), pa.array(score)], schema=_OUT)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """Spans of one language: doc_id, first_word, n_words, lang (words from 0; ``und`` for unknown spans)."""
    names = [*model.langs, UND]
    schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())])

    def run(batches):
        for s in text_slices(batches, lower=True):
            _, path, w = label(s, model)
            row = np.repeat(np.arange(s.n), np.diff(w.row_at))
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(path)))
            ids = s.column("doc_id").take(pa.array(row[at]))
            yield pa.record_batch([ids, pa.array(at - w.row_at[row[at]]), pa.array(size), pa.array([names[x] for x in path[at]], pa.string())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, first_word long, n_words long, lang string")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a language is given and crc32(doc_id as text) mod 4 is not 2."""
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull())


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return predict(docs, fit(training_rows(docs)))
