"""Media columns: bytes stored as progressive JPEG and read back as RGB tensors.

``store`` writes every text into frames of the format (see ``jpeg``);
``features`` reads the stored bytes back: scans are accumulated into
coefficient arrays, the payload is recovered from them, and the inverse
transform with upsampled chroma gives the tensor the feature is computed on.
``tensors`` returns the tensors themselves.

The unit of storage is the quantised coefficient, because samples do not
survive the format's rounding. Memory is bounded by the slice; a longer text
is cut into frames of ``jpeg.FRAME_BYTES``.

Defined results: null text is empty and is stored as 64 zero bytes; equal
texts give equal values whatever their neighbours; repeated rows give repeated
results; a text of any length is stored whole, in as many frames as it needs;
only doc_id and text are read, so other columns may have any name; an empty
table gives none.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import jpeg
from lodestone.llm.textbuf import text_slices
from lodestone.session import load

SLICE = 1 << 20


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def _store(batches):
    for s in text_slices(batches, max_bytes=SLICE):
        media = jpeg.encode([pad(s.text(i)) for i in range(s.n)])
        yield pa.record_batch([s.column("doc_id"), pa.array(np.diff(s.offs)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes (unpadded), media (the stored form)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _groups(column: pa.Array, most: int):
    """Row ranges of at most ``most`` media bytes."""
    lo, held, sizes = 0, 0, [len(x.as_buffer()) if x.is_valid else 0 for x in column]
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def feature(tensors: list[np.ndarray]) -> str:
    """Size, channel means and deviations over all frames of an image."""
    flat = np.concatenate([t.reshape(-1, 3) for t in tensors]).astype(np.int64)
    n, total, square = len(flat), flat.sum(0), (flat * flat).sum(0)
    mean = total / n
    return f"{tensors[0].shape[0]}x{sum(t.shape[1] for t in tensors)}:" + ",".join(f"{m:.3f}/{max(q / n - m * m, 0) ** 0.5:.3f}" for m, q in zip(mean, square, strict=True))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _features(batches):
    for batch in batches:
        for lo, hi in _groups(batch.column(2), 2 * SLICE):
            part = batch.slice(lo, hi - lo)
            images = part.column(2).to_pylist()
            frames, base, coef = jpeg.coefficients(images)
            stored = jpeg.payloads(images, frames, base, coef)
            pixels = jpeg.samples(frames, base, coef)
            tensors: list[list[np.ndarray]] = [[] for _ in images]
            for f, at in zip(frames, base[:-1], strict=True):
                tensors[f.image].append(jpeg.rgb(f, at, pixels))
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array([len(x) for x in stored], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stored]), pa.array([zlib.crc32(x[-64:]) for x in stored], pa.int64()), pa.array([len(x) for x in images], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in images]), pa.array([feature(t) for t in tensors])],
                schema=_OUT,
            )


def features(stored: DataFrame) -> DataFrame:
    """Digest columns and features of stored media, from the bytes read back."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Any progressive JPEG column as tensors: id, frame, height, width, rgb (row-major bytes); null media gives no rows."""

    def run(batches):
        for batch in batches:
            for ident, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames, base, coef = jpeg.coefficients([image])
                pixels = jpeg.samples(frames, base, coef)
                out = [jpeg.rgb(f, at, pixels) for f, at in zip(frames, base[:-1], strict=True)]
                yield pa.record_batch([pa.array([ident] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()), pa.array([t.shape[0] for t in out], pa.int32()), pa.array([t.shape[1] for t in out], pa.int32()), pa.array([t.tobytes() for t in out], pa.binary())], names=["id", "frame", "height", "width", "rgb"])

    own = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return own.mapInArrow(run, "id long, frame int, height int, width int, rgb binary")


def op2_media_column(spark, sf_dir: str) -> DataFrame:
    return features(store(load(spark, sf_dir, "documents")))
