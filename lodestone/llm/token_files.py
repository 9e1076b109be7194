"""Token ids in Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned by doc_id and each partition writes one Arrow
IPC file to the shared folder: a column ``input_ids`` of fixed-size lists of
``seq_len`` unsigned ids (16 bits, or 32 if the vocabulary has more than
65,536 entries) and a column ``mask`` of fixed-size lists of
booleans, uncompressed, so a memory-mapped reader gets sequence ``i`` as
``batch.values[i * seq_len : (i + 1) * seq_len]`` without a copy. Ids run on
from document to document; only the last sequence of a file is padded (mask
false). Document boundaries are a second, small IPC file beside it.

A task writes under a name of its own attempt; only files in the manifest,
which Spark commits, count. So a lost executor costs a rewrite, not a wrong
file.

Defined results: null text is empty (one end id); null doc_id sorts first;
equal doc_ids keep the order of their texts and are written by one task, as a
range never splits a doc_id; a text of any length is written whole; only
doc_id and text are read, so other columns may have any name; an empty table
gives no files.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textbuf import text_slices
from lodestone.llm.tokens import encoder
from lodestone.session import load, materialize, shared_dir

SEQ_LEN = 1024
SLICE = 4 << 20


def filesystem(uri: str):
    """pyarrow file system and path of a folder that all executors share."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def id_type(entries: int) -> type:
    """The smallest of the two id types that holds ``entries`` ids."""
    return np.uint16 if entries <= 1 << 16 else np.uint32


class SequenceWriter:
    """Writes a stream of ids as fixed-size-list batches of ``rows`` sequences."""

    def __init__(self, sink, seq_len: int, rows: int = 1024, dtype: type = np.uint16):
        self.seq_len, self.size, self.rest = seq_len, seq_len * rows, []
        self.held, self.dtype = 0, dtype
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def _batch(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.seq_len) * self.seq_len
        full = np.zeros(n, self.dtype)
        full[: len(ids)] = ids
        mask = np.arange(n) < len(ids)
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (full, mask)]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def write(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            joined = np.concatenate(self.rest)
            cut = len(joined) // self.size * self.size
            for at in range(0, cut, self.size):
                self._batch(joined[at : at + self.size])
            self.rest, self.held = [joined[cut:].copy()], len(joined) - cut

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.rest))
        self.out.close()


def _writer(folder: str, end_id: int, seq_len: int, vocab: str | None):
    schema = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}"
        fs, path = filesystem(folder)
        enc, writer, docs, sizes = encoder(vocab), None, [], []
        for s in text_slices(batches, max_bytes=SLICE):
            if writer is None:
                fs.create_dir(path, recursive=True)
                sink = fs.open_output_stream(f"{path}/{name}.arrow")
                dtype = id_type(max(end_id + 1, enc.vocab_size))
                writer = SequenceWriter(sink, seq_len, dtype=dtype)
            ids, row = enc.encode(s)
            out = np.insert(ids, row[1:], end_id).astype(dtype)
            writer.write(out)
            docs.append(s.column("doc_id"))
            sizes.append(np.diff(row) + 1)
        if writer is None:
            return
        writer.close()
        sink.close()
        n_tokens = np.concatenate(sizes)
        index = pa.record_batch([pa.concat_arrays(docs), pa.array(n_tokens)], names=["doc_id", "n_tokens"])
        with fs.open_output_stream(f"{path}/{name}.index") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_batch(index)
        yield pa.record_batch([[shard], [name], [len(n_tokens)], [int(n_tokens.sum())]], schema=schema)

    return run


def write_token_files(docs: DataFrame, folder: str, end_id: int = 2, seq_len: int = SEQ_LEN, vocab: str | None = None, partitions: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest in document order: shard, name, n_docs, n_tokens, start."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    manifest = materialize(ordered.mapInArrow(_writer(folder, end_id, seq_len, vocab), "shard long, name string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_tokens(fs, path: str):
    """Batches of a file; local files are memory-mapped."""
    source = pa.memory_map(path) if type(fs).__name__ == "LocalFileSystem" else fs.open_input_file(path)
    return pa.ipc.open_file(source)


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        fs, path = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}.index") as f:
                    index = pa.ipc.open_file(f).read_all().combine_chunks()
                doc, sizes = index.column("doc_id").combine_chunks(), index.column("n_tokens").to_numpy()
                crcs, d, left, crc = np.zeros(len(sizes), np.int64), 0, int(sizes[0]), 0
                file = open_tokens(fs, f"{path}/{name}.arrow")
                for k in range(file.num_record_batches):
                    b = file.get_batch(k)
                    ids = b.column(0).values.to_numpy()
                    n_real = b.column(1).values.true_count if hasattr(b.column(1).values, "true_count") else len(ids)
                    wide, at = ids[:n_real].astype("<u4"), 0
                    while at < n_real:
                        take = min(left, n_real - at)
                        crc = zlib.crc32(wide[at : at + take], crc)
                        at, left = at + take, left - take
                        if not left:
                            crcs[d], d, crc = crc, d + 1, 0
                            left = int(sizes[d]) if d < len(sizes) else 0
                ends = np.cumsum(sizes)
                yield pa.record_batch([doc, pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs)], schema=schema)

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = manifest.select("name", "start")
    n = max(1, files.count())
    return files.repartition(n, "name").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files/{uuid.uuid4().hex}"
    manifest = write_token_files(load(spark, sf_dir, "documents"), folder)
    return read_token_files(manifest, folder)
