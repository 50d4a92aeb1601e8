"""Token ids in files of patched frame-of-reference blocks.

A file: b"PFOR0001"; blocks of BLOCK ids (the last may be shorter); then block starts (u64 each), document ids (i64),
null flags of them (u8), token counts (u64); then n_blocks, n_documents, n_ids and the place of the block starts
(u64 each) and the magic again. A block: its minimum (u32), count (u16), number of exceptions (u16), width (u8);
the low bits of value - minimum at that width; places (u16) and high bits (u32) of the exceptions. The width is, of
those that cover some percentiles of the block's values, the one that makes the block smallest.

A file holds the documents of a range of ids, a 4096th of all text but not less than LEAST_BYTES nor more than FILE_BYTES
of it, whatever the session's settings; rows that
repeat an id, however many, may go on in the next file.

Cases: null text counts as empty and has the end id alone; null document ids come first and stay null; rows that
repeat an id follow each other, ordered by a hash of the text; an empty table gives no documents; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, open_fs, stored
from .tokens import blocks, encoder, slices

MAGIC, BLOCK = b"PFOR0001", 4096
LEAST_BYTES, FILE_BYTES = 16 << 20, 256 << 20
PERCENTILES = (1.0, 0.99, 0.97, 0.95, 0.9, 0.8, 0.6)


def _pack(values: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _unpack(data, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    pad = np.zeros((n, 32), np.uint8)
    pad[:, :width] = bits
    return np.packbits(pad, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray) -> bytes:
    low = ids.min()
    v = (ids - low).astype(np.uint32)
    widths = np.sort(np.frexp(v.astype(np.float64))[1])
    n = len(v)
    choices = {int(widths[min(n - 1, max(0, int(np.ceil(p * n)) - 1))]) for p in PERCENTILES}
    width = min(choices, key=lambda w: (n * w + 48 * (n - np.searchsorted(widths, w, "right")), w))
    over = np.flatnonzero(v >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    mask = np.uint32((1 << width) - 1)
    head = np.array([low], "<u4").tobytes() + np.array([n, len(over)], "<u2").tobytes() + bytes([width])
    high = (v[over] >> np.uint32(width)) if len(over) else np.zeros(0, np.uint32)
    return head + (_pack(v & mask, width) if width else b"") + over.astype("<u2").tobytes() + high.astype("<u4").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    low = np.frombuffer(data, "<u4", 1)[0]
    n, n_over = (int(x) for x in np.frombuffer(data, "<u2", 2, 4))
    width, at = data[8], 9
    size = (n * width + 7) // 8
    v = _unpack(data[at : at + size], n, width)
    at += size
    if n_over:
        v = v.copy()
        v[np.frombuffer(data, "<u2", n_over, at)] |= np.frombuffer(data, "<u4", n_over, at + 2 * n_over) << np.uint32(width)
    return v + low


class Writer:
    """Writes one file; ids are held for a block at most."""

    def __init__(self, out):
        self.out, self.at, self.starts, self.docs, self.nulls, self.counts, self.rest = out, 0, [], [], [], [], []
        self.held = self.total = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, stop, BLOCK):
            self.starts.append(self.at)
            self._put(encode_block(ids[i : min(stop, i + BLOCK)]))
        self.rest, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        foot = self.at
        for x, kind in ((self.starts, "<u8"), (self.docs, "<i8"), (self.nulls, "<u1"), (self.counts, "<u8")):
            self._put(np.array(x, kind).tobytes())
        self._put(np.array([len(self.starts), len(self.docs), self.total, foot], "<u8").tobytes() + MAGIC)


class Reader:
    """Opens a file by its footer; ids(a, b) decodes only the blocks that hold them."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(40, size - 40)
        if tail[32:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        n_blocks, n_docs, self.n_ids, foot = (int(x) for x in np.frombuffer(tail, "<u8", 4))
        data = source.read_at(size - 40 - foot, foot)
        self.starts = np.append(np.frombuffer(data, "<u8", n_blocks).astype(np.int64), foot)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, 8 * n_blocks)
        self.nulls = np.frombuffer(data, "<u1", n_docs, 8 * (n_blocks + n_docs)).astype(bool)
        self.counts = np.frombuffer(data, "<u8", n_docs, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64)

    def ids(self, first: int, stop: int) -> np.ndarray:
        a, b = first // BLOCK, -(-stop // BLOCK)
        if stop <= first:
            return np.zeros(0, np.uint32)
        at = int(self.starts[a])
        data = self.source.read_at(int(self.starts[b]) - at, at)
        parts = [decode_block(data[int(self.starts[k]) - at : int(self.starts[k + 1]) - at]) for k in range(a, b)]
        return np.concatenate(parts)[first - a * BLOCK : stop - a * BLOCK]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Writes docs(doc_id, text) in ascending order of doc_id, a file for each range of ids; returns a row per file.

    The tasks write under names of their own, so one that is run again leaves the first file unread."""

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pfor"
        made, end = encoder(tokenizer), np.array([end_id], np.uint32)
        out = writer = None
        for batch in (part for whole in batches for part in slices(whole)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            if writer is None:
                out = fs.open_output_stream(open_fs(name)[1])
                writer = Writer(out)
            for part in blocks(texts):
                for i, found in zip(ids[part], made.encode(texts[part])):
                    writer.add(i, np.concatenate([found, end]))
        if writer is not None:
            writer.close()
            out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "path": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // min(FILE_BYTES, max(LEAST_BYTES, size // 4096))), docs.sparkSession.sparkContext.defaultParallelism)
    # The hash and the row's number part rows that repeat an id.
    keys = ["doc_id", "_h", "_n"]
    slim = slim.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    ranged = slim.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return stored(ranged.mapInArrow(write, "file int, path string, n_docs long, n_ids long"), "token-files")


def read_tokens(files: DataFrame, step: int = 64 * BLOCK) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files. files: what write_tokens() returns.

    There is a row per file, so one task may number them."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as source:
                    r = Reader(source)
                    ends = np.cumsum(r.counts)
                    starts = ends - r.counts
                    crcs = np.zeros(len(ends), np.int64)
                    for a in range(0, r.n_ids, step):
                        b = min(r.n_ids, a + step)
                        data = memoryview(r.ids(a, b).astype("<u4").tobytes())
                        for d in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))):
                            crcs[d] = zlib.crc32(data[4 * (max(a, int(starts[d])) - a) : 4 * (min(b, int(ends[d])) - a)], int(crcs[d]))
                for i in range(0, len(ends), 10_000):
                    s = slice(i, i + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[s], mask=r.nulls[s]), pa.array(starts[s] + first), pa.array(r.counts[s]), pa.array(crcs[s])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(files.count(), 20_000))
    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, new_path(spark, "tokens")))
