"""Token ids in Simple-8b files, and back.

Documents are range-partitioned by (doc_id, hash of the text), so that one id with very many rows splits too. Each task
tokenizes its range in order and streams it to one file of the shared folder; a manifest has one row per file. Files are
written under names of their own, so that a task run twice does no harm, and once written they outlive lost executors.

File: segments of up to SEGMENT ids, then an Arrow table with (doc_id, n_tokens) of the documents, then a footer. A
segment has a codebook (its distinct ids, the most frequent first), the 64-bit words of its codes, a word offset per
BLOCK codes, and escapes. The upper 4 bits of a word select how many codes of how many bits its lower 60 bits hold.
Codes that need more than ESCAPE_BITS are written as the escape code, and their values listed in order behind the words.
Blocks start at a word of their own, so that any block decodes alone, all words with one selector at a time.

Null texts count as empty and have the end id alone. Rows with a null doc_id come first. Repeated rows are kept, each
with its own start. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.llm.common import TOGETHER, encoder, partitions, scratch, slices, staged
from ctxlake.llm.words import by_bytes

BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // BITS
ESCAPE_BITS, BLOCK, SEGMENT = 12, 1 << 13, 1 << 20
ESCAPE = (1 << ESCAPE_BITS) - 1
MAGIC = b"S8BT"


def pack_words(codes: np.ndarray) -> np.ndarray:
    """Simple-8b words of codes below 2**60. Each word takes as many of the next codes as one selector allows."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    widest = np.searchsorted(BITS, int(codes.max()).bit_length())
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(60, np.uint64)])
    best = np.full(n, widest, np.int8)
    at = np.arange(n, dtype=np.int32)
    turned = np.ascontiguousarray(codes[::-1])
    for k in range(widest - 1, -1, -1):
        wide = turned >= (1 << int(BITS[k]))
        if 3 * np.count_nonzero(wide) > 2 * n:  # where most codes are wider, and so than all narrower selectors too
            break
        # how many codes from here on this selector's bits can hold; what follows the last code is free
        room = at - np.maximum.accumulate(np.where(wide, at, np.int32(-61)))
        best[room >= COUNTS[k]] = k
    best = best[::-1]
    steps, counts, i, starts = best.tolist(), COUNTS.tolist(), 0, []
    while i < n:
        starts.append(i)
        i += counts[steps[i]]
    starts = np.array(starts)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen):
        own = np.flatnonzero(chosen == k)
        for j in range(COUNTS[k]):
            words[own] |= padded[starts[own] + j] << np.uint64(j * BITS[k])
    return words


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The n codes that pack_words() put into these words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(words) else 0, np.uint64)
    for k in np.unique(chosen):
        own = np.flatnonzero(chosen == k)
        shifts = (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64)
        out[starts[own][:, None] + np.arange(COUNTS[k])] = (words[own][:, None] >> shifts) & np.uint64((1 << int(BITS[k])) - 1)
    return out[:n]


def encode_segment(ids: np.ndarray) -> bytes:
    """Codebook, block offsets, words and escapes of up to SEGMENT ids."""
    if len(ids) and int(ids.max()) < 1 << 20:
        n_each = np.bincount(ids)
        order = np.argsort(-n_each, kind="stable")[: np.count_nonzero(n_each)]
        values, back = np.arange(len(n_each)), ids
    else:
        values, back, n_each = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-n_each, kind="stable")
    rank = np.zeros(len(values), np.int32)
    rank[order] = np.arange(len(order))
    codes = rank[back]
    big = codes >= ESCAPE
    escapes = codes[big].astype("<u4")
    codes[big] = ESCAPE
    parts = [pack_words(codes[a:b]) for a, b in slices(len(codes), BLOCK)]
    offsets = np.cumsum([0, *map(len, parts)]).astype("<u4")
    head = struct.pack("<4I", len(ids), len(order), len(offsets), len(escapes))
    return head + b"".join(x.tobytes() for x in (values[order].astype("<u4"), offsets, np.concatenate([*parts, np.zeros(0, np.uint64)]).astype("<u8"), escapes))


def decode_segment(raw: bytes) -> np.ndarray:
    n, n_values, n_offsets, n_escapes = struct.unpack_from("<4I", raw)
    at = 16
    book = np.frombuffer(raw, "<u4", n_values, at)
    offsets = np.frombuffer(raw, "<u4", n_offsets, at := at + 4 * n_values)
    words = np.frombuffer(raw, "<u8", int(offsets[-1]), at := at + 4 * n_offsets)
    escapes = np.frombuffer(raw, "<u4", n_escapes, at + 8 * len(words))
    codes = np.concatenate([unpack_words(words[x:y], min(BLOCK, n - BLOCK * i)) for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:]))] or [np.zeros(0, np.uint64)]).astype(np.int64)
    codes[codes == ESCAPE] = escapes
    return book[codes]


class Writer:
    """Streams documents' ids into one file; memory holds one segment and the table of documents."""

    def __init__(self, out):
        self.out, self.waiting, self.n_waiting, self.at, self.segments, self.docs, self.lengths = out, [], 0, 4, [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(raw) // 4)
        self.waiting.append(raw)
        self.n_waiting += len(raw) // 4
        if self.n_waiting >= SEGMENT:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        upto = len(ids) if last else len(ids) // SEGMENT * SEGMENT
        for a, b in slices(upto, SEGMENT):
            raw = encode_segment(ids[a:b])
            self.out.write(raw)
            self.segments.append((self.at, len(raw)))
            self.at += len(raw)
        self.waiting, self.n_waiting = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        rows = pa.RecordBatch.from_arrays([pa.array(self.docs, pa.int64()), pa.array(self.lengths, pa.int64())], ["doc_id", "n_tokens"])
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_batch(rows)
        body = sink.getvalue()
        segments = np.array(self.segments, "<u8").tobytes()
        self.out.write(body + segments + struct.pack("<QQ", len(body), len(self.segments)) + MAGIC)


def read_file(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, its ids as little-endian uint32) in the order written; holds one segment and one document at a time."""
    size = source.size()
    source.seek(size - 20)
    n_body, n_segments = struct.unpack("<QQ", source.read(20)[:16])
    source.seek(size - 20 - 16 * n_segments - n_body)
    table = pa.ipc.open_stream(source.read(n_body)).read_all()
    segments = np.frombuffer(source.read(16 * n_segments), "<u8").reshape(-1, 2)
    held, at, k = b"", 0, 0
    for doc_id, n in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
        parts, missing = [], 4 * n
        while missing:
            if at == len(held):
                source.seek(int(segments[k][0]))
                held, at, k = decode_segment(source.read(int(segments[k][1]))).tobytes(), 0, k + 1
            part = held[at : at + missing]
            parts.append(part)
            at += len(part)
            missing -= len(part)
        yield doc_id, b"".join(parts)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), urlparse(path).path) if urlparse(path).scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _write(batches: Iterable[pa.RecordBatch], vocabulary: str, end: int, folder: str) -> Iterator[pa.RecordBatch]:
    system, base = _at(folder)
    system.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.s8b"
    enc, n_docs, n_ids, first = encoder(vocabulary), 0, 0, None
    with system.open_output_stream(f"{base}/{name}") as out:
        writer = Writer(out)
        for batch in batches:
            for a, b in by_bytes(batch.column(2), TOGETHER):
                part = batch.slice(a, b - a)
                for doc_id, order, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), enc.encode(part.column(2), end)):
                    first = (doc_id, order) if not n_docs else first
                    writer.add(doc_id, raw)
                    n_docs, n_ids = n_docs + 1, n_ids + len(raw) // 4
        writer.close()
    if n_docs:
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first_doc": first[0], "first_order": first[1], "n_docs": n_docs, "n_ids": n_ids}], MANIFEST)
    else:
        system.delete_file(f"{base}/{name}")


MANIFEST = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("first_order", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tokens(docs: DataFrame, vocabulary: str, end: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder`` in ascending doc_id order. Returns the manifest, a row per file
    (path, first_doc, first_order, n_docs, n_ids, start); start counts the ids in the files before."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) rank", "cast(text as string) text")
    ranged = rows.repartitionByRange(partitions(spark), "doc_id", "rank").sortWithinPartitions("doc_id", "rank")
    files = staged(ranged.mapInArrow(lambda it: _write(it, vocabulary, end, folder), "path string, first_doc long, first_order long, n_docs long, n_ids long"), "manifest")
    # A row per file, so this list is as long as the number of files, not of documents.
    have = sorted(files.collect(), key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.first_order))
    starts = [0, *accumulate(r.n_ids for r in have)]
    out = [(*r, s) for r, s in zip(have, starts)]
    return spark.createDataFrame(out, "path string, first_doc long, first_order long, n_docs long, n_ids long, start long")


def _read(batches: Iterable[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, name = _at(path)
            rows: list[tuple] = []
            held = 0
            with system.open_input_file(name) as source:
                for doc_id, raw in read_file(source):
                    rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw), *((raw,) if with_ids else ())))
                    start, held = start + len(raw) // 4, held + len(raw) * with_ids
                    if len(rows) == 5000 or held > 16 << 20:
                        yield _rows(rows, with_ids)
                        rows, held = [], 0
            if rows:
                yield _rows(rows, with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents read back from the files of a manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    n = max(1, min(manifest.count(), 10 * partitions(manifest.sparkSession)))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    spread = manifest.select("path", "start").repartitionByRange(n, F.col("start")) if n > 1 else manifest.select("path", "start")
    return spread.mapInArrow(lambda it: _read(it, with_ids), kind)
