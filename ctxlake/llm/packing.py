"""Best-fit packing of tokenized documents into fixed-length training sequences.

Each task streams its documents. A document longer than a sequence is cut into whole sequences, the first piece taking
what is left over; shorter ones stay whole. The pieces of a few megabytes of texts go, longest first, to bounded-space best fit:
a fixed number of open bins, held in a bitset keyed by free space, so that the tightest bin that still fits is found by
one shift. When one bin too many is open, the fullest closes. Nothing is shuffled and no task holds more than a batch
and its open bins, whatever the size of the corpus; a lost task is simply run again.

Null texts count as empty; an empty text still has its end id. Repeated rows are packed once each. A null doc_id stays
null. Columns other than doc_id and text aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.llm.common import encoder
from ctxlake.llm.words import by_bytes

OPEN_BINS = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Bounded-space online best fit. ``bits`` has bit f set while a bin with f free places is open."""

    def __init__(self, size: int, open_bins: int, first_id: int = 0):
        self.size, self.most, self.next = size, open_bins, first_id
        self.bits, self.bins, self.n_open = 0, [[] for _ in range(size + 1)], 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for an item of 1 to ``size``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = self.bins[free]
            bin_id = stack.pop()
            self.n_open -= 1
            if not stack:
                self.bits &= ~(1 << free)
        else:
            free, bin_id = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            self.bins[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.most:
                self._close_fullest()
        return bin_id, self.size - free

    def _close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        self.bins[free].pop()
        self.n_open -= 1
        if not self.bins[free]:
            self.bits &= ~(1 << free)


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else whole sequences after what is left over."""
    first = n - size * ((n - 1) // size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _pack(batches: Iterable[pa.RecordBatch], vocabulary: str, size: int, end: int, open_bins: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    fit = BestFit(size, open_bins, TaskContext.get().partitionId() << 40)
    enc = encoder(vocabulary)
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for a, b in by_bytes(batch.column(1)):
            rows = []
            for doc_id, ids in zip(doc_ids[a:b], enc.encode(batch.column(1).slice(a, b - a), end)):
                for k, (start, length) in enumerate(pieces(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((length, doc_id, k, start, zlib.crc32(part), bytes(part) if with_ids else None))
            rows.sort(key=lambda r: -r[0])
            places = [fit.place(r[0]) for r in rows]
            columns = [
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
                *(pa.array([r[i] for r in rows], pa.int64()) for i in (3, 0, 4)),
                pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([r[5] for r in rows], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text) with its sequence and its place there.

    vocabulary: a tokenizer file; end: the id after each document; with_ids: add the ids as little-endian uint32."""
    run = lambda batches: _pack(batches, vocabulary, size, end, open_bins, with_ids)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack(with_ids=True): their ids in order. A sequence is bounded by its size."""
    ids = "aggregate(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))"
    return packed.groupBy("sequence_id").agg(F.expr(ids).alias("ids"), F.sum("length").alias("length"))
