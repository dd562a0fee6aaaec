"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded number of words of one task's documents. Its text is the documents' words as numbers of the test
set's vocabulary; a word outside it can't be in a match, so that each stretch of such words, and each document's end, is
one separator. Stretches shorter than the shortest test phrase are left out too. Over that text the shard has a suffix
order, a Burrows-Wheeler transform in a wavelet matrix for its ranks, and sampled suffix positions. All test phrases run
through backward search together, level by level of the matrix; occurrences are located by walking to the next sampled
position. Spans of words are merged per document.

Suffixes are sorted in full by prefix doubling of which each round only sorts what is still tied, so that walks through
the index are exact also where thousands of copies lie in one shard.

The test set goes to the tasks in blocks of at most BLOCK_BYTES of text, one after the other, so that neither a broadcast
nor the driver's share grows with it; documents are indexed once per block and the blocks' spans are merged. Nothing else is shuffled.

Null texts have no words; an item without words has no phrase and is never found. Repeated documents are judged each on
its own, repeated item_ids count once. Null item_ids are left out, a null doc_id stays null. Other columns aren't read.
An empty test set leaves all documents clean; an empty documents table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.llm.columns import unused
from ctxlake.llm.common import fresh, staged, utf8
from ctxlake.llm.words import by_bytes

#: 0-9, a-z and all bytes of non-ASCII characters stay, A-Z become a-z, everything else parts words.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WINDOW, ITEMS, SHARD_WORDS, BLOCK_BYTES, SAMPLE = 8, 2, 4_000_000, 8 << 20, 8


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of the text in the order of its suffixes; text ends with its only 0."""
    n = len(text)
    order = np.argsort(text, kind="stable").astype(np.int64)
    ranks = np.empty(n, np.int64)
    heads = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    ranks[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    step = 1
    tied = np.arange(n)  # places of the order that are not yet settled
    while True:
        alone = heads & np.concatenate([heads[1:], [True]])
        tied, heads = tied[~alone], heads[~alone]
        if not len(tied):
            return order
        at = order[tied]
        group = np.cumsum(heads)
        then = ranks[np.minimum(at + step, n - 1)]
        by = np.lexsort((then, group))
        at, then, group = at[by], then[by], group[by]
        order[tied] = at
        heads = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        ranks[at] = tied[np.flatnonzero(heads)][np.cumsum(heads) - 1]
        step *= 2


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols, for whole arrays of c and i at a time."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros_like(i)
        for k in range(self.bits):
            bit = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[low], ones[i]
            low, i = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, i - b)
        return i - low


class FMIndex:
    """Counts and locates phrases in a text of numbers from 1 on; 0 is the end, 1 the separator."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE):
        text = np.concatenate([text, [0]]).astype(np.int32)
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))]).astype(np.int64)
        self.matrix = WaveletMatrix(self.bwt, max(1, int(alphabet).bit_length()))
        marked = order % sample == 0
        self.marked, self.places = marked, order[marked]
        self.nth = np.cumsum(marked) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix order that start with each phrase; phrases are rows, filled up at the right."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((k < lengths) & (lo < hi))
            c = phrases[on, k].astype(np.int64)
            first = self.before[c]
            lo[on], hi[on] = first + self.matrix.rank(c, lo[on]), first + self.matrix.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            hit = self.marked[at]
            out[left[hit]] = self.places[self.nth[at[hit]]] + steps
            left, at = left[~hit], at[~hit]
            c = self.bwt[at].astype(np.int64)
            rows[left] = self.before[c] + self.matrix.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The test set's vocabulary and its distinct phrases, with the items that have each."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item_id)
        self.keys = list(owners)
        self.owners = [sorted(o) for o in owners.values()]
        self.lengths = np.array([len(k) for k in self.keys], np.int64)
        self.shortest = int(self.lengths.min()) if self.keys else 0
        self.rows = np.zeros((len(self.keys), window), np.int64)
        for i, k in enumerate(self.keys):
            self.rows[i, : len(k)] = k


def search_shard(texts: list[np.ndarray], phrases: Phrases) -> list[tuple[np.ndarray, set[int]]]:
    """texts: a document's words as vocabulary numbers, 0 for others. Per document: merged spans of words, as rows of
    start and end, and the items found in it."""
    empty = np.zeros((0, 2), np.int64)
    out: list[tuple[np.ndarray, set[int]]] = [(empty, set()) for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1)  # a separator after each document
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    for t, e in zip(texts, ends.tolist()):
        flat[e - 1 - len(t) : e - 1] = t
    known = flat > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    begin, stop = turns[::2], turns[1::2]
    long = stop - begin >= phrases.shortest
    begin, stop = begin[long], stop[long]
    if not len(begin) or not phrases.keys:
        return out
    size = stop - begin + 1
    upto = np.cumsum(size)
    source = np.arange(int(upto[-1])) - np.repeat(upto - size, size) + np.repeat(begin, size)  # where in flat each symbol was
    text = flat[source]
    text[upto - 1] = 1
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.rows, phrases.lengths)
    n = hi - lo
    if not n.any():
        return out
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    at = source[index.locate(rows)]
    doc = np.searchsorted(ends, at, side="right")
    start = at - (ends[doc] - lengths[doc] - 1)
    pairs = np.unique(doc * len(phrases.keys) + which)
    for d, w in zip((pairs // len(phrases.keys)).tolist(), (pairs % len(phrases.keys)).tolist()):
        out[d][1].update(phrases.owners[w])
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], (start + phrases.lengths[which])[by]
    wide = int(lengths.max()) + 1
    reach = np.maximum.accumulate(end + doc * wide)
    new = np.concatenate([[True], (start + doc * wide)[1:] > reach[:-1]])
    firsts = np.flatnonzero(new)
    lasts = np.concatenate([firsts[1:], [len(new)]]) - 1
    spans = np.stack([start[firsts], reach[lasts] - doc[firsts] * wide], 1)
    edges = np.searchsorted(doc[firsts], np.arange(len(texts) + 1))
    for d in np.unique(doc):
        out[d] = (spans[edges[d] : edges[d + 1]], out[d][1])
    return out


FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])
FOUND_SQL = "row long, doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<long>"


def _scan(batches: Iterable[pa.RecordBatch], items: list[tuple[int, str | None]], window: int) -> Iterator[pa.RecordBatch]:
    fresh("decontam")
    phrases = Phrases(items, window)
    number = phrases.vocabulary.get
    held: list[tuple] = []
    texts: list[np.ndarray] = []
    total = 0
    for batch in batches:
        for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            ws = words(text)
            ids = np.fromiter((number(w, 0) for w in ws), np.int32, len(ws))
            held.append((row, doc_id, len(ws)))
            texts.append(ids)
            total += len(ws)
            if total >= SHARD_WORDS:
                yield _found(held, search_shard(texts, phrases))
                held, texts, total = [], [], 0
    if held:
        yield _found(held, search_shard(texts, phrases))


def _found(held: list[tuple], results: list[tuple[np.ndarray, set[int]]]) -> pa.RecordBatch:
    spans = [[{"start": a, "end": b} for a, b in s.tolist()] for s, _ in results]
    columns = [*map(list, zip(*held)), spans, [sorted(i) for _, i in results]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The test set in blocks of bounded size. Rows stream to the driver partition by partition."""
    block: list[tuple[int, str | None]] = []
    size = 0
    for r in benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(utf8(r.text))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_words, spans (merged ranges of word numbers that lie in an occurrence
    of a phrase of the test set) and items (ids of the items with such phrases). ``row`` numbers the rows."""
    rows = docs.selectExpr("monotonically_increasing_id() row", "cast(doc_id as long) doc_id", "cast(text as string) text")
    blocks = _blocks(benchmark)
    items, second = next(blocks, []), next(blocks, None)
    if second is None:
        return rows.mapInArrow(lambda it: _scan(it, items, window), FOUND_SQL)
    return _over_blocks(rows, chain([items, second], blocks), window)


def _over_blocks(rows: DataFrame, blocks: Iterable[list[tuple[int, str | None]]], window: int) -> DataFrame:
    """find_overlaps() one block after the other, each written before the next is read, so that the driver and the tasks
    hold one at a time."""
    kept = staged(rows, "decontam")  # row numbers must be the same in each pass
    found = None
    for items in blocks:
        part = staged(kept.mapInArrow(lambda it, items=items: _scan(it, items, window), FOUND_SQL), "found")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("spans", F.expr(MERGE))


#: Merges sorted ranges.
MERGE = """aggregate(spans, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, s) ->
  if(size(acc) > 0 and element_at(acc, -1).end >= s.start,
     concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))),
     concat(acc, array(s))))"""


def judge(found: DataFrame, least_items: int = ITEMS) -> DataFrame:
    """The digest columns of find_overlaps()."""
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.expr("sha2(array_join(array_sort(transform(items, i -> cast(i as string))), ','), 256)").alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


JUDGED = pa.struct([("n_items", pa.int64()), ("text", pa.string())])


def _cut(batches: Iterable[pa.Array], items: list[tuple[int, str | None]], window: int) -> Iterator[pa.Array]:
    """Per text how many items it has, and the text without their spans, null where it stays as it is."""
    fresh("decontam")
    phrases = Phrases(items, window)
    number = phrases.vocabulary.get
    for texts in batches:
        n_items, cut = [], []
        for a, b in by_bytes(texts, 4 * SHARD_WORDS):
            part = texts.slice(a, b - a).to_pylist()
            shard = []
            for text in part:
                ws = words(text)
                shard.append(np.fromiter((number(w, 0) for w in ws), np.int32, len(ws)))
            for text, (spans, found) in zip(part, search_shard(shard, phrases)):
                n_items.append(len(found))
                cut.append(without(text, spans) if len(spans) else None)
        yield pa.StructArray.from_arrays([pa.array(n_items, pa.int64()), pa.array(cut, pa.string())], fields=list(JUDGED))


def _cut_spans(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches without their last column, the spans, which are cut from the texts."""
    for batch in batches:
        texts = [without(text, np.array([(s["start"], s["end"]) for s in spans])) if spans else text for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
        out = batch.select(batch.schema.names[:-1])
        yield out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))


def without(text: str, spans: np.ndarray) -> str:
    """The text without these ranges of words; what stands between two words of a range goes with them."""
    raw = utf8(text)
    plain = raw.translate(WORD_BYTES)
    inside = np.frombuffer(plain, np.uint8) != 32
    turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, stop = turns[::2], turns[1::2]
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(raw[at : begin[a]])
        at = int(stop[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = ITEMS) -> DataFrame:
    """``docs`` with all its columns, without the contaminated documents (phrases of ``least_items`` items or more); the
    merged spans of other hits, over all blocks, are cut from the texts, and n_chars, where there is such a column, counted again."""
    blocks, at = _blocks(benchmark), docs.columns.index("text")
    items, second = next(blocks, []), next(blocks, None)
    if second is not None:  # items add up and spans merge over blocks, so the texts are cut once, at the end
        row, cut = unused(docs, "row"), unused(docs, "spans")
        rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "decontam")
        found = _over_blocks(rows.select(F.col(row).alias("row"), F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")), chain([items, second], blocks), window)
        mild = found.where(F.size("items") < least_items).select(F.col("doc_id").alias(row), F.col("spans").alias(cut))
        marked = rows.join(mild, row).select(*docs.columns, cut)
        out = marked.mapInArrow(lambda it: _cut_spans(it, at), docs.schema)
    elif items:

        @F.arrow_udf("n_items long, text string")
        def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from _cut(batches, items, window)

        # Only texts go to Python and only changed ones come back; not deterministic, so that it runs once.
        seen = unused(docs, "seen")
        judged_docs = docs.withColumn(seen, judged.asNondeterministic()(F.col("text"))).where(F.col(seen)["n_items"] < least_items)
        out = judged_docs.select(*(F.coalesce(F.col(seen)["text"], "text").alias(c) if c == "text" else F.col(c) for c in docs.columns))
    else:
        out = docs
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
