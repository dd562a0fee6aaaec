"""Near-duplicates by HyperMinHash.

1. Every document becomes the sorted set of its hashed word shingles, of which only a digest, the size and a HyperMinHash
   sketch are kept: the hashes' leading bits choose one of 256 buckets, and of each bucket's least hash the register
   holds 6 bits of leading-zero count and 10 bits of mantissa. Empty registers borrow from others by a fixed random
   probe order, so that two registers are equal with a chance of the sets' similarity at any set size.
2. Documents with equal sets collapse to their smallest doc_id before anything else is compared.
3. 42 bands of 6 compressed registers give band keys. At similarity 0.8 a pair shares none with a chance of 3e-6.
4. In rounds, each band group compares its members with one leader, then those outside the leader's component with up to
   LEADERS new leaders, and so on until every group's remaining components have been compared in full. Pairs that the
   triangle inequality rules out, by their distances from the first leader, aren't formed. A round's rows grow in
   proportion to the groups, no matter how large they are; no group is gathered and none expands to all pairs.
5. Pairs pass a collision-corrected estimate from the registers (five standard deviations of slack) and are then
   confirmed on full sets of 64-bit hashes, made again from the texts of the two.
6. Components come from min-label propagation with pointer jumping over written tables, never on the driver.

Null or empty texts, and texts without words, have the empty set and are linked with nothing. Texts of fewer words than
a shingle are one shingle. Rows with the same doc_id are one document for links: it is linked by what any of its rows
links. Rows with a null doc_id have no links, a null component and are kept. Other columns aren't read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxlake.llm.columns import unused
from ctxlake.llm.common import fresh, slices, staged, unstage
from ctxlake.llm.words import by_bytes, scramble, shingles

BUCKETS, MANTISSA, ROWS, BANDS, LEADERS, SIGMAS = 256, 10, 6, 42, 64, 5.0
WORDS, PERCENT = 5, 80
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_PROBES = np.stack([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])
_ODD = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 256 registers of 16 bits for each sorted set of hashes; no set may be empty."""
    n = len(sets)
    hashes = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    at = np.repeat(np.arange(n) * BUCKETS, [len(s) for s in sets]) + (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
    rest = hashes[first] << np.uint64(8)
    # frexp of the upper half finds the leading one; a rest below 2**32 is as good as never seen
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 62)
    mantissa = (rest << zeros.astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    registers, filled = np.zeros(n * BUCKETS, np.uint16), np.zeros(n * BUCKETS, bool)
    registers[at[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    filled[at[first]] = True
    # An empty register borrows from the first filled bucket in its own probe order; the donor number makes it a value
    # of its own.
    empty, probe = np.flatnonzero(~filled), 0
    while len(empty):
        donor = _PROBES[empty % BUCKETS, probe]
        found = filled[empty - empty % BUCKETS + donor]
        own, donor = empty[found], donor[found]
        registers[own] = registers[own - own % BUCKETS + donor] ^ (donor * 257).astype(np.uint16)
        empty, probe = empty[~found], probe + 1
    return registers.reshape(n, BUCKETS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A row of 64-bit keys for each row of registers."""
    mixed = (registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _ODD
    return scramble(np.bitwise_xor.reduce(scramble(mixed), axis=2) + np.arange(BANDS, dtype=np.uint64) * _MIX).view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _signed(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    fresh("neardup")
    for batch in batches:
        for a, b in by_bytes(batch.column(1)):
            ids = batch.column(0).slice(a, b - a)
            sets = shingles(batch.column(1).slice(a, b - a), k)
            sizes = [len(s) for s in sets]
            own = [i for i, (n, known) in enumerate(zip(sizes, ids.is_valid().to_pylist())) if n and known]
            sig, sketch, bands = ([None] * len(sets) for _ in range(3))
            for x, y in slices(len(own), 1000):
                registers = sketches([sets[i] for i in own[x:y]])
                for i, r, keys in zip(own[x:y], registers, band_keys(registers)):
                    sig[i], sketch[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), r.tobytes(), keys
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=SIGNED)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of sketches (rows of registers) of sets of these sizes, less the registers that agree by chance."""
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    chance = 0.16991948 * 4 * ratio / (1 + ratio) ** 2 * 2.0**-MANTISSA
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def _near(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each pair the greatest similarity that its estimate leaves possible, or less where the sizes allow less."""
    fresh("neardup")
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, n_a, n_b, s_a, s_b = (batch.column(i) for i in range(6))
        n_a, n_b = n_a.to_numpy(), n_b.to_numpy()
        regs = [np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(-1, BUCKETS) for s in (s_a, s_b)]
        want = percent / 100
        filled = BUCKETS * (1 - np.exp(-np.maximum(n_a, n_b) / BUCKETS))  # borrowed registers tell nothing new
        slack = SIGMAS * np.sqrt(want * (1 - want) / filled)
        most = np.minimum(estimate(*regs, n_a, n_b) + slack, np.minimum(n_a, n_b) / np.maximum(1, np.maximum(n_a, n_b)))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(most, pa.float64())], ["a", "b", "most"])


def _compared(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) with the sizes of their full sets' intersection and union."""
    fresh("neardup")
    last, x = None, None
    for batch in batches:
        firsts = batch.column(2)
        for p, q in by_bytes(batch.column(3)):
            shared, union = [], []
            # Rows come in the order of a, so that each of its texts is taken apart once.
            for i, y in zip(range(p, q), shingles(batch.column(3).slice(p, q - p), k)):
                own = firsts[i].as_py()
                if own != last:
                    last, x = own, shingles(pa.array([own], pa.string()), k)[0]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
                union.append(len(both) - shared[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(p, q - p), batch.column(1).slice(p, q - p), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "shared", "both"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of ``links`` (a, b): the smallest id that can be reached. Labels spread along links
    and jump to their own label's label, so that the number of rounds grows with the logarithm of the longest path."""
    edges = staged(links.selectExpr("a u", "b v").union(links.selectExpr("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), "labels")
    while True:
        around = edges.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        spread = labels.join(around, "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        above = labels.select(F.col("u").alias("l"), F.col("l").alias("jump"))
        new = staged(spread.join(above, "l", "left").select("u", "was", F.least("l", "jump").alias("l")), "labels")
        changed = new.where("was <> l").limit(1).count()
        unstage(labels)
        labels = new.select("u", "l")
        labels._ctxlake_path = new._ctxlake_path
        if not changed:
            unstage(edges)
            return labels.select(F.col("u").alias("id"), F.col("l").alias("component"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links of a similarity of ``percent`` or more between sets of ``words``-word shingles) and kept (doc_id is it)."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    signed = staged(rows.mapInArrow(lambda it: _signed(it, words), "doc_id long, n_shingles long, sig binary, sketch binary, bands array<long>"), "signed")
    have = signed.where("sig is not null")
    classes = staged(have.groupBy("sig").agg(F.min("doc_id").alias("id")), "classes")
    # One row per class: that of its smallest doc_id. A doc_id whose rows differ leads several classes.
    heads = staged(have.join(classes, "sig").where("doc_id = id").dropDuplicates(["sig"]).select("id", "n_shingles", "sketch", "bands"), "heads")
    equal = have.join(classes, "sig").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))

    exploded = heads.select("id", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader")
    members = staged(exploded.join(shared, "key").select("key", "id", "leader").distinct(), "members")
    candidates = members.select("id").distinct()
    # Only documents that share a band have their texts written once more, for the confirmation.
    needed = staged(rows.join(candidates, rows.doc_id == candidates.id, "left_semi").groupBy("doc_id", F.xxhash64("text"), F.octet_length("text")).agg(F.any_value("text").alias("text")).selectExpr("doc_id id", "text"), "texts")
    sizes = staged(heads.join(candidates, "id", "left_semi").select("id", "n_shingles", "sketch"), "sketches")
    unstage(heads)

    def compare(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with least and most, between which their distance lies: equal where full sets were compared."""
        a, b = (sizes.toDF(side, f"n_{side}", f"s_{side}") for side in "ab")
        met = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
        met = staged(met.mapInArrow(lambda it: _near(it, percent), "a long, b long, most double").groupBy("a", "b").agg(F.max("most").alias("most")), "met")
        near = F.col("most") >= percent / 100 - 1e-9
        a, b = (needed.toDF(side, f"h_{side}") for side in "ab")
        full = met.where(near).join(b, "b").join(a, "a").select("a", "b", "h_a", "h_b").mapInArrow(lambda it: _compared(it, words), "a long, b long, shared long, both long")
        # A doc_id with several texts is as near as the nearest of them, but its distances prove nothing.
        exact = full.groupBy("a", "b").agg(F.max(100 * F.col("shared") >= percent * F.col("both")).alias("linked"), F.min(1 - F.col("shared") / F.col("both")).alias("least"), F.max(1 - F.col("shared") / F.col("both")).alias("most"))
        far = met.where(~near).select("a", "b", F.lit(False).alias("linked"), (1 - F.col("most")).alias("least"), F.lit(1.0).alias("most"))
        return staged(exact.union(far), "compared")

    reach = 1 - percent / 100 + 1e-9
    tried = staged(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "tried")
    compared = compare(tried)
    links = compared.where("linked").select("a", "b")
    done = members.selectExpr("key", "leader id").distinct()
    # How far each member is from its group's first leader rules out most other pairs of the group, as distances between
    # sets obey the triangle inequality.
    seen = compared.select(F.col("a").alias("leader"), F.col("b").alias("id"), "least", "most")
    members = staged(members.join(seen, ["leader", "id"], "left").select("key", "id", F.coalesce("least", F.lit(0.0)).alias("least"), F.when(F.col("id") == F.col("leader"), 0.0).otherwise(F.coalesce("most", F.lit(1.0))).alias("most")), "members")
    open_, labels = members, components(links)
    while True:
        now = open_.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        split = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key", "low")
        left = staged(now.join(split, "key").select("key", "id", "least", "most", "c", "low"), "open")
        # The component with the smallest label needs no leaders: all others are compared with it.
        waiting = left.where("c <> low").join(done, ["key", "id"], "left_anti")
        ranked = waiting.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= LEADERS)
        leaders = staged(ranked.select("key", F.col("id").alias("leader"), F.col("c").alias("own"), F.col("least").alias("own_least"), F.col("most").alias("own_most")), "leaders")
        if not leaders.limit(1).count():
            break
        possible = (F.col("least") - F.col("own_most") <= reach) & (F.col("own_least") - F.col("most") <= reach)
        pairs = left.join(leaders, "key").where((F.col("c") != F.col("own")) & possible).select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
        new = staged(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        more = compare(new).where("linked").select("a", "b")
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)
        tried = tried.union(new)
        done = done.union(leaders.selectExpr("key", "leader id"))
        open_ = left.select("key", "id", "least", "most")
    everything = components(links.union(equal))
    out = signed.join(everything.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.col("component").isNull() | (F.col("component") == F.col("doc_id"))).alias("kept"))


def drop_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all its columns and one document of each group: that with the smallest doc_id. Rows of one doc_id are
    one document, of which one row stays: that of the smallest digest of its text, then of its other columns. Rows with a
    null doc_id stay."""
    kept = near_duplicates(docs, words, percent).where("kept").select("doc_id").distinct()
    own, turn = unused(docs, "kept"), unused(docs, "turn")
    inside = docs.join(kept.withColumnRenamed("doc_id", own), F.col("doc_id").cast("long") == F.col(own), "left_semi")
    rest = F.to_json(F.struct(*(c for c in docs.columns if c != "text")))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", rest))
    return inside.withColumn(turn, first).where(F.col(turn) == 1).drop(turn).unionByName(docs.where("doc_id is null"))
