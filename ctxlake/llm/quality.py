"""Quality classifier: supervised subword embeddings.

A word is the mean of learned vectors: one for the word and one for each of its character 2- to 4-grams, over bytes with
marks at both ends. Every two words in a row are a word 2-gram with a vector of its own; those of a word with itself also
back off to one vector that all such 2-grams share, as most of them were never seen in training. All are hashed into one
table. A text is the mean of its words and word 2-grams, and a softmax layer over it gives the score. Vectors and layer are trained
together by mini-batch stochastic gradient descent in numpy, on the driver, on a bounded sample of labelled texts:
MOST_ROWS rows of the smallest hashes of their ids, of which texts are taken while MOST_CHARS characters suffice; one that
no longer fits is left out and those after it still count. That bound holds at any size of the corpus; scoring covers all
rows and whole texts.

For scoring, layer and vectors fold into one number per table row (the difference of the two classes), which is all that
goes to the executors (2 MB). N-grams are hashed and looked up with numpy over whole pieces of a batch, so no cache of
words is kept. Seeds are fixed and the sample is sorted, so training twice gives the same model.

Null and empty texts score by the layer's bias alone. Labels that are null or other than 0 and 1 aren't learned from, nor
are labels of documents that don't exist; where a doc_id has several labels its largest counts, and of several texts
each. A null doc_id can't be labelled and is scored; it counts as not held out. Without any labels the score is 0.5.
Columns of ``docs`` other than doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlake.llm import words as W
from ctxlake.llm.common import fresh

TABLE_BITS, DIM, EPOCHS, LEAST_STEPS, RATE, BATCH, SEED = 19, 8, 6, 400, 4.0, 64, 11
MOST_ROWS, MOST_CHARS, FOLDS, THRESHOLD = 5000, 24_000_000, 5, 0.3
#: The word 2-gram that stands for any word and itself.
ITSELF = np.uint64(0x5851F42D4C957F2D)
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one mark before each and one at the end, and where the marks are."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(at[-1]) + 1, 32, np.uint8)
    chars = np.ones(len(out), bool)
    chars[at] = False
    out[chars] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return out, at


def grams(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Table rows of the 2-, 3- and 4-grams that begin at each place of marked words, and which lie in one word."""
    mark = text == 32
    x, ok = text.astype(np.uint32), np.ones(len(text), bool)
    for n in (2, 3, 4):
        m = len(text) - n + 1
        if m <= 0:
            return
        x = x[:m] | (text[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1)))
        if n > 2:
            ok = ok[:m] & ~mark[n - 2 : n - 2 + m]
        h = (x ^ (x >> np.uint32(15))) * _ODD[n - 1]
        yield (h ^ (h >> np.uint32(13))) * _ODD[0] >> np.uint32(32 - TABLE_BITS), ok[:m]


def rows_of(hashes: np.ndarray) -> np.ndarray:
    return (W.scramble(hashes) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def doubled(h: np.ndarray, n_words: np.ndarray, before: np.uint64 | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word 2-grams that lie in one text and the text of each; before: the word before the first."""
    text = np.repeat(np.arange(len(n_words)), n_words)
    if before is not None:
        h, text = np.concatenate([[before], h]), np.concatenate([[0], text])
    same = text[1:] == text[:-1]
    both = (h[:-1] * np.uint64(0x9FB21C651E98DF25) + (h[1:] ^ (h[1:] >> np.uint64(32))))[same]
    again, text = (h[1:] == h[:-1])[same], text[1:][same]
    return np.concatenate([both, np.full(int(again.sum()), ITSELF)]), np.concatenate([text, text[again]])


def _parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By pieces: first row, marked words, their marks, words' hashes and text, word 2-grams and their text."""
    data, offsets = W.raw(texts)
    last: tuple[int, np.uint64] | None = None
    for row, part, at in W.in_pieces(data, offsets):
        starts, ends, n = W.cut(part, at)
        if not len(starts):
            continue
        h = W.hashes(part, starts, ends)
        two, two_text = doubled(h, n, last[1] if last and last[0] == row else None)
        if len(n) == 1:
            last = (row, h[-1])
        yield row, *marked(part, starts, ends), h, np.repeat(np.arange(len(n)), n), two, two_text


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The chance of label 1 of each text."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for row, text, at, h, of, two, two_of in _parts(texts):
        each = np.zeros(len(text), np.float32)
        for rows, ok in grams(text):
            each[: len(rows)] += np.where(ok, weights[rows], np.float32(0))
        size = np.diff(at) - 1
        word = (np.add.reduceat(each[:-1].astype(np.float64), at[:-1]) + weights[rows_of(h)]) / (3 * size + 1)
        many = int(of[-1]) + 1
        here = slice(row, row + many)
        total[here] += np.bincount(of, word, many) + np.bincount(two_of, weights[rows_of(two)], many)
        n[here] += np.bincount(of, minlength=many) + np.bincount(two_of, minlength=many)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30)))


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text as distinct table rows and their weights, which add up to 1."""
    keys, weights, n = [], [], 0
    for _, marks, at, h, of, two, _ in _parts(pa.array([text], pa.string())):
        share = 1 / (3 * (np.diff(at) - 1) + 1)
        owner = np.repeat(np.arange(len(h)), np.diff(at))
        for rows, ok in grams(marks):
            ok[len(owner) :] = False
            keys.append(rows[ok])
            weights.append(share[owner[: len(rows)][ok[: len(owner)]]])
        keys += [rows_of(h), rows_of(two)]
        weights += [share, np.ones(len(two))]
        n += len(h) + len(two)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    key, weight = np.concatenate(keys).astype(np.int64), np.concatenate(weights)
    if len(key) < 1 << 15:
        rows, back = np.unique(key, return_inverse=True)
        full = np.bincount(back, weight)
    else:
        full = np.bincount(key, weight, 1 << TABLE_BITS)
        rows = np.flatnonzero(full)
        full = full[rows]
    return rows.astype(np.int32), (full / n).astype(np.float32)


def train(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    """(difference of the classes' softmax inputs per table row, bias)."""
    rng = np.random.default_rng(SEED)
    size = 1 << TABLE_BITS
    docs = [profile(t) for t in texts]
    y = np.array(labels, np.float32)
    rate1 = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (DIM, size)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([np.log(1 - rate1), np.log(rate1)], np.float32)
    places = np.zeros(size, np.int32)
    per_epoch = max(1, -(-len(docs) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch)) if docs else 0
    total_steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            rate = RATE * (1 - step / total_steps)
            step += 1
            rows = np.concatenate([docs[i][0] for i in part])
            weights = np.concatenate([docs[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            means = np.stack([np.bincount(doc, v[rows] * weights, len(part)) for v in vectors], 1).astype(np.float32)
            z = means @ layer + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part].astype(int)] -= 1
            back = p @ layer.T
            layer -= 0.1 * rate / len(part) * (means.T @ p)
            bias -= 0.02 * rate * p.mean(axis=0)
            # Words spread a text's weight thin, so vectors take the step per document, not per batch mean.
            own = np.flatnonzero(np.bincount(rows, minlength=size))
            places[own] = np.arange(len(own))
            where = places[rows]
            for d in range(DIM):
                vectors[d, own] -= (rate * np.bincount(where, weights * back[doc, d], len(own))).astype(np.float32)
    return ((layer[:, 1] - layer[:, 0]) @ vectors).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: int = 0, folds: int = FOLDS) -> tuple[np.ndarray, float]:
    """Train on labelled rows of ``docs`` (doc_id, text) whose crc32(doc_id as text) mod ``folds`` isn't ``held_out``."""
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    truth = truth.groupBy("doc_id").agg(F.max("y").alias("y")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out)
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Only lengths and digests of candidate texts meet in one place; the chosen ids are MOST_ROWS at most, so they may be
    # broadcast, and of equal texts of an id one counts.
    own = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("text").alias("digest"), F.xxhash64("doc_id").alias("h"))
    listed = own.distinct().orderBy("h", "doc_id", "digest").limit(2 * MOST_ROWS).collect()
    taken, left = [], MOST_CHARS
    for r in sorted(listed, key=lambda r: (r.h, r.doc_id, r.digest)):
        if r.n <= left:
            taken.append((r.doc_id, r.digest, r.y))
            left -= r.n
    if not taken:
        return train([], [])
    picks = docs.sparkSession.createDataFrame(taken, "doc_id long, digest long, y int")
    found = rows.withColumn("digest", F.xxhash64("text")).join(F.broadcast(picks), ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.any_value("text").alias("text"), F.any_value("y").alias("y")).collect()
    place = {(i, d): k for k, (i, d, _) in enumerate(taken)}
    found.sort(key=lambda r: place[r.doc_id, r.digest])
    return train([r.text for r in found], [r.y for r in found])


def score(text: Column, model: tuple[np.ndarray, float], spark) -> Column:
    """The chance of label 1 of a text column. Only texts go to Python and only scores come back."""
    sent = spark.sparkContext.broadcast((model[0], model[1]))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fresh("quality")
        for texts in batches:
            yield pa.array(scores(texts, *sent.value), pa.float64())

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = fit(docs, labels)
    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), score(F.col("text").cast("string"), model, docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, without the rows that the classifier rejects."""
    return docs.where(score(F.col("text").cast("string"), fit(docs, labels), docs.sparkSession) >= threshold)
