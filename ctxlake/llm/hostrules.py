"""Quality rules per text, then a verdict per host.

The base rules fail a text with too few words or too many words in repeated three-word windows. Failures are added up per
host (map-side first, so that a host with a third of all rows shuffles a few rows), and a beta prior is fitted to the
hosts' rates by moments, each host weighing the same. A host's rate is its posterior mean, so that a host with few
documents stays near the usual rate. Documents of a host go as a whole where most of the host's documents fail beyond
reasonable doubt: where its posterior leaves a chance of 5 % at most (by the normal approximation) for a rate of ``most``
or less. A host that merely fails more often than others keeps its clean documents.

Null texts have no words, so they fail. A null host is a host of its own. Repeated rows count each. A null doc_id stays
null. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.llm.common import fresh, join_hot, staged, utf8

MIN_WORDS, REPEAT_PERCENT, MOST, TAIL = 50, 50, 0.5, 1.645
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
FACTS = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))])


def facts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = utf8(text)
    words = raw.split()
    joined = b"".join(words)
    word_chars = len(joined) - (0 if joined.isascii() else len(joined) - len(joined.translate(None, _CONTINUED)))
    n_symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    n_dup_lines = 0
    if len(lines) > 1:
        own = [line for line in lines if line.strip()]
        n_dup_lines = len(own) - len(set(own))
    return len(words), word_chars, n_symbols, n_dup_lines, repeated(words)


def repeated(words: list[bytes]) -> int:
    """How many words lie in a three-word window that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, c in Counter(windows).items() if c > 1}
    inside = bytearray(n)
    for i, w in enumerate(windows):
        if w in often:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh("hostrules")
    for batch in batches:
        columns = list(zip(*map(facts, batch.column(2).to_pylist()))) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], schema=FACTS)


def hosts(rows: DataFrame) -> DataFrame:
    """(host, n, failed, rate, floor) of ``rows`` (host, base_failed): failure rates per host, shrunk towards all hosts',
    and the posterior's lower 5 % quantile."""
    counts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    # One row. Moments of the hosts' rates; their spread beyond the sampling noise sets the prior's weight.
    m = counts.agg(F.avg(F.col("failed") / F.col("n")).alias("mean"), F.var_pop(F.col("failed") / F.col("n")).alias("spread"), F.avg(1 / F.col("n")).alias("noise"))
    own = F.greatest(F.lit(1e-9), F.col("spread") - F.col("mean") * (1 - F.col("mean")) * F.col("noise"))
    weight = F.least(F.lit(1e6), F.greatest(F.lit(2.0), F.col("mean") * (1 - F.col("mean")) / own - 1))
    prior = m.select("mean", weight.alias("weight"))
    shrunk = counts.crossJoin(F.broadcast(prior)).withColumn("rate", (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight")))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    return shrunk.select("host", "n", "failed", "rate", (F.col("rate") - TAIL * deviation).alias("floor"))


def apply_rules(docs: DataFrame, host_col: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, most: float = MOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and the host's column): the counts, base_failed, kept, and the host's
    shrunk rate and verdict (drop or keep)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_facts, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = staged(counted.withColumn("base_failed", failed).withColumn("key", F.coalesce("host", F.lit("\0"))), "facts")
    rates = staged(hosts(judged.select(F.col("key").alias("host"), "base_failed")), "hosts")
    out = join_hot(judged, rates.select(F.col("host").alias("key"), "n", "rate", "floor"), "key", "n")
    verdict = F.when(F.col("floor") > most, "drop").otherwise("keep")
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("floor") <= most)).alias("kept"), F.round("rate", 9).alias("host_rate"), verdict.alias("host_verdict"))
