"""A text store as tables, and ranked retrieval from it.

Documents are rows (id, source, bytes, chunk_count, created_at, content_hash, path, expires_at, content_kind), chunks are
rows (doc_id, idx, body). Both are plain DataFrames, so any Spark sink keeps them; ids follow from source and content, so
that indexing again changes nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ctxlake.functions import text as T
from ctxlake.functions.porter import stem
from ctxlake.operators.search import CHUNK, RRF_K, chunked
from ctxlake.sources.scratch import staged

OFFLOAD_BYTES = 102_400
DOCS = "id string, source string, bytes long, chunk_count long, created_at long, content_hash string, path string, expires_at long, content_kind string"


def expiry(created: str = "created_at", ttl: str = "ttl_ms", expires: str = "expires_at", now: str = "cast(null as bigint)") -> Column:
    """An explicit time, else a positive time to live after ``now`` or the creation; a time to live of 0 means never."""
    return F.expr(f"case when {ttl} = 0 then null when {expires} is not null then {expires} when {ttl} > 0 then coalesce({now}, {created}) + cast(floor({ttl}) as bigint) end")


def index(docs: DataFrame, known: DataFrame | None = None, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(new documents, their chunks) of ``docs`` (source, content and, if there, created_at, path, ttl_ms, expires_at,
    content_kind). Repeated ones count once and those whose id is ``known`` (id) are left out."""
    have = set(docs.columns)
    extra = {"created_at": "long", "path": "string", "ttl_ms": "double", "expires_at": "long", "content_kind": "string"}
    rows = docs.select("source", "content", *(F.col(c).cast(t).alias(c) if c in have else F.lit(0 if c == "created_at" else None).cast(t).alias(c) for c, t in extra.items()))
    rows = rows.withColumn("id", T.doc_id(F.col("source"), F.col("content"))).dropDuplicates(["id"])
    rows = staged(rows if known is None else rows.join(known.select("id"), "id", "left_anti"), "indexed")
    chunks = staged(chunked(rows.select(F.col("id").alias("doc_id"), F.col("content").alias("text")), size), "chunks")
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count")).withColumnRenamed("doc_id", "id")
    kind = F.coalesce("content_kind", T.content_kind(F.col("content")))
    new = rows.join(counts, "id", "left").select(
        "id", "source", F.octet_length("content").cast("long").alias("bytes"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), "created_at",
        F.sha2("content", 256).alias("content_hash"), "path", expiry().alias("expires_at"), kind.alias("content_kind"),
    )
    return new, chunks


def offload(docs: DataFrame, threshold: int = OFFLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(small ones, returned inline; large ones, to be indexed), by bytes of content."""
    size = F.octet_length("content")
    return docs.where(size <= threshold), docs.where(size > threshold)


def purge(docs: DataFrame, chunks: DataFrame, doc_id: str | None = None, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without one document, without those that expired by ``now``, or, with neither, none at all."""
    if now is not None:
        gone = docs.where(F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)).select("id")
    else:
        gone = docs.where(F.col("id") == doc_id if doc_id is not None else F.lit(True)).select("id")
    return docs.join(gone, "id", "left_anti"), chunks.join(gone.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")


def report(docs: DataFrame, now: int = 0) -> DataFrame:
    """One row per content kind and one (kind null) of all: documents, bytes, chunks, estimated tokens, and how many have
    expired, have a path or have an expiry."""
    expired, timed, tracked = F.count_if(F.col("expires_at") <= now), F.count_if(F.col("expires_at").isNotNull()), F.count_if(F.coalesce("path", F.lit("")) != "")
    size = F.coalesce(F.sum("bytes"), F.lit(0))
    sums = [F.count("*").alias("docs"), size.alias("bytes"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.ceil(size / 4).cast("long").alias("tokens"), expired.alias("expired"), tracked.alias("path_tracked"), timed.alias("ttl_tracked")]
    return docs.withColumn("kind", F.coalesce("content_kind", F.lit("unknown"))).rollup("kind").agg(*sums)


def healthy(docs: DataFrame, chunks: DataFrame) -> bool:
    """The tables have their columns, ids are unique, and every document has the chunks that it counts."""
    if {c.split(" ")[0] for c in DOCS.split(", ")} - set(docs.columns) or {"doc_id", "idx", "body"} - set(chunks.columns):
        return False
    twice = docs.groupBy("id").count().where("count > 1").limit(1).count()
    counted = chunks.groupBy("doc_id").count()
    off = docs.join(counted, docs.id == counted.doc_id, "full").where("id is null or coalesce(count, 0) <> chunk_count").limit(1).count()
    return not twice and not off


def migrated(docs: DataFrame) -> DataFrame:
    """Documents of an older layout with the columns that have been added since, null."""
    return docs.unionByName(docs.sparkSession.createDataFrame([], DOCS), allowMissingColumns=True)


# --- views


@F.arrow_udf(StringType())
def _stems(texts: pa.Array) -> pa.Array:
    """Stems of a text's words, each between bars."""
    return pa.array(["" if t is None else "".join(f"|{stem(w)}|" for w in re.findall(r"[^\W_]+", t.lower())) for t in texts.to_pylist()], pa.string())


def significant(query: str) -> list[str]:
    """The words of a query that aren't stopwords; if all are, all."""
    words = T.words_of(query)
    return [w for w in words if w not in T.STOPWORDS] or words


def stemmed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with their stems and how many these are; written once for any number of queries."""
    rows = chunks.withColumn("stems", _stems("body"))
    return staged(rows.withColumn("n_stems", ((F.length("stems") - F.length(F.replace("stems", F.lit("|"), F.lit("")))) / 2).cast("long")), "stems")


def keyword_view(stems: DataFrame, query: str, pool: int) -> DataFrame:
    """(doc_id, idx, rank) of stemmed() chunks that have all significant words, by BM25. A word with an underscore is a
    phrase of its parts."""
    phrases = list(dict.fromkeys("".join(f"|{stem(p)}|" for p in re.findall(r"[^\W_]+", w)) for w in significant(query)))
    phrases = [p for p in phrases if p]
    if not phrases:
        return stems.select("doc_id", "idx", F.lit(1).alias("rank")).limit(0)
    has = [F.contains("stems", F.lit(p)) for p in phrases]
    facts = [F.count("*"), F.coalesce(F.avg("n_stems"), F.lit(0.0)), *map(F.count_if, has)]
    n, words, *df = stems.agg(F.array(*(f.cast("double") for f in facts)).alias("facts")).first().facts
    score = F.lit(0.0)
    for p, k in zip(phrases, df):
        weight = math.log((n - k + 0.5) / (k + 0.5)) if k else 0.0
        tf = (F.length("stems") - F.length(F.replace("stems", F.lit(p), F.lit("")))) / len(p)
        score = score + (weight if weight > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("n_stems") / (words or 1.0)))
    hits = stems
    for h in has:
        hits = hits.where(h)
    return _numbered(hits.select("doc_id", "idx", score.alias("s")).orderBy(F.desc("s"), "doc_id", "idx").limit(pool), F.desc("s"))


def substring_view(chunks: DataFrame, query: str, pool: int) -> DataFrame:
    """(doc_id, idx, rank) of chunks that hold the whole query in any case; queries under three characters find none."""
    needle = query.strip().lower()
    if len(needle) < 3:
        return chunks.select("doc_id", "idx", F.lit(1).alias("rank")).limit(0)
    low = F.lower("body")
    count = (F.length(low) - F.length(F.replace(low, F.lit(needle), F.lit("")))) / len(needle)
    hits = chunks.where(F.contains(low, F.lit(needle))).select("doc_id", "idx", (count / F.length("body")).alias("s"))
    return _numbered(hits.orderBy(F.desc("s"), "doc_id", "idx").limit(pool), F.desc("s"))


def _numbered(top: DataFrame, *by: Column) -> DataFrame:
    """Ranks of a list that a limit bounds."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*by, "doc_id", "idx"))).select("doc_id", "idx", "rank")


def window(words: list[str], body: str = "body") -> Column:
    """Characters from the first to the last of the words' first occurrences, null if one is missing."""
    at = [F.instr(F.lower(body), w) for w in words]
    ends = [a + len(w) for a, w in zip(at, words)]
    least = F.least(*at) if len(at) > 1 else at[0]
    most = F.greatest(*ends) if len(ends) > 1 else ends[0]
    return F.when(least > 0, most - least)


def snippet(words: list[str], body: str = "body", around: int = 12) -> Column:
    """About ``around`` words from the first hit on, hits in brackets, with dots where text is left out."""
    listed = F.filter(F.split(F.regexp_replace(body, r"\s+", " "), " "), lambda w: w != "")
    hit = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")).isin(*words) if words else F.lit(False)
    marked = F.transform(listed, lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    first = F.coalesce(F.nullif(F.array_position(F.transform(listed, hit), True), F.lit(0)), F.lit(1)).cast("int")
    begin = F.greatest(F.lit(1), first - around // 3)
    text = F.array_join(F.slice(marked, begin, around), " ")
    return F.concat(F.when(begin > 1, "…").otherwise(""), text, F.when(F.size(listed) >= begin + around, "…").otherwise(""))


def plain_snippet(body: str = "body") -> Column:
    return F.substring(F.regexp_replace(body, r"\s+", " "), 1, 160)


def search_once(docs: DataFrame, stems: DataFrame, query: str, limit: int = 5, doc_id: str | None = None, content: str | None = None, proximity: bool = True) -> DataFrame:
    """(doc_id, idx, body, score, rank) of one query: both views fused by reciprocal ranks, then raised where the source
    names a word of it and where its words stand close; chunks of other kinds than ``content`` leave after that."""
    if doc_id is not None:
        stems = stems.where(F.col("doc_id") == doc_id)
    words = [w for w in T.words_of(query) if w not in T.STOPWORDS]
    pool = max(4 * limit, 20)
    both = keyword_view(stems, query, pool).unionByName(substring_view(stems, query, pool))
    fused = both.groupBy("doc_id", "idx").agg(F.sum(1 / (F.lit(float(RRF_K)) + F.col("rank"))).alias("score"))
    # Two pools bound the fused list, so it may be broadcast.
    rows = stems.select("doc_id", "idx", "body").join(F.broadcast(fused), ["doc_id", "idx"])
    if words:
        named = docs.select(F.col("id").alias("doc_id"), F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("source"), w)).alias("named"))
        rows = rows.join(named, "doc_id", "left").withColumn("score", F.col("score") + F.when(F.col("named"), 0.5 / (RRF_K + 1)).otherwise(0.0)).drop("named")
    if proximity and len(words) >= 2:
        rows = rows.withColumn("score", F.col("score") + F.coalesce(0.4 / (RRF_K + 1) / (1 + window(words) / 80), F.lit(0.0)))
    if content in ("code", "prose"):
        rows = rows.where(T.content_kind(F.col("body")).isin(content, "mixed"))
    top = rows.withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "doc_id", "idx").limit(limit)
    return staged(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "idx"))), "hits")


def corrected(chunks: DataFrame, query: str, most: int = 2, doc_id: str | None = None, first: int = 400) -> str | None:
    """The query with each word that the first chunks' vocabulary lacks replaced by its nearest word there, the least of
    several; null if nothing changes."""
    words = [w for w in T.words_of(query) if len(w) >= 3 and w not in T.STOPWORDS]
    if not words:
        return None
    rows = chunks if doc_id is None else chunks.where(F.col("doc_id") == doc_id)
    found = rows.orderBy("doc_id", "idx").limit(first).select(F.explode(T.word_tokens(F.col("body"))).alias("term")).where(F.length("term") >= 3)
    vocabulary = found.where(~F.col("term").isin(*T.STOPWORDS) & ~F.col("term").rlike(r"^\d+$")).distinct()
    asked = F.broadcast(rows.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string"))
    near = asked.join(vocabulary, F.abs(F.length("term") - F.length("word")) <= most).withColumn("d", F.levenshtein("word", "term", most)).where("d >= 0")
    best = {r.word: r.b.term for r in near.groupBy("word").agg(F.min(F.struct("d", "term")).alias("b")).collect()}
    out = [best.get(w, w) for w in words]
    return " ".join(out) if out != words else None


def search(docs: DataFrame, chunks: DataFrame, queries: str | list[str], limit: int = 5, doc_id: str | None = None, content: str | None = None, fuzzy: bool = True, proximity: bool = True) -> DataFrame:
    """(doc_id, idx, body, snippet, score, corrected): the lists of all queries fused once more by reciprocal ranks. A
    query that finds nothing is asked again with its words corrected."""
    asked = [q for q in ([queries] if isinstance(queries, str) else queries) if q.strip()]
    stems = chunks if "stems" in chunks.columns else stemmed(chunks)
    lists, used, fixes = [], [], []
    for q in asked:
        hits = search_once(docs, stems, q, max(2 * limit, 10), doc_id, content, proximity)
        if fuzzy and not hits.limit(1).count() and (fix := corrected(chunks, q, doc_id=doc_id)):
            fixes.append(f"{q} -> {fix}")
            q, hits = fix, search_once(docs, stems, fix, max(2 * limit, 10), doc_id, content, proximity)
        used += T.words_of(q)
        lists.append(hits.select("doc_id", "idx", "body", "rank"))
    if not lists:
        return chunks.select("doc_id", "idx", "body", F.lit("").alias("snippet"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("corrected")).limit(0)
    everything = lists[0]
    for x in lists[1:]:
        everything = everything.unionByName(x)
    fused = everything.groupBy("doc_id", "idx").agg(F.any_value("body").alias("body"), F.round(F.sum(1 / (F.lit(float(RRF_K)) + F.col("rank"))), 9).alias("score"))
    top = fused.orderBy(F.desc("score"), "doc_id", "idx").limit(limit)
    return top.select("doc_id", "idx", "body", snippet(list(dict.fromkeys(used))).alias("snippet"), "score", F.lit("; ".join(fixes) or None).cast("string").alias("corrected"))


def stale(hits: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """``hits`` with stale and reason, by the files (path, content) of today: missing, unreadable (null content) or
    changed. Documents without a path or a hash are never stale."""
    now = files.select("path", F.lit(True).alias("there"), F.sha2("content", 256).alias("now"))
    of = docs.select(F.col("id").alias("doc_id"), "path", "content_hash").join(now, "path", "left")
    reason = F.when(F.coalesce("path", F.lit("")).eqNullSafe("") | F.col("content_hash").isNull(), None).when(F.col("there").isNull(), "missing").when(F.col("now").isNull(), "unreadable").when(F.col("now") != F.col("content_hash"), "changed")
    return hits.join(of, "doc_id", "left").withColumn("reason", reason).withColumn("stale", F.col("reason").isNotNull()).drop("path", "content_hash", "there", "now")


def by_intent(docs: DataFrame, chunks: DataFrame, doc_id: str, intent: str, vocabulary: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The five best chunks of one document for an intent, and its fifteen most frequent terms."""
    own = chunks.where(F.col("doc_id") == doc_id)
    return search(docs, own, intent, 5), vocabulary(own.select("doc_id", F.col("body").alias("text")), 15)


def batch(docs: DataFrame, chunks: DataFrame, asked: list[dict], most: int = 20) -> DataFrame:
    """(item, doc_id, idx, snippet, score) of up to ``most`` searches, in their order; chunks are stemmed once for all."""
    if len(asked) > most:
        raise ValueError(f"at most {most} searches")
    stems, out = stemmed(chunks), None
    for k, options in enumerate(asked):
        part = search(docs, stems, **options).select(F.lit(k).alias("item"), "doc_id", "idx", "snippet", "score")
        out = part if out is None else out.unionByName(part)
    return out


def matching_lines(docs: DataFrame, keyword: str) -> DataFrame:
    """(doc_id, n, line) of lines that hold a keyword in any case, counted from 1."""
    rows = docs.where(F.contains(F.lower("text"), F.lit(keyword.lower()))).select("doc_id", F.posexplode(F.split("text", "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]")).alias("at", "line"))
    return rows.where(F.contains(F.lower("line"), F.lit(keyword.lower()))).select("doc_id", (F.col("at") + 1).cast("long").alias("n"), "line")
