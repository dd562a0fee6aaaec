"""Chunks, postings and ranked retrieval."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxlake.functions.text import STOPWORDS, ascii_tokens, looks_like_markdown
from ctxlake.sources.scratch import staged

CHUNK, RRF_K = 2000, 60


def slices(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, idx, body): texts without paragraph breaks cut into pieces of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    cut = docs.select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("idx", "k"))
    return cut.select("doc_id", F.col("idx").cast("long").alias("idx"), F.expr(f"substring(text, k * {size} + 1, {size})").alias("body"))


_TRIM = "regexp_replace({0}, '^\\\\s+|\\\\s+$', '')"
_FLUSH = f"if({_TRIM.format('a.buf')} = '', array(), array({_TRIM.format('a.buf')}))"
#: SQL fold of paragraphs (an array) into chunks of at most {max} characters, joined by blank lines. Longer ones are cut
#: and stay as they are; what is packed is trimmed, and left out if nothing remains.
PACK = f"""aggregate(split(text, '\\\\n{{{{2,}}}}', -1), named_struct('done', cast(array() as array<string>), 'buf', ''), (a, p) ->
  case when length(p) >= {{max}} then named_struct('done', concat(a.done, {_FLUSH}, transform(sequence(0, (length(p) - 1) div {{max}}), i -> substring(p, i * {{max}} + 1, {{max}}))), 'buf', '')
       when length(a.buf) + length(p) + 2 > {{max}} then named_struct('done', concat(a.done, {_FLUSH}), 'buf', p)
       else named_struct('done', a.done, 'buf', if(a.buf = '', p, concat(a.buf, '\\n\\n', p))) end,
  a -> concat(a.done, {_FLUSH}))"""


def paragraphs(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, idx, body): whole paragraphs packed into chunks of at most ``size`` characters."""
    rows = docs.select("doc_id", F.posexplode(F.expr(PACK.format(max=size))).alias("idx", "body"))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "body")


def fences(text: str) -> list[tuple[bool, str]]:
    """A text in order as (is fenced, part); an unclosed fence is text."""
    out, at = [], 0
    for m in re.finditer(r"```[^\n]*\n.*?```", text, re.S):
        out += [(False, text[at : m.start()])] * (m.start() > at) + [(True, m[0])]
        at = m.end()
    return out + [(False, text[at:])] * (at < len(text)) or [(False, text)]


def sections(text: str) -> list[str]:
    """A text cut before its headings, trimmed, without empty sections."""
    out = re.split(r"\n(?=#{1,6}\s+\S)", text)
    return [x.strip() for x in out if x.strip()] or [text]


def packed(parts: list[str], size: int) -> list[str]:
    """Parts joined by blank lines into chunks of at most ``size`` characters; longer ones are cut."""
    chunks, held = [], ""
    for part in [*parts, None]:
        large = part is not None and len(part) >= size
        if part is None or large or len(held) + len(part) + 2 > size:
            chunks += [held.strip()] * bool(held.strip())
            held = ""
        if large:
            chunks += [part[i : i + size] for i in range(0, len(part), size)]
        elif part is not None:
            held = f"{held}\n\n{part}" if held else part
    return chunks


def markdown_chunks(text: str, size: int = CHUNK) -> list[str]:
    """Chunks of a Markdown text: fenced blocks stay whole, sections are packed by paragraphs, and small units together."""
    units = []
    for fenced, part in fences(text):
        units += [part.strip()] if fenced else [u for s in sections(part) if s.strip() for u in packed(re.split(r"\n{2,}", s), size)]
    return packed(units, size)


def chunked(docs: DataFrame, size: int = CHUNK, markdown: bool | None = None) -> DataFrame:
    """(doc_id, idx, body) of ``docs`` (doc_id, text). Markdown, as told or as it looks, is cut along its structure, in
    Python; all other texts along paragraphs, without leaving the JVM."""

    @F.arrow_udf("array<string>")
    def by_structure(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else markdown_chunks(t, size) for t in texts.to_pylist()], pa.list_(pa.string()))

    is_markdown = F.lit(markdown) if markdown is not None else looks_like_markdown(F.col("text"))
    rows = docs.select("doc_id", "text", is_markdown.alias("md"))
    structured = rows.where("md").select("doc_id", F.posexplode(by_structure("text")).alias("idx", "body")).select("doc_id", F.col("idx").cast("long").alias("idx"), "body")
    return structured.unionByName(paragraphs(rows.where("not md"), size))


def _is(word: str):
    return lambda t: t == word


def and_search(chunks: DataFrame, query: list[str], limit: int) -> DataFrame:
    """Chunks that have all terms, by summed term frequency. Only chunks that hold every term as a substring are cut into
    tokens, once each; terms are counted in place, so only hits are sorted."""
    low = F.lower("body")
    able = chunks.where(reduce(and_, (F.contains(low, F.lit(w)) for w in query)))
    kept = F.filter(ascii_tokens(F.col("body")), lambda t: t.isin(*query))
    # A generator keeps the tokens from being computed once per term.
    rows = able.select("doc_id", "idx", F.explode(F.array(kept)).alias("kept")).select("doc_id", "idx", "kept", *(F.size(F.filter("kept", _is(w))).cast("long").alias(f"t{i}") for i, w in enumerate(query)))
    hits = rows.where(reduce(and_, (F.col(f"t{i}") > 0 for i in range(len(query)))))
    return hits.select("doc_id", "idx", reduce(add, (F.col(f"t{i}") for i in range(len(query)))).alias("score")).orderBy(F.desc("score"), "doc_id", "idx").limit(limit)


def keyword_view(chunks: DataFrame, query: list[str], pool: int) -> DataFrame:
    top = and_search(chunks, query, pool)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "idx"))).select("doc_id", "idx", "rank")


def substring_view(chunks: DataFrame, needle: str, pool: int) -> DataFrame:
    top = chunks.where(F.contains(F.lower("body"), F.lit(needle.lower()))).select("doc_id", "idx").orderBy("doc_id", "idx").limit(pool)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("doc_id", "idx")))


def fuse(views: list[DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion over (doc_id, idx); the pools, and so the windows above, are bounded by their limits."""
    everything = views[0]
    for v in views[1:]:
        everything = everything.unionByName(v)
    fused = everything.groupBy("doc_id", "idx").agg(F.round(F.sum(1 / (F.lit(float(RRF_K)) + F.col("rank"))), 9).alias("score"))
    return fused.orderBy(F.desc("score"), "doc_id", "idx").limit(limit)


def word_counts(text: Column) -> Column:
    """array<struct<less, term>> of a text's significant words, less being their negated count. Words are sorted and runs of
    the same one measured, so that work stays close to the text's length; arrays used twice are bound by a transform."""
    words = F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))

    def runs(words: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i == 0) | (i == F.size(words)) | (F.get(words, i) != F.get(words, i - 1)))
        return F.transform(F.array(ends), lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda k, j: F.struct((k - F.get(at, j + 1)).alias("less"), F.get(words, k).alias("term"))))[0]

    found = F.transform(F.array(words), runs)[0]
    return F.filter(found, lambda r: ~r.term.isin(*STOPWORDS) & ~r.term.rlike("^[0-9]+$"))


def merged_vocabulary(rows: DataFrame, limit: int = 15) -> DataFrame:
    """The most frequent significant words of each document, whose text may lie in any number of rows."""
    words = rows.select("doc_id", F.inline(word_counts(F.col("text"))))
    counts = words.groupBy("doc_id", "term").agg((-F.sum("less")).alias("tf"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def vocabulary(docs: DataFrame, limit: int = 15) -> DataFrame:
    """merged_vocabulary() where most ids have one row: those are ranked within it and only their words leave it. Ids of
    several rows are found first and written, so that their size decides how they are joined."""
    several = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    alone = docs.where("doc_id is not null").join(several, "doc_id", "left_anti")
    best = F.slice(F.sort_array(word_counts(F.col("text"))), 1, limit)
    ranked = alone.select("doc_id", F.posexplode(best).alias("at", "w")).select("doc_id", "w.term", (-F.col("w.less")).cast("long").alias("tf"), (F.col("at") + 1).cast("long").alias("rank"))
    merged = docs.where("doc_id is null").unionByName(docs.join(several, "doc_id", "left_semi"))
    return ranked.unionByName(merged_vocabulary(merged.select("doc_id", "text"), limit))
