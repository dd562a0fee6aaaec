"""Secret scans weighed by who owns the candidates, in DataFrame operations only.

Patterns find candidates in whole texts, with code point positions: assignments, access key ids, long hex strings, and
two kinds beside those, private key headers and long strings that mix cases and digits. Each candidate's hash is counted
over the corpus by distinct repositories and by distinct owners, both after a grouping by (hash, repository) or
(hash, owner), so that a string that a third of all rows hold is merged before it is shuffled on its hash alone. Strings
of more than MAX_OWNERS owners, and those in more than MAX_REPOS repositories even of one owner, as a vendored sample is,
are copied examples; the others look like live credentials. Counts of hashes with very many rows are broadcast to these.

Base spans are always reported. Spans of the other kinds are added where they don't overlap base spans and look live.
Null texts count as empty. A null repository or owner counts as one of its own. Repeated rows are reported each, and
count as the repository and owner that they name. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.llm.columns import literal, running, unused
from ctxlake.llm.common import join_hot, staged

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_LONG = "A-Za-z0-9+/_=-"
#: kind: pattern, the group that is the credential, its least length. Those of three come first: they are the base.
KINDS = {
    "assign": (_ASSIGN, 1, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "mixed": (rf"(?<![{_LONG}])(?=[{_LONG}]{{24}})(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[{_LONG}]+", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
}
BASE, MAX_OWNERS, MAX_REPOS = ("assign", "access", "hex"), 2, 20


def _found(kind: str, text: str) -> str:
    """SQL for array<struct<start, end, kind, value>> of a kind's matches in a text column."""
    pattern, group, least = KINDS[kind]
    p = literal(pattern)
    hits, values, gaps = f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, {group})", f"split({text}, {p}, -1)"
    pairs = f"zip_with({hits}, slice({gaps}, 1, size({hits})), (h, g) -> named_struct('gap', cast(length(g) as bigint), 'size', cast(length(h) as bigint)))"
    spans = f"zip_with({running(pairs)}, {values}, (s, v) -> named_struct('start', s.start, 'end', s.end, 'rank', {list(KINDS).index(kind)}, 'kind', '{kind}', 'value', v))"
    return f"if({text} rlike {p}, filter({spans}, s -> length(s.value) >= {least}), cast(array() as {SPANS}))"


SPANS = "array<struct<start: bigint, end: bigint, rank: int, kind: string, value: string>>"


def candidates(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """``row``, doc_id, repo, owner and found: the spans of all kinds, with hashes; written once, without the texts."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", f"cast(`{repo}` as string) repo", f"cast(`{owner}` as string) owner", "coalesce(cast(text as string), '') text")
    rows = rows.select("doc_id", "repo", "owner", F.xxhash64("text").alias("text_hash"), *(F.expr(_found(k, "text")).alias(k) for k in KINDS))
    base = f"concat({', '.join(BASE)})"
    extra = f"filter(concat({', '.join(k for k in KINDS if k not in BASE)}), x -> not exists({base}, y -> x.start < y.end and y.start < x.end))"
    spans = rows.select("doc_id", "repo", "owner", "text_hash", F.expr(f"array_sort(concat({base}, {extra}))").alias("found"))
    hashed = "transform(found, s -> named_struct('start', s.start, 'end', s.end, 'rank', s.rank, 'kind', s.kind, 'hash', sha2(s.value, 256)))"
    return staged(spans.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", "text_hash", F.expr(hashed).alias("found")), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_rows, n_repos, n_owners) of the hashes in candidates(); n_rows counts their spans."""
    each = found.select(F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.explode("found.hash").alias("hash"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_rows"))
    repos = each.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "hash")


def weigh(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """candidates() with weighed: the spans with n_repos, n_owners and live. Only rows with spans take part in joins."""
    some = found.where(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.*")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    known = join_hot(some, staged(ownership(found), "owners"), "hash", "n_rows").select("row", F.struct("start", "rank", "end", "kind", "hash", "n_repos", "n_owners", live.alias("live")).alias("s"))
    per_row = known.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("weighed"))
    return found.join(per_row, "row", "left")


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of ``docs``: doc_id, and weighed: its spans with their kinds, hashes, counts and live."""
    none = "cast(array() as array<struct<start: bigint, rank: int, end: bigint, kind: string, hash: string, n_repos: bigint, n_owners: bigint, live: boolean>>)"
    base = ", ".join(f"'{k}'" for k in BASE)
    rows = weigh(candidates(docs, repo, owner), max_owners, max_repos)
    return rows.select("doc_id", F.expr(f"filter(coalesce(weighed, {none}), s -> s.live or s.kind in ({base}))").alias("weighed"))


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of scan()."""
    base = ", ".join(f"'{k}'" for k in BASE)
    joined = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(weighed, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return scanned.select(
        "doc_id", *counts,
        F.expr(f"sha2({joined(f'filter(weighed, s -> s.kind in ({base}))')}, 256)").alias("base_sha256"),
        F.expr(joined("weighed")).alias("spans"),
        F.expr("cast(size(filter(weighed, s -> s.live)) as bigint)").alias("n_live"),
    )


def redact(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mark: str = "[secret]") -> DataFrame:
    """``docs`` with all its columns, each live-looking span of a text replaced by ``mark``;
    n_chars, where there is such a column, is counted again. Copied examples stay. No row is dropped."""
    found = candidates(docs, repo, owner)
    key, digest, spans, cut_text = (unused(docs, c) for c in ("live_id", "live_digest", "live_spans", "live_text"))
    live = weigh(found, max_owners, max_repos).select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.expr("filter(weighed, s -> s.live)").alias(spans)).where(F.size(spans) > 0)
    live = live.dropDuplicates([key, digest])
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(live, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (text_hash == F.col(digest)), "left")
    # Overlapping spans (an assignment's value that is also a hex string) go as one.
    merged = f"""aggregate({spans}, cast(array() as array<struct<start: bigint, end: bigint>>), (a, s) ->
      if(size(a) > 0 and element_at(a, -1).end >= s.start,
         concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))),
         concat(a, array(named_struct('start', s.start, 'end', s.end)))))"""
    cut = f"aggregate({merged}, named_struct('at', 0L, 'out', ''), (a, s) -> named_struct('at', s.end, 'out', concat(a.out, substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int)), {literal(mark)})), a -> concat(a.out, substring(text, cast(a.at + 1 as int))))"
    changed = joined.withColumn(cut_text, F.expr(f"if({spans} is null, text, {cut})"))
    out = [F.col(cut_text).alias("text") if c == "text" else (F.when(F.col(spans).isNull(), F.col(c)).otherwise(F.length(cut_text)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns]
    return changed.select(*out)
