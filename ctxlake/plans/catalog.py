"""Queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.functions import policy
from ctxlake.functions import text as T
from ctxlake.operators import graph, search
from ctxlake.operators.store import OFFLOAD_BYTES
from ctxlake.sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TERMS, POOL = ["that", "with", "from"], 200
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_CHUNKS = "select doc_id, k as idx, substr(text, k * 2000 + 1, 2000) as body from (select doc_id, text, unnest(range(greatest(1, ceil(length(text) / 2000.0))::bigint)) as k from documents)"
_TF = "select doc_id, idx, " + ", ".join(f"len(list_filter(regexp_extract_all(lower(body), '[a-z0-9]+'), lambda t: t = '{w}')) as t{i}" for i, w in enumerate(TERMS)) + f" from ({_CHUNKS})"
_AND = f"select doc_id::bigint as doc_id, idx::bigint as idx, (t0 + t1 + t2)::bigint as score from ({_TF}) where t0 > 0 and t1 > 0 and t2 > 0"
_NODES = " union all ".join(f"select '{s}:' || {k} as id, {n} as name, '{kind}' as kind, '{t}' as file, {k}::bigint as key from {t}" for s, t, k, n, kind in (("r", "region", "r_regionkey", "r_name", "class"), ("n", "nation", "n_nationkey", "n_name", "class"), ("s", "supplier", "s_suppkey", "s_name", "function"), ("c", "customer", "c_custkey", "c_name", "function"), ("p", "part", "p_partkey", "p_name", "function")))
_EDGES = "select 'n:' || n_nationkey as source, 'r:' || n_regionkey as target, 'in_region' as relation from nation union all select 's:' || s_suppkey, 'n:' || s_nationkey, 'in_nation' from supplier union all select 'c:' || c_custkey, 'n:' || c_nationkey, 'in_nation' from customer union all select distinct 's:' || l_suppkey, 'p:' || l_partkey, 'supplies' from lineitem"
_DEGREES = f"select n.id, count(e.id)::bigint as degree from ({_NODES}) n left join (select source as id from ({_EDGES}) union all select target from ({_EDGES})) e on n.id = e.id group by n.id"


@query(f"{_AND} order by score desc, doc_id, idx limit 20")
def and_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.and_search(search.slices(table(spark, d, "documents")), TERMS, 20)


@query(f"""with c as ({_CHUNKS}), kw as (select doc_id, idx, row_number() over (order by score desc, doc_id, idx) as rank from ({_AND}) qualify rank <= {POOL}),
 sub as (select doc_id, idx, row_number() over (order by doc_id, idx) as rank from c where contains(lower(body), 'with') qualify rank <= {POOL})
 select doc_id::bigint as doc_id, idx::bigint as idx, round(sum(1.0::double / (60 + rank)), 9)::double as score from (select * from kw union all select * from sub) group by all order by score desc, doc_id, idx limit 20""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    chunks = search.slices(table(spark, d, "documents"))
    return search.fuse([search.keyword_view(chunks, TERMS, POOL), search.substring_view(chunks, "with", POOL)], 20)


@query(_CHUNKS.replace("k as idx", "k::bigint as idx"))
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return search.slices(table(spark, d, "documents"))


@query("select doc_id, 'doc_' || substr(sha256(source || chr(0) || text), 1, 16) as id, strlen(text)::bigint as bytes, sha256(text) as content_hash, ((length(text) + 3) // 4)::bigint as tokens from documents")
def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.doc_id(F.col("source"), c).alias("id"), F.octet_length(c).cast("long").alias("bytes"), F.sha2(c, 256).alias("content_hash"), T.token_estimate(c).alias("tokens"))


@query(f"select doc_id, term, tf::bigint as tf, rank::bigint as rank from (select *, row_number() over (partition by doc_id order by tf desc, term) as rank from (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as term from documents) where length(term) >= 3 and term not in ({_STOP}) and not regexp_full_match(term, '[0-9]+') group by all)) where rank <= 15")
def vocabulary_topn(spark: SparkSession, d: str) -> DataFrame:
    return search.vocabulary(table(spark, d, "documents"))


@query("select case when strlen(text) <= 102400 then 'inline' else 'indexed' end as route, count(*)::bigint as n, sum(strlen(text))::bigint as bytes from documents group by 1")
def offload_decision(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, d, "documents").groupBy(F.when(size <= OFFLOAD_BYTES, "inline").otherwise("indexed").alias("route")).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes"))


@query("select lang, count(*)::bigint as docs, sum(strlen(text))::bigint as bytes, sum(ceil(length(text) / 2000.0))::bigint as chunks, ceil(sum(strlen(text)) / 4.0)::bigint as tokens from documents group by lang")
def store_report(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(size).alias("bytes"), F.sum(F.ceil(F.length("text") / 2000)).alias("chunks"), F.ceil(F.sum(size) / 4).cast("long").alias("tokens"))


@query("select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def benchmark_containment(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold a whole item. An item's first and last words may have other characters attached in a document, but
    those between stand alone: the longest of them finds the candidates by an equi-join. Items of fewer than three words
    have none and are looked for in every text."""
    longest = F.expr("element_at(array_sort(slice(words, 2, size(words) - 2), (a, b) -> case when length(a) <> length(b) then length(b) - length(a) when a < b then -1 when a > b then 1 else 0 end), 1)")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), F.expr("regexp_extract_all(text, '[^ \\n]+', 0)").alias("words"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.withColumn("word", F.explode(F.array_distinct(F.expr("regexp_extract_all(text, '[^ \\n]+', 0)"))))
    inner = items.where("size(words) >= 3").select("item_id", "item", longest.alias("word"))
    found = words.join(inner, "word").where(F.contains("text", "item")).select("doc_id", "item_id")
    short = items.where("size(words) < 3").select("item_id", "item")
    return found.unionByName(docs.join(short, F.contains("text", "item")).select("doc_id", "item_id"))


@query("select doc_id, (m.h is null or sha256(d.text) <> m.h) as stale, case when m.h is null then 'missing' when sha256(d.text) <> m.h then 'changed' end as reason from documents d left join (select doc_id, sha256(case when doc_id % 3 = 0 then text || '!' else text end) as h from documents where doc_id % 7 <> 0) m using (doc_id)")
def stale_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    now = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    j = docs.select("doc_id", F.sha2("text", 256).alias("was")).join(now, "doc_id", "left")
    reason = F.when(F.col("h").isNull(), "missing").when(F.col("h") != F.col("was"), "changed")
    return j.select("doc_id", reason.isNotNull().alias("stale"), reason.alias("reason"))


@query("with t as (select doc_id, max(case when toxic = 1 then 2 when quality = 1 then 1 else 0 end) as tag from labels group by 1) select d.doc_id, round(d.n_chars * case coalesce(t.tag, 0) when 2 then 0.6::double when 1 then 1.5::double else 1.0::double end, 6)::double as score from documents d left join t using (doc_id)")
def tag_overlay(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)).alias("tag"))
    weight = F.when(F.col("tag") == 2, 0.6).when(F.col("tag") == 1, 1.5).otherwise(1.0)
    return table(spark, d, "documents").select("doc_id", "n_chars").join(tags, "doc_id", "left").select("doc_id", F.round(F.col("n_chars") * weight, 6).alias("score"))


@query(_DEGREES)
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*graph.from_tables(spark, d))


@query(f"with g as (select d.*, n.kind from ({_DEGREES}) d join ({_NODES}) n using (id)), t as (select greatest(10, ceil(avg(degree) + 2 * stddev_pop(degree)))::bigint as threshold from g) select id, degree, threshold from g, t where degree >= threshold and kind <> 'module' order by degree desc, id desc limit 10")
def hub_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(*graph.from_tables(spark, d))


@query(f"select relation, count(*)::bigint as n from ({_EDGES}) group by relation")
def relation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation_counts(spark, d)


@query(f"with recursive e as ({_EDGES}), w(id, distance) as (select 'r:1', 0 union select e.source, w.distance + 1 from w join e on e.target = w.id where w.distance < 2) select id, min(distance)::bigint as distance from w group by id")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return graph.blast_radius(graph.from_tables(spark, d)[1], spark.createDataFrame([("r:1",)], "id string"), 2)


@query(f"select source, target, relation, case when source = 'n:3' then 'out' else 'in' end as direction from ({_EDGES}) where source = 'n:3' or target = 'n:3'")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.from_tables(spark, d)[1].select("source", "target", "relation").where((F.col("source") == "n:3") | (F.col("target") == "n:3"))
    return edges.withColumn("direction", F.when(F.col("source") == "n:3", "out").otherwise("in"))


@query("select p_partkey, g from (select p_partkey, unnest(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: lower(substr(p_name, i, 3))))) as g from part)")
def trigram_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(T.trigrams(F.col("p_name"))).alias("g"))


@query("select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' when a.h <> b.h then 'changed' else 'same' end as change from (select doc_id, sha256(text) as h from documents where doc_id % 5 <> 0) a full join (select doc_id, sha256(case when doc_id % 4 = 0 then text || '.' else text end) as h from documents where doc_id % 7 <> 0) b on a.doc_id = b.doc_id")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    b = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("g"))
    change = F.when(F.col("h").isNull(), "added").when(F.col("g").isNull(), "removed").when(F.col("h") != F.col("g"), "changed").otherwise("same")
    return a.join(b, "doc_id", "full").select("doc_id", change.alias("change"))


_KINDS = ("error", "error"), ("purchase", "file_edit"), ("click", "exec"), ("signup", "decision")
_KIND = " ".join(f"when '{t}' then '{k}'" for t, k in _KINDS)


@query(f"""select case when kind in ('decision', 'error', 'rule') then 0 when kind in ('edit', 'write', 'file_write', 'file_edit', 'task') then 1
 when kind in ('tool', 'exec', 'file_read', 'git', 'intent') then 2 when kind in ('cwd', 'env', 'skill', 'subagent', 'turn') then 3 else 4 end::bigint as tier, kind, count(*)::bigint as n
 from (select case event_type {_KIND} else 'unheard' end as kind from events) group by all""")
def event_tiers(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in _KINDS for x in kv))
    kind = F.coalesce(names[F.col("event_type")], F.lit("unheard"))
    return table(spark, d, "events").select(kind.alias("kind")).groupBy(T.tier(F.col("kind")).cast("long").alias("tier"), "kind").agg(F.count("*").alias("n"))


_SAID = ["Request timed out", "deadline exceeded", "connect ECONNREFUSED", "socket hang up", "EACCES denied", "Unauthorized", "ENOENT no such file", "missing key", "404", "Unexpected token } in JSON", "invalid argument", "spawn failed", "not installed", "exit code 2", "non-zero", "Traceback", "build failed", "fine"]
_SAYINGS = " union all ".join(f"select '{x}' as text" for x in _SAID)


@query(f"""select class, count(*)::bigint as n from (select case when regexp_matches(s, '\\btimed?[\\s-]?out\\b|timeout|deadline exceeded') then 'timeout'
 when regexp_matches(s, 'network|ssrf|dns|econn|socket|fetch|refused|unreachable') then 'network' when regexp_matches(s, 'permission|eacces|denied|forbidden|unauthor') then 'permission'
 when regexp_matches(s, 'not[\\s-]?found|enoent|no such|missing|404') then 'not-found' when regexp_matches(s, 'syntax|parse|unexpected token|invalid') then 'syntax'
 when regexp_matches(s, 'runtime[\\s-]?not[\\s-]?available|not installed|spawn|enoexec') then 'runtime'
 when regexp_matches(s, 'exit\\s*(code)?\\s*[1-9]|non-?zero|failed|traceback|exception') then 'runtime-error' else 'other' end as class
 from (select lower(text) as s from conversations union all select lower(text) from ({_SAYINGS}))) group by class""")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    said = spark.createDataFrame([(x,) for x in _SAID], "text string")
    return table(spark, d, "conversations").select("text").unionByName(said).select(T.error_class(F.col("text")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("select l_returnflag as task, l_linestatus as arm, (l_linenumber % 3)::bigint as model, count(*)::bigint as n, median(l_quantity)::double as med_loc, max(l_quantity)::double as max_loc, round(avg(case when l_discount > 0.05 then 1.0::double else 0 end), 9)::double as ok_rate from lineitem group by all")
def run_aggregates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("arm"), (F.col("l_linenumber") % 3).cast("long").alias("model"), "l_quantity", "l_discount")
    return rows.groupBy("task", "arm", "model").agg(F.count("*").alias("n"), F.median("l_quantity").alias("med_loc"), F.max("l_quantity").alias("max_loc"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)), 9).alias("ok_rate"))


_CODE = "```py\\na = 1\\n# no\\n\\nb = 2\\n```\\ntext\\n```\\n/* x\\ny */\\n// z\\nc()\\n```"


@query(rf"""select doc_id, len(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '\S') and not regexp_matches(l, '^\s*(//|#|/\*|\*)')))::bigint as loc
 from (select doc_id, regexp_replace(case when len(f) > 0 then array_to_string(f, chr(10)) else text end, '(?s)/\*.*?\*/', '', 'g') as code
 from (select doc_id, text, regexp_extract_all(text, '(?s)```[a-zA-Z0-9_+-]*\r?\n(.*?)```', 1) as f from (select doc_id, text from documents union all select -1, replace('{_CODE}', '\n', chr(10)))))""")
def loc_metric(spark: SparkSession, d: str) -> DataFrame:
    fixed = spark.createDataFrame([(-1, _CODE.replace("\\n", "\n"))], "doc_id long, text string")
    return table(spark, d, "documents").select("doc_id", "text").unionByName(fixed).select("doc_id", T.lines_of_code(F.col("text")).alias("loc"))


_URLS = ["http://a.com", "HTTPS://u:p@A.com:443/x", "http://a.com:80", "http://a.com:6379/", "ftp://a.com", "file:///etc/passwd", "nope", "http://"]
_ODD_URLS = " union all ".join(f"select {-i - 1} as page_id, '{u}' as url" for i, u in enumerate(_URLS))


@query(f"""select page_id, scheme, host, case when scheme = '' or (scheme in ('http', 'https') and host = '') then 'bad-url' when scheme not in ('http', 'https') then 'scheme-blocked'
 when port not in ('', '80', '443') then 'port-blocked' else 'allowed' end as verdict from (select page_id, scheme, lower(split_part(a, ':', 1)) as host, split_part(a, ':', 2) as port from
 (select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') as a from (select page_id, url from pages union all {_ODD_URLS})))""")
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    odd = spark.createDataFrame([(-i - 1, u) for i, u in enumerate(_URLS)], "page_id long, url string")
    p = policy.url_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", "url").unionByName(odd).select("page_id", p["scheme"].alias("scheme"), p["host"].alias("host"), policy.url_verdict(F.col("url")).alias("verdict"))
