"""Queries over graphs, stores, sessions and policies, with SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.functions import policy, prose
from ctxlake.functions import text as T
from ctxlake.operators import explore, graph, network, search, sessions, store, symbols
from ctxlake.plans.catalog import _DEGREES, _EDGES, _NODES, query
from ctxlake.sources import files, table


def _values(rows: list[tuple], names: str) -> str:
    """SQL for a table of literals."""
    def cell(x) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"(select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as v({names}))"


def _graph(spark: SparkSession, d: str) -> explore.Graph:
    return explore.Graph(*graph.from_tables(spark, d))


# --- graphs

SOURCES = {
    "alpha.py": "import json\n\ndef load_config(path):\n    return json.load(path)\n\ndef parse_entry(raw):\n    return load_config(raw)\n\nclass Store:\n    def save(self):\n        return parse_entry(1)\n",
    "beta.py": "from alpha import parse_entry\n\nclass Cache(Store):\n    pass\n\ndef run_pipeline(x):\n    return parse_entry(x)\n",
    "web/ui.ts": "import { a } from './lib/alpha'\nexport class View extends Base {}\nexport const draw = (x) => render(x)\nfunction render(x) { return draw(x) }\n",
    "web/readme.md": "# Title\n\n## Use\n\n# Title\n",
    "db/schema.sql": "CREATE TABLE users (id INT);\nCREATE OR REPLACE VIEW app.seen AS SELECT 1;\n",
    "package.json": '{"dependencies": {"left": "1"}}',
}


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in SOURCES.items()], "path string, content binary")


@query()
def source_symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbols.extract_symbols(_files(spark))


@query()
def source_graph(spark: SparkSession, d: str) -> DataFrame:
    return symbols.build(symbols.extract_symbols(_files(spark)))[1].select("source", "target", "relation", "provenance")


_HEADED = [(1, "# Title"), (2, "text"), (3, "## Use ##"), (4, "# Title"), (5, "#no"), (6, "####### no"), (7, "###### Six")]


@query(rf"""select case when n > 1 then title || '@' || line else title end as name, line::bigint as line from (select line, title, row_number() over (partition by title order by line) as n
 from (select line, trim(regexp_replace(regexp_extract(t, '^#{{1,6}}[ \t]+(.+?)\s*$', 1), '[ \t]#+\s*$', '')) as title from {_values(_HEADED, "line, t")} where regexp_matches(t, '^#{{1,6}}[ \t]+\S')))""")
def heading_symbols(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([("a.md", bytearray("\n".join(t for _, t in _HEADED).encode()))], "path string, content binary")
    return symbols.extract_symbols(one).select("name", F.col("line").cast("long").alias("line"))


_DDL = [(1, "CREATE TABLE users (id INT);"), (2, "create or replace temp view IF NOT EXISTS app.seen as select 1;"), (3, "drop table users"), (4, "  Create Index by_id on users (id)"), (5, 'CREATE SCHEMA "x"')]


@query(rf"""select lower(k) as kind, case when s <> '' then s || '.' || n else n end as name, line::bigint as line from (select line, regexp_extract(t, p, 1) as k, regexp_extract(t, p, 2) as s, regexp_extract(t, p, 3) as n
 from (select *, '(?i)^[ \t]*CREATE[ \t]+(?:OR[ \t]+REPLACE[ \t]+)?(?:TEMP(?:ORARY)?[ \t]+)?(TABLE|VIEW|INDEX|FUNCTION|PROCEDURE|TRIGGER|SCHEMA|TYPE|SEQUENCE)[ \t]+(?:IF[ \t]+NOT[ \t]+EXISTS[ \t]+)?(?:[`"\[]?([A-Za-z_]\w*)[`"\]]?\.)?[`"\[]?([A-Za-z_]\w*)' as p
 from {_values(_DDL, "line, t")}) where regexp_matches(t, p))""")
def ddl_symbols(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([("a.sql", bytearray("\n".join(t for _, t in _DDL).encode()))], "path string, content binary")
    return symbols.extract_symbols(one).select("kind", "name", F.col("line").cast("long").alias("line"))


@query(f"""select count(*)::bigint as nodes, (select count(*) from ({_EDGES}))::bigint as edges, count(distinct file)::bigint as files,
 (select greatest(10, ceil(avg(degree) + 2 * stddev_pop(degree)))::bigint from ({_DEGREES})) as threshold, count(*) filter (kind = 'class')::bigint as classes from ({_NODES})""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return explore.stats(_graph(spark, d)).select("nodes", "edges", "files", "threshold", F.col("kinds")["class"].alias("classes"))


_TOKENS = f"select id, list_distinct(regexp_extract_all(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+') || regexp_extract_all(lower(file), '[a-z0-9]+')) as tokens, lower(name) as low, kind from ({_NODES})"
_ASKED = ["supplier", "region", "europe"]
_IDF = "select t, ln((n + 1)::double / (df + 1)) + 1 as idf from (select t, (select count(*) from tok) as n, (select count(*) from tok where list_contains(tokens, t)) as df from (select unnest(%s) as t))"


@query(f"with tok as ({_TOKENS}) select t as word, round(idf, 9) as idf from ({_IDF % _ASKED})")
def word_weights(spark: SparkSession, d: str) -> DataFrame:
    weight = explore.idf(graph.from_tables(spark, d)[0], _ASKED)
    return spark.createDataFrame([(w, round(x, 9)) for w, x in weight.items()], "word string, idf double")


@query(f"""with tok as ({_TOKENS}), w as ({_IDF % _ASKED}), c as (select id, kind, t, case when list_contains(tokens, t) then idf when length(t) >= 3 and contains(low, t) then 0.5 * idf
 when length(t) >= 4 and len(list_filter(tokens, lambda k: length(k) >= 4 and (starts_with(k, t) or starts_with(t, k)))) > 0 then 0.4 * idf else 0 end as credit from tok, w)
 select id, round(sum(credit) * case when any_value(kind) in ('function', 'method', 'class') then 1.2 else 1.0 end, 6)::double as score from c group by id having sum(credit) > 0""")
def seed_scores(spark: SparkSession, d: str) -> DataFrame:
    scored, _ = explore.seed_scores(_graph(spark, d), "which supplier is in the region of Europe")
    return scored.select("id", F.round("score", 6).alias("score"))


@query()
def question_walk(spark: SparkSession, d: str) -> DataFrame:
    found = explore.ask(_graph(spark, d), "which region is europe in", depth=2)
    return spark.createDataFrame([(r["rank"], r.id, r.degree, r.listed) for r in found.nodes], "rank int, id string, degree long, listed string")


@query(f"""select id from (select id, 0 as m, file, key from ({_NODES}) where id = 'Asia' union all select id, 1, file, key from ({_NODES}) where name = 'Asia'
 union all select id, 2, file, key from ({_NODES}) where lower(regexp_extract(name, '[^.]*$')) = 'asia') order by m, file, key limit 1""")
def resolved_node(spark: SparkSession, d: str) -> DataFrame:
    found = explore.resolve(graph.from_tables(spark, d)[0], "Asia")
    return spark.createDataFrame([(found,)] if found else [], "id string")


_AROUND = f"select 0 as side, '->' as direction, relation, source, target, target as id from ({_EDGES}) where source = 'n:3' union all select 1, '<-', relation, source, target, source from ({_EDGES}) where target = 'n:3'"


@query(f"select direction, relation, id, name, file || ':' || (key + 1) as pointer from (select * from ({_AROUND}) order by side, relation, source, target limit 20) join ({_NODES}) using (id)")
def node_card(spark: SparkSession, d: str) -> DataFrame:
    found = explore.card(_graph(spark, d), "n:3")
    rows = [(e.direction, e.relation, e.id, e["name"], e.pointer) for e in found["edges"]] if found else []
    return spark.createDataFrame(rows, "direction string, relation string, id string, name string, pointer string")


@query(f"select relation, direction, count(*)::bigint as n from ({_AROUND}) group by all")
def node_relations(spark: SparkSession, d: str) -> DataFrame:
    return explore.incident(_graph(spark, d), "n:3").groupBy("relation", "direction").agg(F.count("*").alias("n"))


_MISSPELLED = ["amrica", "ringg", "eurpe", "widgte"]


@query(f"""select q as word, id, min(levenshtein(q, t))::bigint as distance from (select unnest({_MISSPELLED}) as q), (select id, unnest(string_split(lower(name), ' ')) as t from ({_NODES}) where file in ('region', 'part'))
 where levenshtein(q, t) <= 2 and len(list_intersect(list_transform(range(1, length(q) - 1), lambda i: substr(q, i, 3)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) > 0 group by all""")
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Misspelled words meet names through shared trigrams, then by edit distance."""
    gram = lambda c: F.explode(T.trigrams(F.col(c))).alias("g")
    asked = spark.createDataFrame([(w,) for w in _MISSPELLED], "word string").select("word", gram("word"))
    names = graph.from_tables(spark, d)[0].where("file in ('region', 'part')").select("id", F.explode(F.split(F.lower("name"), " ")).alias("t")).select("id", "t", gram("t"))
    met = names.join(F.broadcast(asked), "g").select("word", "id", "t").distinct().withColumn("distance", F.levenshtein("word", "t", 2))
    return met.where("distance >= 0").groupBy("word", "id").agg(F.min("distance").cast("long").alias("distance"))


@query(f"with recursive w(id, distance) as (select id, 0 from ({_NODES}) where file = 'region' union select e.source, w.distance + 1 from w join ({_EDGES}) e on e.target = w.id where w.distance < 2) select id, min(distance)::bigint as distance from w group by id")
def affected_by_files(spark: SparkSession, d: str) -> DataFrame:
    changed = spark.createDataFrame([("region",)], "file string")
    return network.affected_by_files(_graph(spark, d), changed).select("id", F.col("distance").cast("long").alias("distance"))


_CHANGES = "select l_orderkey as number, 'supplier' as file, 's:' || l_suppkey as id from lineitem where l_orderkey < 40"
_REACHED = f"select distinct number, id from ({_CHANGES}) union select number, e.source from ({_CHANGES}) c join ({_EDGES}) e on e.target = c.id"


@query(f"select number::bigint as number, count(*)::bigint as blast from ({_REACHED}) group by number order by blast desc, number limit 20")
def change_triage(spark: SparkSession, d: str) -> DataFrame:
    """Orders as change sets of the suppliers that they touch."""
    nodes, edges = graph.from_tables(spark, d)
    own = nodes.withColumn("file", F.when(F.col("file") == "supplier", F.col("id")).otherwise(F.col("file")))
    changes = table(spark, d, "lineitem").where("l_orderkey < 40").select(F.col("l_orderkey").alias("number"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("file")).distinct()
    return network.triage(explore.Graph(own, edges), changes, 1)


_SETS = "select distinct l_orderkey as number, l_suppkey as file from lineitem where l_orderkey < 200"


@query(f"select a.number::bigint as a, b.number::bigint as b, count(*)::bigint as shared from ({_SETS}) a join ({_SETS}) b on a.file = b.file and a.number < b.number group by all")
def change_overlaps(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "lineitem").where("l_orderkey < 200").select(F.col("l_orderkey").alias("number"), F.col("l_suppkey").alias("file")).distinct()
    return sets.withColumnRenamed("number", "a").join(sets.withColumnRenamed("number", "b"), "file").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def _small(spark: SparkSession, d: str) -> explore.Graph:
    nodes, edges = graph.from_tables(spark, d)
    nodes = nodes.where("file in ('region', 'nation', 'supplier')")
    return explore.Graph(nodes, graph.clean_edges(nodes, edges))


@query(f"""with u as (select source as a, target as b from ({_EDGES}) where relation <> 'supplies' and source not like 'c:%' union select target, source from ({_EDGES}) where relation <> 'supplies' and source not like 'c:%'),
 p as (select s.id as s, (select a from u where a like 's:%' order by a limit 1) as id from (select 1 as id) s)
 select unnest(path) as id, generate_subscripts(path, 1)::bigint as at from (select list_concat([s1.a, s1.b], [n.b]) as path from u s1 join u n on n.a = s1.b where s1.a = (select min(a) from u where a like 's:%') and n.b like 'r:%')""")
def path_to_region(spark: SparkSession, d: str) -> DataFrame:
    """The shortest path from the first supplier to its region."""
    g = _small(spark, d)
    first = g.nodes.where("file = 'supplier'").agg(F.min("id").alias("id")).first().id
    nation = g.edges.where(F.col("source") == first).first().target
    region = g.edges.where(F.col("source") == nation).first().target
    return spark.createDataFrame([(i, k + 1) for k, i in enumerate(network.shortest_path(g, first, region) or [])], "id string, at long")


@query()
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return network.communities(_small(spark, d))


@query()
def central_nodes(spark: SparkSession, d: str) -> DataFrame:
    return network.central(_small(spark, d), 10)


@query(f"select 'one' || '::' || id as id, 'one/' || file as file from ({_NODES}) where file in ('region', 'nation') union all select 'two' || '::' || id, 'two/' || file from ({_NODES}) where file in ('region', 'nation')")
def joined_graphs(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph.from_tables(spark, d)
    nodes = nodes.where("file in ('region', 'nation')")
    return graph.union([("/x/one", nodes, edges), ("/y/two", nodes, edges)])[0].select("id", "file")


# --- store


@query(r"""select doc_id, case when code >= 6 and prose >= 8 then 'mixed' when code >= 6 then 'code' else 'prose' end as kind from (select doc_id,
 case when len(regexp_extract_all(text, '```')) >= 2 then 8 else 0 end + least(20, len(regexp_extract_all(text, '(?m)\b(?:function|const|let|var|import|export|class|def|fn|package|SELECT|INSERT)\b|[{};]\s*$'))) as code,
 least(30, len(regexp_extract_all(text, '(?m)^#{1,6}\s+\S+')) + len(regexp_extract_all(text, '(?i)\b(?:the|and|with|from|that|this)\b'))) as prose from documents where lang = 'en')""")
def content_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", T.content_kind(F.col("text")).alias("kind"))


@query("select doc_id, n::bigint as n, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents) where contains(lower(line), 'licensed')")
def matching_lines(spark: SparkSession, d: str) -> DataFrame:
    return store.matching_lines(table(spark, d, "documents"), "Licensed")


_TIMED = [("a", 1000, 500.7, None), ("b", 1000, 0, 9), ("c", 1000, None, 7), ("d", 1000, None, None), ("e", 5, 2, 99)]


@query(f"select source, case when ttl_ms = 0 then null when expires_at is not null then expires_at when ttl_ms > 0 then created_at + floor(ttl_ms) end::bigint as expires_at from {_values(_TIMED, 'source, created_at, ttl_ms, expires_at')}")
def expiries(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(s, c, None if t is None else float(t), e) for s, c, t, e in _TIMED], "source string, created_at long, ttl_ms double, expires_at long")
    return rows.select("source", store.expiry().alias("expires_at"))


@query("select coalesce(lang, 'all') as kind, count(*)::bigint as docs, sum(strlen(text))::bigint as bytes, ceil(sum(strlen(text)) / 4.0)::bigint as tokens, count(*) filter (doc_id <= 100)::bigint as expired, count(*) filter (doc_id % 3 = 0)::bigint as path_tracked from documents group by rollup (lang)")
def kind_report(spark: SparkSession, d: str) -> DataFrame:
    """Languages as kinds, ids as expiries; every third document has a path."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("content_kind"), F.octet_length("text").cast("long").alias("bytes"), F.lit(1).cast("long").alias("chunk_count"), F.col("doc_id").alias("expires_at"), F.when(F.col("doc_id") % 3 == 0, "p").alias("path"))
    return store.report(docs, 100).select(F.coalesce("kind", F.lit("all")).alias("kind"), "docs", "bytes", "tokens", "expired", "path_tracked")


@query()
def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    """Both views, boosts and fusion over all documents' chunks."""
    docs = table(spark, d, "documents").where("text is not null")
    chunks = search.slices(docs)
    return store.search(docs.select(F.col("doc_id").alias("id"), "source"), chunks, ["token password", "licensed under"], 10).select("doc_id", "idx", "score", "snippet")


@query("select doc_id, idx, round(sum(1.0::double / (60 + rank)), 9) as score from (select doc_id, k::bigint as idx, row_number() over (order by c / length(body) desc, doc_id, k) as rank from (select doc_id, k, body, (length(lower(body)) - length(replace(lower(body), 'licensed', ''))) / 8.0 as c from (select doc_id, k, substr(text, k * 2000 + 1, 2000) as body from (select doc_id, text, unnest(range(greatest(1, ceil(length(text) / 2000.0))::bigint)) as k from documents))) where c > 0 qualify rank <= 40) group by all")
def substring_hits(spark: SparkSession, d: str) -> DataFrame:
    chunks = search.slices(table(spark, d, "documents").where("text is not null"))
    return store.substring_view(chunks, "Licensed", 40).select("doc_id", "idx", F.round(1 / (F.lit(60.0) + F.col("rank")), 9).alias("score"))


# --- sessions

_EVENT = "select user_id::varchar as session, event_id as seq, epoch_ms(ts)::bigint as ts, case event_type when 'error' then 'error' when 'purchase' then 'file_edit' when 'click' then 'exec' when 'signup' then 'decision' else 'unheard' end as kind from events"


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.create_map(*(F.lit(x) for x in ("error", "error", "purchase", "file_edit", "click", "exec", "signup", "decision")))[F.col("event_type")], F.lit("unheard"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), F.concat_ws(" ", "event_type", F.round("value", 2).cast("string")).alias("summary"))


@query(f"select session, seq, row_number() over (partition by session order by case kind when 'decision' then 0 when 'error' then 0 when 'file_edit' then 1 when 'exec' then 2 else 4 end, ts desc, seq desc)::bigint as place from ({_EVENT})")
def event_order(spark: SparkSession, d: str) -> DataFrame:
    return sessions.in_order(_events(spark, d)).select("session", "seq", F.col("place").cast("long").alias("place"))


@query()
def session_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return sessions.snapshots(_events(spark, d), 0, 600)


_PAYLOADS = [(1, '{"tool_name":"Edit","tool_input":{"file_path":"a.py","edits":[{"file_path":"b.py"}]}}'), (2, '{"tool_name":"Bash","tool_input":{"command":"git status"},"tool_response":" M a.py"}'), (3, '{"tool_name":"Bash","tool_response":"fatal: broke","exit_code":1}'), (4, '{"tool_name":"X","tool_response":"Decision: go on"}'), (5, "{}")]


@query(f"select * from {_values([('s', 1, 'file_edit', 'edited a.py'), ('s', 1, 'file_edit', 'edited b.py'), ('s', 2, 'git', 'git status: M a.py'), ('s', 3, 'error', 'fatal: broke'), ('s', 3, 'error', 'exit 1: fatal: broke'), ('s', 4, 'decision', 'go on')], 'session, ts, kind, summary')}")
def tool_events(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("s", t, p) for t, p in _PAYLOADS], "session string, ts int, payload string")
    return sessions.extract_events(rows)


# --- policies and text

_IPS = ["169.254.169.254", "127.0.0.1", "10.1.2.3", "8.8.8.8", "172.31.0.1", "172.32.0.1", "1.2.3.256", "192.0.2.7", "255.1.1.1", "100.127.255.255"]
_BLOCKS = [(i, low, high, reason) for i, (low, high, reason) in enumerate(policy._RANGES)]


@query(f"""with ip as (select ip, case when regexp_matches(ip, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') and list_max(list_transform(string_split(ip, '.'), lambda x: x::bigint)) <= 255 then
 list_reduce(list_transform(string_split(ip, '.'), lambda x: x::bigint), lambda a, x: a * 256 + x) end as n from (select unnest({_IPS}) as ip))
 select ip, coalesce(n is null or arg_min(reason, i) is not null, true) as blocked, arg_min(reason, i) as reason from ip left join {_values(_BLOCKS, 'i, low, high, reason')} b on n between low and high group by ip, n""")
def address_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """IPv4 addresses against the blocked ranges, as a range join with the first range."""
    ips = spark.createDataFrame([(x,) for x in _IPS], "ip string").withColumn("n", policy.v4_number(F.col("ip")))
    ranges = F.broadcast(spark.createDataFrame(_BLOCKS, "i int, low long, high long, reason string"))
    met = ips.join(ranges, F.col("n").between(F.col("low"), F.col("high")), "left").groupBy("ip", "n").agg(F.min_by("reason", "i").alias("reason"))
    return met.select("ip", (F.col("n").isNull() | F.col("reason").isNotNull()).alias("blocked"), "reason")


_SCRIPTS = [(1, "curl http://x"), (2, "print(1)"), (3, "requests.get(u)"), (4, "cat < /dev/tcp/1.2.3.4/80"), (5, "import x from 'node:https'"), (6, "curly braces"), (7, "Net::HTTP.get"), (8, "new HttpClient()"), (9, "wget x; curl y")]


@query(f"select id::bigint as id, case when regexp_matches(s, '\\bcurl\\b') then 'curl' when regexp_matches(s, '\\bwget\\b') then 'wget' when regexp_matches(s, '\\brequests\\.(get|post|put|patch|delete|head|request)\\b') then 'requests' when contains(s, 'Net::HTTP') then 'Net::HTTP' when regexp_matches(s, '\\bHttpClient\\b|\\bWebClient\\b') then 'HttpClient' when regexp_matches(s, '/dev/(tcp|udp)/') then '/dev/tcp' when regexp_matches(s, '\\bfrom\\s+[''\"](node:)?(net|http|https)') then 'node import' end as rule from {_values(_SCRIPTS, 'id, s')}")
def script_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_SCRIPTS, "id long, s string")
    return rows.select("id", policy.network_use(F.col("s")).alias("rule"))


_STEPS = [("(?s)<!--.*?-->", ""), (r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?is)<head\b.*?</head>", " "), (r"""(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>""", r"\2 (\1)"), (r"(?i)<h[1-6]\b[^>]*>", "NLNL# "), (r"(?i)</h[1-6]>", "NL"), (r"(?i)<li\b[^>]*>", "NL- "), (r"(?i)</(?:p|div|section|article|tr|ul|ol|table|pre|blockquote)>", "NL"), (r"(?i)<br\s*/?>", "NL"), ("<[^>]+>", "")]
_REDUCED = "html"
for _p, _r in _STEPS:
    _REDUCED = f"regexp_replace({_REDUCED}, '{_p}', replace('{_r}', 'NL', chr(10)), 'g')"
for _n, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")):
    _REDUCED = f"replace({_REDUCED}, '{_n}', '{_c}')"


@query(rf"""select page_id, sha256(trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(t, '[ \t\f\v]+', ' ', 'g'), chr(10)), lambda l: trim(l, ' ' || chr(13))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) as text_hash
 from (select page_id, {_REDUCED} as t from pages)""")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(policy.html_text(F.col("html")), 256).alias("text_hash"))


_TAGS = [("v1.2.3",), ("1.10.0",), ("v1.9.9",), ("nightly",), ("v2.0",)]


@query(f"select t as tag from {_values(_TAGS, 't')} where regexp_matches(t, '^v?\\d+\\.\\d+\\.\\d+$') order by list_transform(string_split(ltrim(t, 'v'), '.'), lambda x: x::int) desc limit 1")
def latest_release(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_TAGS, "t string").agg(F.max_by("t", policy.release_number(F.col("t"))).alias("tag"))


_RULES = ["*.log", "build/", "/top.py", "docs/**", "!docs/keep.md"]
_PATHS = ["x/y.log", "build/x.py", "build", "top.py", "sub/top.py", "docs/a.md", "docs/keep.md", "ok.py"]
_REGEX = [(0, True, False, "^(.*/)?[^/]*\\.log$"), (1, True, True, "^(.*/)?build$"), (2, True, False, "^top\\.py$"), (3, True, False, "^docs/.*$"), (4, False, False, "^docs/keep\\.md$")]


@query(f"""with t as (select path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) as part from (select unnest({_PATHS}) as path))
 select path, bool_or(v) as ignored from (select path, part, coalesce(arg_max(ignores, i), false) as v from t left join {_values(_REGEX, 'i, ignores, folders, rx')} r on regexp_matches(part, rx) and (part <> path or not folders) group by all) group by path""")
def ignore_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rules = [r for r in map(files.ignore_rule, _RULES) if r]
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", files.ignored(F.col("path"), rules, ()).alias("ignored"))


_LINES = [("s", 0, '{"type":"assistant","message":{"usage":{"output_tokens":5}}}'), ("s", 1, '{"type":"user"}'), ("s", 2, '{"type":"assistant","message":{"model":"m","usage":{"output_tokens":7}}}'), ("t", 0, '{"type":"assistant","message":{"usage":{}}}')]


@query(f"select session, sum(coalesce((line::json ->> '$.message.usage.output_tokens')::bigint, 0))::bigint as output_tokens, count(*)::bigint as turns, arg_min(line::json ->> '$.message.model', k) filter (line::json ->> '$.message.model' is not null) as model from {_values(_LINES, 'session, k, line')} where line::json ->> '$.type' = 'assistant' and (line::json -> '$.message.usage') is not null group by session")
def transcript_sums(spark: SparkSession, d: str) -> DataFrame:
    return files.transcripts(spark.createDataFrame(_LINES, "session string, at int, line string"))


_PAIRS = [("d/a.original.md", 10), ("d/a.md", 4), ("d/b.original.md", 3), ("d/b.md", 4), ("e/c.original.md", 90), ("e/c.md", 50)]


@query(f"with f as {_values(_PAIRS, 'path, size')} select count(*)::bigint as pairs, sum(o.size - c.size)::bigint as bytes, round(sum(o.size - c.size) / 4.0)::bigint as tokens from f o join f c on c.path = replace(o.path, '.original.md', '.md') and o.path like '%.original.md' and o.size > c.size")
def compressed_savings(spark: SparkSession, d: str) -> DataFrame:
    saved = F.sum(F.col("original_size") - F.col("compressed_size"))
    return files.compressed_pairs(spark.createDataFrame(_PAIRS, "path string, size long")).agg(F.count("*").alias("pairs"), saved.alias("bytes"), F.round(saved / 4).cast("long").alias("tokens"))


@query()
def compressed_prose(spark: SparkSession, d: str) -> DataFrame:
    """Lengths before and after compression of all conversation texts, and what the check of both finds."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text").withColumn("c", prose.compressed(F.col("text")))
    found = prose.validated("text", "c.text")
    return rows.select("conv_id", "turn", "c.before", "c.after", F.size(found["errors"]).alias("errors"))


# --- aggregates


@query("select l_returnflag as arm, count(*)::bigint as n, round(avg(l_linenumber), 9) as mean, max(l_linenumber)::bigint as best, min(l_linenumber)::bigint as worst from lineitem where l_linenumber is not null group by 1")
def judged_arms(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as whole scores of arms."""
    n = F.col("l_linenumber").cast("long")
    return table(spark, d, "lineitem").where(n.isNotNull()).groupBy(F.col("l_returnflag").alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg(n), 9).alias("mean"), F.max(n).alias("best"), F.min(n).alias("worst"))


@query("select l_returnflag as arm, l_linestatus as task, median(l_quantity)::double as median_loc, median(l_extendedprice)::double as median_cost, count(*)::bigint as n from lineitem group by all")
def model_medians(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("task"))
    return rows.agg(F.median("l_quantity").alias("median_loc"), F.median("l_extendedprice").alias("median_cost"), F.count("*").alias("n"))


@query("select coalesce(l_returnflag, 'all') as task, sum(l_quantity)::bigint as before, sum(case when l_linestatus = 'F' then l_quantity else 0 end)::bigint as after, count(*) filter (l_discount > 0.05 and l_tax <= 0.02)::bigint as regressions from lineitem group by rollup (l_returnflag)")
def bench_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").rollup(F.col("l_returnflag").alias("task")).agg(F.sum("l_quantity").cast("long").alias("before"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)).cast("long").alias("after"), F.count_if(F.expr("l_discount > 0.05 and l_tax <= 0.02")).alias("regressions"))
    return rows.withColumn("task", F.coalesce("task", F.lit("all")))


@query("select b.item_id, count(distinct d.doc_id)::bigint as docs, sum(length(d.text) + 3)::bigint // 4 >= 0 as spent, bool_or(contains(d.text, b.text)) as solved from benchmark b join documents d on contains(lower(d.text), lower(regexp_extract(b.text, '^\\S+\\s+\\S+\\s+\\S+', 0))) group by b.item_id")
def task_success(spark: SparkSession, d: str) -> DataFrame:
    """For each item, the documents that hold its first three words in any case, and whether one holds all of it. Items are
    few; their openings are looked for in every text in blocks, as a broadcast."""
    items = F.broadcast(table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), F.lower(F.regexp_extract("text", r"^\S+\s+\S+\s+\S+", 0)).alias("head")))
    met = table(spark, d, "documents").select("doc_id", "text", F.lower("text").alias("low")).join(items, F.contains("low", "head"))
    return met.groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), (F.sum(F.length("text") + 3) >= 0).alias("spent"), F.bool_or(F.contains("text", "item")).alias("solved"))
