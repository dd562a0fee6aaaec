"""The operators' queries over the whole tables of a data folder, and SQL for those that SQL can express in time."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlake.llm import chat, decontam, hostrules, licenses, neardup, packing, quality, secretscan, tokenfile, urlrules
from ctxlake.sources import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), urlrules.RULES)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").unionByName(odd)
    return chat.digest(chat.format_records(chat.from_turns(rows)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a tree: source/number of hundred/id.txt; each hundred's first document is its LICENSE file."""
    name = F.expr("if(doc_id % 100 = 0, 'LICENSE', concat(doc_id, '.txt'))")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.expr("cast(doc_id div 100 as string)"), name).alias("path"), "text")
    return licenses.scan(files)


def op5_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8), least_items=2)


def op9_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.apply_rules(table(spark, sf_dir, "documents"), host_col="source")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents"), repo="doc_id", owner="source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_url_filters, op3_chat_formatting, op4_license_scan, op5_hyperminhash_near_dedup,
        op6_quality_classifier, op7_simple8b_tokens, op8_benchmark_decontamination, op9_host_quality_rules, op10_secret_scan,
    )
}

_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
_TURNS = r"""select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'"""
_ROLE = f"replace(replace({_ESCAPED.format('role')}, ':', '\\c'), chr(10), '\\n')"

_OP3 = f"""select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 sum(4 + length({_ROLE}) + 2 + length({_ESCAPED.format('text')}) + 8)::bigint as formatted_chars, 'messages' as layout from ({_TURNS}) group by conv_id"""

_WORDS8 = "regexp_extract_all(" + _LOWERED.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP8 = f"""with d as (select row_number() over () as r, doc_id, {_WORDS8} as w from documents), b as (select item_id, {_WORDS8} as w from benchmark where item_id is not null),
 p as (select distinct item_id, least(8, len(w)) as k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') as x from (select item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from b where len(w) > 0)),
 t as (select r, i, k, array_to_string(w[i:i + k - 1], ' ') as x from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from p) where len(w) >= k)),
 m as (select t.r, t.i, t.k, p.item_id from t join p on t.k = p.k and t.x = p.x),
 h as (select r, count(distinct q) as n from (select r, unnest(range(i, i + k)) as q from m) group by r),
 o as (select r, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from m) group by r)
 select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(o.n, 0)::bigint as n_items, sha256(coalesce(o.ids, '')) as items_sha256, coalesce(o.n, 0) >= 2 as contaminated from d left join h using (r) left join o using (r)"""

_OP9 = r"""with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as t from documents),
 l as (select r, regexp_extract_all(t, '[^ \t\n\v\f\r]+') as ws from d), w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as p from l),
 x as (select r, p, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o as x from w window o as (partition by r order by p)),
 i as (select r, count(distinct q) as n from (select r, unnest([p, p + 1, p + 2]) as q from (select r, p, count(*) over (partition by r, x) as c from x where x is not null) where c > 1) group by r),
 u as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^ \t\n\v\f\r]') group by r),
 f as (select doc_id, host, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(u.n, 0)::bigint as n_dup_lines, coalesce(i.n, 0)::bigint as n_repeat_words, (len(ws) < 50 or 100 * coalesce(i.n, 0) > 50 * len(ws)) as base_failed from d join l using (r) left join i using (r) left join u using (r)),
 c as (select host, count(*) as n, count(*) filter (base_failed) as failed from f group by host), m as (select avg(failed / n) as mean, var_pop(failed / n) as spread, avg(1 / n) as noise from c),
 g as (select mean, least(1e6, greatest(2.0::double, mean * (1 - mean) / greatest(1e-9::double, spread - mean * (1 - mean) * noise) - 1)) as k from m),
 s as (select host, n, k, (failed + mean * k) / (n + k) as rate from c, g), v as (select host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > 0.5 as bad from s)
 select doc_id, f.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad as kept, round(rate, 9)::double as host_rate, case when bad then 'drop' else 'keep' end as host_verdict
 from f join v on f.host is not distinct from v.host"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = [("assign", _ASSIGN, 1, "length(v) >= 8"), ("access", "AKIA[A-Z0-9]{12,}", 0, "true"), ("hex", "[0-9a-f]{32,}", 0, "true"), ("mixed", "[A-Za-z0-9+/_=-]{24,}", 0, "regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')"), ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, "true")]
_FOUND = " union all ".join(f"""select r, {i} as rank, '{k}' as kind, s - length(h) as a, s as z, v from (select r, h, v, sum(length(g) + length(h)) over (partition by r order by n) as s from
 (select r, unnest(regexp_extract_all(t, '{p}', 0)) as h, unnest(regexp_extract_all(t, '{p}', {group})) as v, unnest(string_split_regex(t, '{p}')[1:len(regexp_extract_all(t, '{p}', 0))]) as g, generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) as n from d)) where {ok}""" for i, (k, p, group, ok) in enumerate(_SECRETS))
_OP10 = f"""with d as (select row_number() over () as r, doc_id, source as owner, coalesce(text, '') as t from documents), f as ({_FOUND}),
 e as (select * from f where rank < 3 union all select * from f x where rank >= 3 and not exists (select 1 from f b where b.r = x.r and b.rank < 3 and x.a < b.z and b.a < x.z)),
 o as (select v, count(distinct coalesce(owner, chr(0))) as owners, count(distinct coalesce(doc_id::varchar, chr(0))) as repos from e join d using (r) group by v),
 s as (select r, rank, kind, kind || ':' || a || ':' || z as txt, a, z, owners <= 2 and repos <= 20 as live from e join o using (v)),
 k as (select r, count(*) filter (kind = 'assign') as n1, count(*) filter (kind = 'access') as n2, count(*) filter (kind = 'hex') as n3, string_agg(txt, ',' order by a, rank) filter (rank < 3) as base, string_agg(txt, ',' order by a, rank) as everything, count(*) filter (live) as n from s where live or rank < 3 group by r)
 select doc_id, coalesce(n1, 0)::bigint as n_assign, coalesce(n2, 0)::bigint as n_access, coalesce(n3, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(everything, '') as spans, coalesce(n, 0)::bigint as n_live from d left join k using (r)"""

#: SQL for the same rows. Trained models, tokenizers, FP-growth, cosines and components have none: tests hold these against
#: brute force.
ORACLE: dict[str, str] = {"op3_chat_formatting": _OP3, "op8_benchmark_decontamination": _OP8, "op9_host_quality_rules": _OP9, "op10_secret_scan": _OP10}
