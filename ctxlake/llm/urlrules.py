"""URL filters: fixed rules first, then rules that FP-growth mines from labelled URLs; DataFrame operations only.

A URL's tokens are its host and the domains above it, its path's folders without numbers, the file ending and the names
and pairs of its query. The first number in its path names the document that it serves, as in these crawls, whose label
is the URL's. FP-growth runs over the frequent tokens of all labelled URLs with the label as one more token; of tokens
that the very same URLs have, one stands for all, as their combinations would tell nothing more and double with each.
Rules towards "block" count where they are confident beyond the share of bad URLs: by MIN_LIFT times it (or half way from
it to 1, if that is less) and by SIGMAS standard errors, and where no shorter rule of part of their tokens is at least as
confident. The rules are matched through an inverted index: tokens join rules on the token, and a rule
matches where as many tokens met it as it has. The index and the matches are broadcast only where they are counted and
small.

Fixed rules name a host and the beginning of a path; a rule fits its host and all subdomains, and the longest that fits
decides. URLs that no fixed rule fits are blocked by any mined rule that matches and else allowed.

Null URLs and those without ``://`` have an empty host and path, no tokens, and are allowed. Repeated rows are judged
each. Labels are joined by ``doc_id``; null or unknown ids are left out; where an id has several labels, blocking counts.
Other columns aren't read. Without labels there are no mined rules. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlake.llm.columns import literal
from ctxlake.llm.common import small_side, staged

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MIN_SUPPORT, MIN_COUNT, MIN_LIFT, SIGMAS, BLOCK = 0.002, 8, 2.0, 3.0, "label=block"


def parts(url: str = "url") -> tuple[str, str]:
    """SQL for a URL column's host (A-Z lower-cased) and path."""
    rest = f"if(instr({url}, '://') > 0, substr({url}, instr({url}, '://') + 3), '')"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    path = f"regexp_extract(substr({rest}, length({host}) + 1), '^[^?#]*', 0)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"coalesce(translate({host}, '{upper}', '{lower}'), '')", f"coalesce({path}, '')"


def fixed_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[str, str]:
    """SQL for the longest fitting rule and its verdict, null if none fits. Rules are (verdict, host/path)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        h, slash, p = rule.partition("/")
        return f"(({host} = {literal(h)} or endswith({host}, {literal('.' + h)})) and startswith({path}, {literal(slash + p)}))"

    case = lambda pick: "case " + " ".join(f"when {fits(r)} then {literal(pick(v, r))}" for v, r in ordered) + " end" if ordered else "cast(null as string)"
    return case(lambda v, r: r), case(lambda v, r: v)


def tokens(host: str = "host", path: str = "path", url: str = "url") -> str:
    """SQL for the distinct tokens of a URL."""
    labels = f"split({host}, '\\\\.')"
    suffixes = f"if({host} = '', array(), transform(sequence(1, size({labels})), i -> concat('host=', array_join(slice({labels}, i, size({labels})), '.'))))"
    folders = f"transform(filter(split({path}, '/'), x -> x <> '' and not x rlike '[0-9]'), x -> concat('path=', x))"
    ending = f"transform(regexp_extract_all({path}, '\\\\.([A-Za-z]+)$', 1), x -> concat('ending=', x))"
    slash = f"if(length({path}) > 1 and endswith({path}, '/'), array('ending=/'), array())"
    query = f"split(regexp_extract({url}, '\\\\?([^#]*)', 1), '&')"
    asked = f"flatten(transform(filter({query}, x -> x <> ''), x -> array(concat('query=', x), concat('name=', substring_index(x, '=', 1)))))"
    return f"array_distinct(concat({suffixes}, {folders}, {ending}, {slash}, coalesce({asked}, array()), if(instr({url}, '#') > 0, array('fragment'), array())))"


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, tokens and target: the number that names the labelled document, or null."""
    host, path = parts()
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url").withColumn("host", F.expr(host)).withColumn("path", F.expr(path))
    target = "try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint)"
    return rows.withColumn("tokens", F.expr(f"if(host = '', cast(array() as array<string>), {tokens()})")).withColumn("target", F.expr(target))


def mine(parsed: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> DataFrame:
    """Mined rules (tokens, confidence, support, rule) towards blocking, from all labelled URLs of parse() with ``row``. A
    rule needs MIN_COUNT URLs at least, which guards small tables where ``min_support`` is less than that."""
    spark = parsed.sparkSession
    truth = labels.selectExpr("cast(doc_id as long) target", "toxic = 1 or quality = 0 bad").where("target is not null and bad is not null").groupBy("target").agg(F.max("bad").alias("bad"))
    labelled = staged(parsed.where("size(tokens) > 0").join(truth, "target").select("row", "bad", "tokens"), "labelled")
    n, n_bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if n < MIN_COUNT or not n_bad:
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double, rule string")
    share, base = min(1.0, max(min_support, MIN_COUNT / n)), n_bad / n
    confidence = min(min_lift * base, (1 + base) / 2)
    each = labelled.select("row", F.explode("tokens").alias("token"))
    # Tokens of a share of min_support of the URLs: as many as a URL's tokens over that share, at most.
    often = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).where(F.col("n") >= share * n)
    stands = staged(often.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token"), "tokens")
    kept = each.join(small_side(stands), "token").groupBy("row").agg(F.collect_list("token").alias("own"))
    baskets = staged(labelled.select("row", "bad").join(kept, "row").select(F.expr(f"if(bad, concat(own, array('{BLOCK}')), own)").alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    # FPGrowth's supports are shares of the baskets, which are fewer than n where a URL has no frequent token.
    n_baskets = baskets.count()
    error = F.sqrt(F.col("confidence") * (1 - F.col("confidence")) * F.col("confidence") / (F.col("support") * n_baskets))
    rules = model.associationRules.where((F.col("consequent")[0] == BLOCK) & (F.col("confidence") - SIGMAS * error > base)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    named = rules.withColumn("rule", F.array_join("tokens", " "))
    # A rule goes if part of its tokens makes a rule that is as confident: found through the tokens, not by pairs.
    each = named.select("rule", F.size("tokens").alias("n"), "confidence", F.explode("tokens").alias("token"))
    big = each.select(F.col("rule").alias("longer"), F.col("n").alias("n_longer"), F.col("confidence").alias("c_longer"), "token")
    met = each.join(big, "token").where("n < n_longer and confidence >= c_longer").groupBy("longer", "rule", "n").count().where("count = n")
    return named.join(met.select(F.col("longer").alias("rule")).distinct(), "rule", "left_anti")


def match(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """page rows (``row``) that a mined rule matches, with the most confident one and of those the greatest by name."""
    index = staged(rules.select("rule", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "index")
    hits = parsed.select("row", F.explode("tokens").alias("token")).join(small_side(index), "token")
    met = hits.groupBy("row", "rule").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("confidence").alias("confidence")).where("met = n")
    return met.groupBy("row").agg(F.max(F.struct("confidence", "rule")).alias("m")).select("row", F.col("m.rule").alias("mined"), F.col("m.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] | None = None, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, the fixed rule or null, the verdict, and the mined rule
    that matches, if any, with its confidence."""
    parsed = staged(parse(pages).withColumn("row", F.monotonically_increasing_id()), "urls")
    mined = staged(mine(parsed, labels, min_support, min_lift), "rules")
    # Many pages have the same tokens: each set is matched once.
    sets = parsed.where("size(tokens) > 0").select(F.array_sort("tokens").alias("tokens")).distinct().select(F.array_join("tokens", " ").alias("row"), "tokens")
    matched = small_side(staged(match(sets, mined).withColumnRenamed("row", "key"), "matched"))
    rule, verdict = fixed_rule(RULES if rules is None else rules)
    out = parsed.withColumn("key", F.array_join(F.array_sort("tokens"), " ")).join(matched, "key", "left")
    return out.select("page_id", "host", "path", F.expr(rule).alias("rule"), F.coalesce(F.expr(verdict), F.when(F.col("mined").isNotNull(), "block"), F.lit("allow")).alias("verdict"), F.col("mined").alias("mined_rule"), "confidence")
