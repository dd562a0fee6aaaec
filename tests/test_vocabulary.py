"""Frequent words of documents, against a plain count."""

import random
import re
from collections import Counter, defaultdict

from ctxlake.functions.text import STOPWORDS
from ctxlake.operators import search


def plain(rows, limit):
    counts = defaultdict(Counter)
    for doc_id, text in rows:
        counts[doc_id].update(w for w in re.findall(r"\w+", (text or "").lower()) if len(w) >= 3 and w not in STOPWORDS and not re.fullmatch("[0-9]+", w))
    return {(d, w, n, i + 1) for d, c in counts.items() for i, (w, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:limit])}


def test_words_are_counted_within_texts_and_over_rows_of_one_id(spark):
    rng = random.Random(3)
    words = ["the", "ab", "abc", "ABC", "abcd", "123", "12a", "_x_", "größe", "слово", "𐐨𐐨𐐨", "𐐨𐐨", "日本語", *(f"w{i:03}" for i in range(60))]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "-", ". "]) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    rows += [(7, rows[8][1]), (7, None), (9, rows[9][1]), (50, None), (51, ""), (52, "to 12 -"), (None, "one two two"), (None, "two three"), (53, "x" * 5000 + " end " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1, 3, 15):
        for way in (search.vocabulary, search.merged_vocabulary):
            got = way(df, limit)
            assert got.dtypes == [("doc_id", "bigint"), ("term", "string"), ("tf", "bigint"), ("rank", "bigint")]
            assert Counter(tuple(r) for r in got.collect()) == Counter(plain(rows, limit))
    # A text's words leave it counted, so none goes into a shuffle for itself.
    assert "explode(regexp_extract_all" not in search.vocabulary(df)._jdf.queryExecution().executedPlan().toString()
