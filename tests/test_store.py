"""Chunks, the store and ranked retrieval, against facts stated by hand and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ctxlake.functions import text as T
from ctxlake.operators import search, store


def docs_of(spark, *rows):
    return spark.createDataFrame([(s, c) for s, c in rows], "source string, content string")


@pytest.fixture(scope="module")
def kept(spark):
    return store.index(docs_of(spark, ("payments.log", "the gateway returned 500\nretry of the payment\nrefund issued"), ("misc-notes", "the gateway returned 500\nretry of the payment\nrefund issued"), ("code", "call foo() and bar() in one function"), ("long", "filler words here. " * 90 + "\n\nlast quarter payments grew"), ("far", "payment " + "x " * 300 + "refund"), ("near", "payment refund")))


def test_chunks_against_plain_python(spark):
    rng = random.Random(4)
    texts = ["a\n\nb\n\nc", "x" * 5000, "", "\n\n \n\n", *("".join(rng.choices(["ab", "c d", "\n\n", "\n", "\n\n\n", " ", "longerword"], k=rng.randint(0, 40))) for _ in range(120))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size in (5, 20, 2000):
        got = {}
        for r in search.paragraphs(df, size).orderBy("doc_id", "idx").collect():
            got.setdefault(r.doc_id, []).append(r.body)
        assert [got.get(i, []) for i in range(len(texts))] == [search.packed(re.split(r"\n{2,}", t), size) for t in texts]
    assert search.packed(["x" * 5000], 2000) == ["x" * 2000, "x" * 2000, "x" * 1000] and search.packed(re.split(r"\n{2,}", "a\n\nb\n\nc"), 1) == ["a", "b", "c"]


def test_markdown_keeps_fences_and_headings(spark):
    text = "# One\nintro\n\n```py\na = 1\n\nb = 2\n```\n\n## Two\nmore text\n" + "word " * 50
    parts = search.markdown_chunks(text, 120)
    assert any(p.startswith("# One") and "intro" in p for p in parts) and any("```py\na = 1\n\nb = 2\n```" in p for p in parts) and any(p.startswith("## Two") for p in parts)
    df = spark.createDataFrame([(1, text), (2, "plain\n\ntext"), (3, None)], "doc_id int, text string")
    assert [r.body for r in search.chunked(df, 120).where("doc_id = 1").orderBy("idx").collect()] == parts
    assert [r.body for r in search.chunked(df).where("doc_id = 2").collect()] == ["plain\n\ntext"]
    assert search.fences("a ```x\ny``` b") == [(False, "a "), (True, "```x\ny```"), (False, " b")] and search.fences("```x\nopen") == [(False, "```x\nopen")]


def test_indexing_again_changes_nothing(spark, kept):
    docs, chunks = kept
    assert docs.count() == 6 and store.healthy(docs, chunks) and not store.healthy(docs.unionByName(docs), chunks)
    new, _ = store.index(docs_of(spark, ("near", "payment refund"), ("new", "x"), ("new", "x")), docs)
    assert [r.source for r in new.collect()] == ["new"]
    timed = spark.createDataFrame([("a", "x", 1000, 500.7, None, "p"), ("b", "y", 1000, 0.0, 9, None), ("c", "z", 1000, None, 7, ""), ("d", "w", 1000, None, None, None)], "source string, content string, created_at long, ttl_ms double, expires_at long, path string")
    new, own = store.index(timed)
    assert {r.source: r.expires_at for r in new.collect()} == {"a": 1500, "b": None, "c": 7, "d": None}
    left, rest = store.purge(new, own, now=1500)
    assert {r.source for r in left.collect()} == {"b", "d"} and rest.count() == 2 and store.purge(new, own)[0].count() == 0
    one = new.where("source = 'a'").first().id
    assert store.purge(new, own, doc_id=one)[0].count() == 3
    total = store.report(new, 1500).where("kind is null").first()
    assert (total.docs, total.bytes, total.expired, total.path_tracked, total.ttl_tracked) == (4, 4, 2, 1, 2)
    assert store.migrated(new.drop("path", "content_kind")).columns.count("path") == 1
    small, large = store.offload(docs_of(spark, ("a", "x" * 102_400), ("b", "x" * 102_401)))
    assert [r.source for r in small.collect()] == ["a"] and [r.source for r in large.collect()] == ["b"]


def test_search(spark, kept):
    docs, chunks = kept
    names = {r.id: r.source for r in docs.collect()}
    found = lambda q, **o: [names[r.doc_id] for r in store.search(docs, chunks, q, **o).collect()]
    assert found("payments gateway")[0] == "payments.log"  # stems meet, and the source raises it
    assert found("foo()") == ["code"] and found("uarter") == ["long"]
    assert found('" OR 1=1') == [] and found("  ") == [] and found("the")
    hits = found("payment refund", limit=6)
    assert hits.index("near") < hits.index("far")
    fixed = store.search(docs, chunks, "paymnt refnd").collect()
    assert fixed and "payment refund" in fixed[0].corrected and not store.search(docs, chunks, "zzzqqq").collect()
    only = docs.where("source = 'far'").first().id
    assert found("payment", doc_id=only) == ["far"]
    both = store.search(docs, chunks, ["foo()", "uarter"]).collect()
    assert {names[r.doc_id] for r in both} == {"code", "long"} and all(r.score == round(1 / 61, 9) for r in both)
    assert "[refund]" in store.search(docs, chunks, "refund", limit=1).first().snippet
    many = store.batch(docs, chunks, [{"queries": "foo()"}, {"queries": "refund", "limit": 2}]).collect()
    assert [r.item for r in many] == [0, 1, 1]
    top, words = store.by_intent(docs, chunks, only, "refund", search.vocabulary)
    assert top.count() == 1 and {r.term for r in words.collect()} == {"payment", "refund"}


def test_staleness(spark, kept):
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.createDataFrame([("a", "p1", h("x")), ("b", "p2", h("x")), ("c", "p3", h("x")), ("d", None, h("x")), ("e", "p1", None), ("f", "p4", h("x"))], "id string, path string, content_hash string")
    files = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p4", None)], "path string, content string")
    got = {r.doc_id: (r.stale, r.reason) for r in store.stale(docs.select(F.col("id").alias("doc_id")), docs, files).collect()}
    assert got == {"a": (False, None), "b": (True, "changed"), "c": (True, "missing"), "d": (False, None), "e": (False, None), "f": (True, "unreadable")}


def test_kinds_and_lines(spark):
    rows = {"def f():\n    return 1;\nimport x\nclass A {\n}\nconst a = 1;\nlet b;\n": "code", "the cat and the dog with that hat": "prose", "```\nx\n```\n" + "the and with from that this the and ": "mixed"}
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.content_kind(F.col("t")).alias("k")).collect()}
    assert got == rows
    lines = {"```py\na\n\n# c\n```\ntext\n```\nb\n/* x\ny */\n// z\n* w\n```": 2, "a\n\n  # b\nc": 2, "": 0}
    assert {r.t: r.n for r in spark.createDataFrame([(t,) for t in lines], "t string").select("t", T.lines_of_code(F.col("t")).alias("n")).collect()} == lines
    found = store.matching_lines(spark.createDataFrame([(1, "a\nFoo b\r\nx foo"), (2, "no")], "doc_id int, text string"), "foo").orderBy("n").collect()
    assert [(r.n, r.line) for r in found] == [(2, "Foo b"), (3, "x foo")]
