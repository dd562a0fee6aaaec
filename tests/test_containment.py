import duckdb

from ctxlake.plans.catalog import ORACLE, QUERIES


def test_items_with_attached_characters_and_short_items(spark, tmp_path):
    texts = ["see longestword b c.", "xlongestword b c", "a b longestword%%%", "a\nb longestword", "p q\nr", "pp q\nrr", "one", "someone two", "", None, "a longer-middle c", "xa longer-middle cx", "a longer-middleX c"]
    items = ["longestword b c", "a b longestword", "p q\nr", "one", "one two", "", None, "a longer-middle c", " one ", " a b "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["benchmark_containment"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLE["benchmark_containment"]).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "item_id").collect())) == sorted(want)
    assert {(1, 0), (2, 1), (5, 2), (7, 3)} <= set(want)
