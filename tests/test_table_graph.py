"""The graph of a folder's keys, against the operators on edges of strings."""

from pyspark.sql import functions as F

from ctxlake.operators import graph
from ctxlake.plans.catalog import QUERIES

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "A"), (1, "B")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "a", 0), (1, "b", 1), (2, "c", 9), (3, "d", None)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "x", 0), (2, "y", 1), (2, "y", 1), (3, "z", 7)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int", [(1, "x", 0), (4, "y", None), (None, "z", 1)]),
    "part": ("p_partkey long, p_name string", [(1, "x"), (2, "y"), (None, "z")]),
    "lineitem": ("l_suppkey long, l_partkey long", [(1, 1), (1, 1), (1, 2), (2, 1), (2, 5), (9, 1), (None, 1), (3, None), (3, 2)]),
}


def test_relations_are_counted_as_on_clean_edges(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    nodes, edges = graph.from_tables(spark, str(tmp_path))
    want = {r.relation: r["count"] for r in graph.clean_edges(nodes, edges).groupBy("relation").count().collect()}
    got = QUERIES["relation_histogram"](spark, str(tmp_path))
    assert {r.relation: r.n for r in got.collect()} == want == {"in_region": 2, "in_nation": 3, "supplies": 4}
    assert edges.where("relation = 'supplies'").count() == 8  # all but the repeated pair
    for plan in (got, edges.where(F.col("relation") == "supplies")):  # pairs are told apart as numbers
        text = plan._jdf.queryExecution().sparkPlan().toString()
        assert "keys=[source" not in text and ("keys=[l_suppkey" in text or "keys=[x" in text or "keys=[y" in text)
