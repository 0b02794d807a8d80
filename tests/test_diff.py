"""The difference of two sides without a join: keys that repeat, null keys, orders without a status."""

from tomelight.plans import relational  # noqa: F401
from tomelight.plans.registry import QUERIES


def test_diff_both_sides(spark, tmp_path):
    orders = [(1, "F"), (2, "P"), (3, "O"), (3, "O"), (4, None), (None, "F"), (5, "P"), (5, "F"), (6, "P")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,), (2,), (2,), (4,), (5,), (7,), (None,)], "l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["q_diff_both_sides"](spark, str(tmp_path))
    found = sorted((r.side, r.k or 0) for r in df.collect())
    assert found == [("lost", 0), ("lost", 3), ("lost", 3), ("lost", 6), ("new", 0), ("new", 2), ("new", 4), ("new", 7)]
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
