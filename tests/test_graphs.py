"""Graph operators over long chains."""

import pytest

from tidewright.operators import graphs


def test_back_trace_follows_a_long_chain(spark):
    n = 2500
    steps = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end as parent")
    got = graphs.back_trace(steps, spark.createDataFrame([(n - 1,), (3,)], "id long")).collect()
    assert sorted((r.path, r.seq, r.id) for r in got) == sorted((end, i, end - i) for end in (3, n - 1) for i in range(end + 1))


def test_back_trace_of_a_circle(spark):
    with pytest.raises(RuntimeError):
        graphs.back_trace(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"), spark.createDataFrame([(1,)], "id long")).count()


def test_hops_have_no_bound(spark, tmp_path):
    """A chain of 30 links, which bfs_hops once left after 12."""
    from tidewright.plans.grid_queries import QUERIES

    keys = [(i, ((i + 1) * 4 + j)) for i in range(30) for j in range(400) if ((i + 1) * 4 + j) % 97 == 0 and (((i + 1) * 4 + j) // 4) % 60 == i + 1]
    more = [(i, key) for i in range(30) if i not in {k for k, _ in keys} for key in range(97, 97 * 4000, 97) if (key // 4) % 60 == i + 1][:4000]
    spark.createDataFrame(keys + more, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.id: r.dist for r in QUERIES["bfs_hops"](spark, str(tmp_path)).collect()} == {i: i for i in range(31)}
