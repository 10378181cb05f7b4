"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.windows import exclude, filter_over, groups_frame
from ..session import table
from .registry import both, register

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
both("row_number", f"SELECT o_orderkey, row_number() OVER ({_W}) AS rn FROM orders", f"SELECT o_orderkey, CAST(row_number() OVER ({_W}) AS INTEGER) AS rn FROM orders")
both("rank_dense_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS d FROM part")
both("percent_rank_cume_dist", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS c FROM part")
both("ntile", f"SELECT o_orderkey, ntile(4) OVER ({_W}) AS t FROM orders", f"SELECT o_orderkey, CAST(ntile(4) OVER ({_W}) AS INTEGER) AS t FROM orders")
both("lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER ({_W}) AS a, lead(o_totalprice, 2, -1.0D) OVER ({_W}) AS b FROM orders", f"SELECT o_orderkey, lag(o_totalprice) OVER ({_W}) AS a, lead(o_totalprice, 2, CAST(-1 AS DOUBLE)) OVER ({_W}) AS b FROM orders")
both("first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W}) AS f, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_W}) AS n FROM orders")
both("running_sum", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W}), 2) AS s FROM orders")
both("rows_moving_avg", f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS a FROM orders")
both("range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part")
both("moving_min_max", f"SELECT o_orderkey, min(o_totalprice) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS lo, max(o_totalprice) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi FROM orders")
both("named_windows", "SELECT o_orderkey, count(*) OVER w AS n, min(o_orderkey) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey)")
both("topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
both("distinct_over_window", "SELECT DISTINCT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
both("group_concat_over", f"SELECT o_orderkey, concat_ws(',', collect_list(o_orderkey) OVER ({_W})) AS s FROM orders", f"SELECT o_orderkey, string_agg(CAST(o_orderkey AS VARCHAR), ',') OVER ({_W}) AS s FROM orders")


@register("groups_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part")
def _groups(spark, sf_dir):
    return groups_frame(table(spark, sf_dir, "part"), ["p_brand"], ["p_size"], -1, 1, {"s": lambda w: F.sum("p_size").over(w)}).select("p_partkey", "s")


def _excluded(kind: str, how: str):
    sql = f"SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND CURRENT ROW EXCLUDE {how}) AS BIGINT) AS s FROM part"

    @register(f"exclude_{kind}", sql)
    def run(spark, sf_dir):
        return exclude(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_size", "s", kind, -3, 0).select("p_partkey", "s")


_excluded("current", "CURRENT ROW")
_excluded("group", "GROUP")
_excluded("ties", "TIES")


_FRAME = "(PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP)"


@register("exclude_aggregates", f"SELECT p_partkey, count(p_size) OVER {_FRAME} AS n, round(avg(p_size) OVER {_FRAME}, 6) AS a, min(p_partkey) OVER {_FRAME} AS lo, max(p_partkey) OVER {_FRAME} AS hi FROM part")
def _exclude_aggregates(spark, sf_dir):
    out = table(spark, sf_dir, "part")
    for value, name, aggregate in (("p_size", "n", "count"), ("p_size", "a", "avg"), ("p_partkey", "lo", "min"), ("p_partkey", "hi", "max")):
        out = exclude(out, ["p_brand"], "p_size", value, name, "group", -3, 2, aggregate)
    return out.select("p_partkey", "n", F.round("a", 6).alias("a"), "lo", "hi")


@register("filter_over", f"SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'O') OVER ({_W}) AS n FROM orders")
def _filter_over(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", filter_over(F.count, F.lit(1), F.col("o_orderstatus") == "O").over(w).alias("n"))
