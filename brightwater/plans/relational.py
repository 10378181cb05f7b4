"""Scans, predicates, joins, aggregates, ordering, set operations, CTEs and corpus queries in SQL."""

from __future__ import annotations

from .registry import both

# scans, projections, predicates
both("scan_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
both("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 200000) AND NOT o_orderpriority = '1-URGENT'")
both("filter_between_in", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#3')")
both("filter_like_ci", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%g'")
both("filter_regexp", "SELECT event_id FROM events WHERE event_type RLIKE '^(click|view)$'", "SELECT event_id FROM events WHERE regexp_matches(event_type, '^(click|view)$')")
both("filter_null_safe", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F'")
both("filter_is_true", "SELECT o_orderkey, (nullif(o_orderstatus, 'O') = 'F') IS TRUE AS f, (nullif(o_orderstatus, 'O') = 'F') IS NOT FALSE AS nf FROM orders")
both("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END AS s FROM orders")
both("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS s FROM part")
both("cast_ops", "SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS whole, coalesce(try_cast(regexp_extract(p_brand, '[0-9]+', 0) AS BIGINT), 0) AS n FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS whole, coalesce(TRY_CAST(regexp_extract(p_brand, '[0-9]+', 0) AS BIGINT), 0) AS n FROM part")
both("int_div_mod", "SELECT o_orderkey, o_orderkey div nullif(o_custkey, 0) AS q, try_mod(o_orderkey, o_custkey) AS m FROM orders", "SELECT o_orderkey, o_orderkey // nullif(o_custkey, 0) AS q, o_orderkey % nullif(o_custkey, 0) AS m FROM orders")
both("bitwise", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 16 AS b, ~o_orderkey AS c, shiftleft(o_orderkey, 2) AS d, shiftright(o_orderkey, 1) AS e FROM orders", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 16 AS b, ~o_orderkey AS c, o_orderkey << 2 AS d, o_orderkey >> 1 AS e FROM orders")
both("row_value_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
both("row_value_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE struct(l_orderkey, l_linenumber) < struct(CAST(100 AS BIGINT), 3)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (100, 3)")
both("values_inline", "SELECT a, b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL) AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
both("constant_row", "SELECT 1 AS one, 'x' || 'y' AS s")
both("generate_series", "SELECT explode(sequence(CAST(10 AS BIGINT), CAST(-10 AS BIGINT), CAST(-5 AS BIGINT))) AS value", "SELECT unnest(range(CAST(10 AS BIGINT), CAST(-11 AS BIGINT), CAST(-5 AS BIGINT))) AS value")
both("any_all_array", "SELECT p_partkey, exists(array(1, 5, 9), x -> x = p_size) AS any_eq, forall(array(1, 5, 9), x -> x < p_size) AS all_lt FROM part", "SELECT p_partkey, p_size IN (1, 5, 9) AS any_eq, p_size > 9 AS all_lt FROM part")

# joins
both("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
both("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
both("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 150000")
both("join_full", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') a FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) b ON a.o_orderkey = b.o_orderkey")
both("full_theta", "SELECT r.r_name, n.n_name FROM region r FULL JOIN nation n ON r.r_regionkey > n.n_nationkey")
both("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) b")
both("join_using", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)")
both("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
both("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("in_subquery", "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
both("not_in_subquery_nulls", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 3) FROM customer WHERE c_custkey < 5)")
both("join_lateral", "SELECT o_orderkey, x FROM orders, LATERAL (SELECT explode(array(o_orderkey, o_custkey)) AS x)", "SELECT o_orderkey, unnest([o_orderkey, o_custkey]) AS x FROM orders")
both("join_multi_five_way", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")

# aggregates
both("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
both("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, coalesce(sum(o_totalprice), 0.0D) AS total FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, sum(o_totalprice) AS s, coalesce(sum(o_totalprice), CAST(0 AS DOUBLE)) AS total FROM orders WHERE o_orderkey < 0")
both("group_by_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
both("group_by_expr", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
both("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
both("count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")
both("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS tax FROM lineitem GROUP BY l_returnflag")
both("group_concat_sorted", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("array_agg_sorted", "SELECT n_regionkey, transform(array_sort(collect_list(struct(n_nationkey, nullif(n_name, 'x') AS v))), e -> e.n_nationkey) AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS ks FROM nation GROUP BY n_regionkey")
both("stddev", "SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS s, round(var_samp(o_totalprice) / 1e6, 4) AS v FROM orders GROUP BY o_orderpriority")
both("median", "SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")
both("percentile_cont", "SELECT l_returnflag, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p FROM lineitem GROUP BY l_returnflag")
both("percentile_disc", "SELECT l_returnflag, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_extendedprice) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.25) AS p FROM lineitem GROUP BY l_returnflag")
both("percentile_disc_text", "SELECT n_regionkey, n_name AS p FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r, count(n_name) OVER (PARTITION BY n_regionkey) AS n FROM nation WHERE n_name IS NOT NULL) WHERE r = ceil(0.5 * n)", "SELECT n_regionkey, quantile_disc(n_name, 0.5) AS p FROM nation GROUP BY n_regionkey")
both("mode", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS m FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
both("json_group_array", "SELECT n_regionkey, to_json(array_sort(collect_list(n_name))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
both("json_group_object", "SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
both("min_by_bare_column", "SELECT o_custkey, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS k, min(o_totalprice) AS m FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS k, min(o_totalprice) AS m FROM orders GROUP BY o_custkey")
both("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
both("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("agg_order_by", "SELECT o_custkey, transform(array_sort(collect_list(struct(o_orderdate, o_orderkey))), e -> e.o_orderkey) AS ks FROM orders GROUP BY o_custkey", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS ks FROM orders GROUP BY o_custkey")

# ordering, limits, distinct, set operations, CTEs
both("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
both("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
both("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
both("distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
both("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
both("compound_mixed", "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT s_nationkey FROM supplier")
both("cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT avg(s) AS m FROM a) SELECT o_custkey FROM a, b WHERE s > 2 * m")
both("recursive_counter", "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 50) SELECT n FROM c")
both("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
both("correlated_scalar_avg", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > 1.8 * (SELECT avg(l_quantity) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey)")

# corpus
both(
    "tpch_q1",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    None,
    "lineitem",
)
both("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
both("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority")
both("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
both("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
both("tpch_q7", "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_nationkey < n2.n_nationkey GROUP BY 1, 2, 3", "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_nationkey < n2.n_nationkey GROUP BY 1, 2, 3")
both("tpch_q10", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
both("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey")
both("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.5 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)")
both("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice")
both("clickbench_events_by_type", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS v FROM events GROUP BY event_type")
both("clickbench_top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
both("clickbench_docs_by_source", "SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source, lang", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
both("streak_longest", "WITH d AS (SELECT DISTINCT user_id, to_date(ts) AS day FROM events), g AS (SELECT user_id, day, date_sub(day, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT)) AS grp FROM d), s AS (SELECT user_id, grp, count(*) AS n FROM g GROUP BY user_id, grp) SELECT user_id, max(n) AS longest FROM s GROUP BY user_id", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS grp FROM d), s AS (SELECT user_id, grp, count(*) AS n FROM g GROUP BY user_id, grp) SELECT user_id, max(n) AS longest FROM s GROUP BY user_id")
