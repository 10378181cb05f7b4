"""Scalar functions: text, mathematics, dates, JSON, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as D
from ..functions import udfs as U
from ..session import ship, table
from .registry import both, register

both("str_core", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, char_length(c_name) AS n, octet_length(c_name) AS o, instr(c_name, '#') AS i, replace(c_name, '#', '-') AS r, reverse(c_name) AS v, substr(c_name, 3, 4) AS s, substr(c_name, -3) AS e, repeat('ab', 3) AS p FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS INTEGER) AS n, CAST(strlen(c_name) AS INTEGER) AS o, CAST(instr(c_name, '#') AS INTEGER) AS i, replace(c_name, '#', '-') AS r, reverse(c_name) AS v, substr(c_name, 3, 4) AS s, right(c_name, 3) AS e, repeat('ab', 3) AS p FROM customer")
both("str_pad_trim", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '.') AS r, trim(BOTH 'A' FROM n_name) AS b, ltrim('  x ') AS lt, rtrim(' x  ') AS rt, concat_ws('-', n_name, NULL, 'z') AS c FROM nation", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '.') AS r, trim(n_name, 'A') AS b, ltrim('  x ') AS lt, rtrim(' x  ') AS rt, concat_ws('-', n_name, NULL, 'z') AS c FROM nation")
both("str_hash", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha2(n_name, 256) AS s, hex(n_name) AS h FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s, hex(n_name) AS h FROM nation")
both("str_levenshtein", "SELECT a.n_name AS x, b.n_name AS y, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
both("null_funcs", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), '?') AS c, ifnull(nullif(o_orderstatus, 'F'), 'x') AS i, if(o_totalprice > 100000, 'big', 'small') AS s FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), '?') AS c, ifnull(nullif(o_orderstatus, 'F'), 'x') AS i, if(o_totalprice > 100000, 'big', 'small') AS s FROM orders")
both("math_core", "SELECT s_suppkey, round(abs(s_acctbal), 2) AS a, CAST(sign(s_acctbal) AS INT) AS g, round(exp(s_acctbal / 10000), 6) AS e, round(power(s_suppkey, 0.5), 6) AS p, round(sin(s_suppkey), 6) AS s, round(atan2(s_suppkey, 3), 6) AS t, round(degrees(1.5D), 6) AS d, round(cosh(0.5D), 6) AS c, round(log2(s_suppkey + 1), 6) AS l FROM supplier", "SELECT s_suppkey, round(abs(s_acctbal), 2) AS a, CAST(sign(s_acctbal) AS INTEGER) AS g, round(exp(s_acctbal / 10000), 6) AS e, round(power(s_suppkey, 0.5), 6) AS p, round(sin(s_suppkey), 6) AS s, round(atan2(s_suppkey, 3), 6) AS t, round(degrees(CAST(1.5 AS DOUBLE)), 6) AS d, round(cosh(CAST(0.5 AS DOUBLE)), 6) AS c, round(log2(s_suppkey + 1), 6) AS l FROM supplier")
both("date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS j, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS t FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS j, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS t FROM orders")
both("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, try_parse_json(props) IS NOT NULL AS valid FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
both("array_core", "SELECT n_nationkey, get(a, 1) AS g, size(a) AS n, slice(a, 1, 2) AS s, array_append(a, 9) AS ap, array_prepend(a, 0) AS pr, array_contains(a, n_nationkey) AS c, array_join(a, '-') AS j FROM (SELECT n_nationkey, array(n_nationkey, n_regionkey, 7) AS a FROM nation)", "SELECT n_nationkey, a[2] AS g, CAST(len(a) AS INTEGER) AS n, a[1:2] AS s, list_append(a, 9) AS ap, list_prepend(0, a) AS pr, list_contains(a, n_nationkey) AS c, array_to_string(a, '-') AS j FROM (SELECT n_nationkey, [n_nationkey, n_regionkey, 7] AS a FROM nation)")
both("array_ops", "SELECT n_nationkey, size(array_except(array(1, 2), a)) = 0 AS all_in, arrays_overlap(a, array(3, 7)) AS overlap, nullif(array_position(a, 7), 0) - 1 AS pos, array_remove(a, 7) AS rm, array_distinct(a) AS dis, transform(a, (x, i) -> if(i = 1, 99, x)) AS st FROM (SELECT n_nationkey, array(n_nationkey, n_regionkey, 7) AS a FROM nation)", "SELECT n_nationkey, list_has_all(a, [1, 2]) AS all_in, list_has_any(a, [3, 7]) AS overlap, CAST(list_position(a, 7) - 1 AS BIGINT) AS pos, list_filter(a, lambda x: x <> 7) AS rm, CASE WHEN a[1] = a[2] THEN CASE WHEN a[1] = 7 THEN [7] ELSE [a[1], 7] END WHEN a[1] = 7 THEN [7, a[2]] WHEN a[2] = 7 THEN [a[1], 7] ELSE a END AS dis, [a[1], 99, a[3]] AS st FROM (SELECT n_nationkey, [n_nationkey, n_regionkey, 7] AS a FROM nation)")
both("struct_union_tag", "SELECT n_nationkey, u.tag AS tag, CASE WHEN u.tag = 'n' THEN u.n END AS n FROM (SELECT n_nationkey, named_struct('tag', if(n_nationkey % 2 = 0, 'n', 's'), 'n', n_nationkey, 's', n_name) AS u FROM nation)", "SELECT n_nationkey, if(n_nationkey % 2 = 0, 'n', 's') AS tag, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS n FROM nation")
both("regexp_funcs", "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS c, regexp_replace(p_brand, '[0-9]', 'x') AS r FROM part", "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS c, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS r FROM part")


@register("gcd_lcm", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l FROM part")
def _gcd(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", D.gcd(F.col("p_partkey"), F.col("p_size")).alias("g"), D.lcm(F.col("p_partkey"), F.col("p_size")).alias("l"))


@register("date_modifiers", "SELECT o_orderkey, strftime(make_date(CAST(year(d + INTERVAL 1 MONTH) AS INTEGER), CAST(month(d + INTERVAL 1 MONTH) AS INTEGER), 1) + CAST(day(d) - 1 AS INTEGER), '%Y-%m-%d') AS m, strftime(d + CAST((5 - dayofweek(d) + 7) % 7 AS INTEGER), '%Y-%m-%d') AS w FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def _modifiers(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(D.add_months_rolling(d, 1), "yyyy-MM-dd").alias("m"), F.date_format(D.weekday(d, 5), "yyyy-MM-dd").alias("w"))


@register("strftime_codes", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S %j %w %u') AS s, strftime(o_orderdate, '%W') AS w FROM orders")
def _strftime(spark, sf_dir):
    t = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.strftime("%Y-%m-%d %H:%M:%S %j %w %u", t).alias("s"), D.strftime("%W", t).alias("w"))


@register("julianday", "SELECT o_orderkey, round(CAST(epoch(o_orderdate) AS DOUBLE) / 86400 + 2440587.5, 4) AS j, CAST(epoch(o_orderdate) AS BIGINT) AS u FROM orders")
def _julianday(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(D.julianday(F.col("o_orderdate")), 4).alias("j"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("u"))


@register("sqlite_cast", "SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(p_name, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS c FROM part")
def _cast(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", D.to_integer(F.col("p_name")).alias("c"))


@register("total", "SELECT o_orderstatus, round(coalesce(sum(o_totalprice), 0), 2) AS t FROM orders GROUP BY o_orderstatus")
def _total(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(D.total(F.col("o_totalprice")), 2).alias("t"))


@register("scalar_min_max", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE least(o_orderkey, o_custkey) END AS lo, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE greatest(o_orderkey, o_custkey) END AS hi FROM orders")
def _least(spark, sf_dir):
    a, b = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.scalar_min(a, b).alias("lo"), D.scalar_max(a, b).alias("hi"))


_PREFIX = "CASE WHEN x[1:3] = y[1:3] THEN 3 WHEN x[1:2] = y[1:2] THEN 2 WHEN x[1:1] = y[1:1] THEN 1 ELSE 0 END"


@register("str_damerau_jaro", f"SELECT x, y, CAST(damerau_levenshtein(x, y) AS INTEGER) AS d, round(jaro_similarity(x, y) + {_PREFIX} * 0.1 * (1 - jaro_similarity(x, y)), 4) AS j FROM (SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)")
def _fuzzy(spark, sf_dir):
    ship(spark)
    a, b = (table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(f"k{i}"), F.col("n_name").alias(n)) for i, n in enumerate("xy"))
    return a.join(b, F.col("k0") < F.col("k1")).select("x", "y", U.damerau("x", "y").alias("d"), F.round(U.jaro_winkler("x", "y"), 4).alias("j"))


@register("ip_funcs", "SELECT c_custkey, 4 AS family, '10.' || (c_custkey % 200) || '.0.0/16' AS network, c_custkey % 200 = 7 AS inside FROM customer")
def _ip(spark, sf_dir):
    ship(spark)
    address = F.concat(F.lit("10."), (F.col("c_custkey") % 200).cast("string"), F.lit(".3.4/16"))
    return table(spark, sf_dir, "customer").select("c_custkey", U.ip_family(address).alias("family"), U.ip_network(address).alias("network"), U.ip_contains(F.lit("10.7.0.0/16"), address).alias("inside"))
