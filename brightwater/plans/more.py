"""Further text, time, JSON, map and array functions."""

from __future__ import annotations

from .registry import both

both("str_encode", "SELECT n_nationkey, base64(CAST(n_name AS BINARY)) AS b, hex(n_name) AS h, CAST(unhex(hex(n_name)) AS STRING) AS u FROM nation", "SELECT n_nationkey, to_base64(encode(n_name)) AS b, hex(n_name) AS h, decode(unhex(hex(n_name))) AS u FROM nation")
both("str_slugify", "SELECT p_partkey, trim(BOTH '-' FROM regexp_replace(lower(p_brand), '[^a-z0-9]+', '-')) AS s FROM part", "SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part")
both("str_unicode", "SELECT n_nationkey, ascii(n_name) AS c, char(65) AS a FROM nation", "SELECT n_nationkey, unicode(n_name) AS c, chr(65) AS a FROM nation")
both("str_hamming", "SELECT a.n_name AS x, b.n_name AS y, size(filter(zip_with(split(a.n_name, ''), split(b.n_name, ''), (p, q) -> p <> q), d -> d)) AS d FROM nation a JOIN nation b ON length(a.n_name) = length(b.n_name) AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y, CAST(hamming(a.n_name, b.n_name) AS INTEGER) AS d FROM nation a JOIN nation b ON length(a.n_name) = length(b.n_name) AND a.n_nationkey < b.n_nationkey")
both("time_parts", "SELECT event_id, extract(HOUR FROM ts) AS h, extract(MINUTE FROM ts) AS m, weekofyear(ts) AS w, date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH:mm') AS t FROM events", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS m, CAST(weekofyear(ts) AS INTEGER) AS w, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS t FROM events")
both("time_add_diff", "SELECT o_orderkey, date_format(o_orderdate + INTERVAL 36 HOURS, 'yyyy-MM-dd HH:mm') AS a, datediff(DATE '2030-01-01', to_date(o_orderdate)) AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M') AS a, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') AS INTEGER) AS d FROM orders")
both("time_round", "SELECT event_id, date_format(timestamp_seconds(floor((unix_seconds(CAST(ts AS TIMESTAMP)) + 1800) / 3600) * 3600), 'yyyy-MM-dd HH') AS r FROM events", "SELECT event_id, strftime(date_trunc('hour', date_trunc('second', ts) + INTERVAL 30 MINUTE), '%Y-%m-%d %H') AS r FROM events")
both("json_array_length", "SELECT n_regionkey, json_array_length(to_json(collect_list(n_nationkey))) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(json_array_length(to_json(list(n_nationkey))) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
both("json_build", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'name', n_name)) AS o, to_json(array(n_nationkey, n_regionkey)) AS a FROM nation", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'name', n_name) AS VARCHAR) AS o, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS a FROM nation")
both("map_core", "SELECT n_nationkey, map_keys(m) AS k, map_values(m) AS v, element_at(m, 'r') AS r, map_contains_key(m, 'z') AS z FROM (SELECT n_nationkey, map('n', n_nationkey, 'r', n_regionkey) AS m FROM nation)", "SELECT n_nationkey, ['n', 'r'] AS k, [n_nationkey, n_regionkey] AS v, n_regionkey AS r, false AS z FROM nation")
both("array_flatten_sort", "SELECT n_regionkey, array_sort(flatten(collect_list(array(n_nationkey, n_nationkey + 100)))) AS a FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(flatten(list([n_nationkey, n_nationkey + 100]))) AS a FROM nation GROUP BY n_regionkey")
both("array_unnest_position", "SELECT n_nationkey, pos, c FROM nation, LATERAL posexplode(split(n_name, '_')) AS t(pos, c)", "SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS pos, l[i] AS c FROM (SELECT n_nationkey, string_split(n_name, '_') AS l FROM nation), unnest(range(1, len(l) + 1)) AS t(i)")
both("math_trig_inverse", "SELECT s_suppkey, round(asin(1 / (s_suppkey + 1.0D)), 6) AS a, round(acos(1 / (s_suppkey + 1.0D)), 6) AS c, round(tanh(s_suppkey / 10.0D), 6) AS t, round(radians(s_suppkey), 6) AS r, ceil(s_acctbal) AS u, floor(s_acctbal) AS f FROM supplier", "SELECT s_suppkey, round(asin(1 / (s_suppkey + CAST(1 AS DOUBLE))), 6) AS a, round(acos(1 / (s_suppkey + CAST(1 AS DOUBLE))), 6) AS c, round(tanh(s_suppkey / CAST(10 AS DOUBLE)), 6) AS t, round(radians(s_suppkey), 6) AS r, CAST(ceil(s_acctbal) AS BIGINT) AS u, CAST(floor(s_acctbal) AS BIGINT) AS f FROM supplier")
both("json_group_over", "SELECT n_nationkey, to_json(collect_list(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS j FROM nation", "SELECT n_nationkey, CAST(to_json(list(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation")
both("update_from", "SELECT c_custkey, if(n_nationkey IS NULL, c_mktsegment, n_name) AS segment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
both("delete_where", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 50000 AND o_orderstatus = 'F', false)")
