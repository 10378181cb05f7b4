"""The registered functions, called from SQL, and the composed ones of functions/dialect.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as D
from ..functions.surface import CAVERPHONE, REFINED
from ..functions.surface import register as make
from ..session import table, views
from .registry import register


def called(name: str, functions: tuple[str, ...], spark_sql: str, oracle: str) -> None:
    """A query in Spark SQL that calls registered functions, and its oracle."""

    @register(name, oracle)
    def run(spark, sf_dir):
        make(spark, *functions)
        views(spark, sf_dir)
        return spark.sql(spark_sql)


# text
called("fn_char_concat", ("char_of", "concat_all"), "SELECT n_nationkey, char_of(array(72, 233, 8364 + n_nationkey, 128512)) AS c, concat_all(array(n_name, NULL, 'z')) AS k FROM nation", "SELECT n_nationkey, chr(72) || chr(233) || chr(8364 + n_nationkey) || chr(128512) AS c, concat(n_name, NULL, 'z') AS k FROM nation")
called("fn_unhex_ignoring", ("unhex_ignoring",), "SELECT n_nationkey, CAST(unhex_ignoring(concat_ws('-', hex(n_name), '4A', '4b'), '- ') AS STRING) AS t FROM nation", "SELECT n_nationkey, n_name || 'JK' AS t FROM nation")
called("fn_substr_zero", ("substr0",), "SELECT n_nationkey, substr0(n_name, 0, 3) AS z, substr0(n_name, -3, 2) AS e, substr0(n_name, -100, 99) AS f FROM nation", "SELECT n_nationkey, substr(n_name, 1, 2) AS z, left(right(n_name, 3), 2) AS e, left(n_name, greatest(99 + CAST(length(n_name) AS INTEGER) - 100, 0)) AS f FROM nation")
called(
    "fn_soundex",
    ("soundex_of",),
    "SELECT p_partkey, soundex_of(p_type) AS s, soundex_of('42') AS e FROM part",
    """WITH c AS (SELECT p_partkey, regexp_replace(upper(p_type), '[^A-Z]', '', 'g') AS w FROM part),
    d AS (SELECT p_partkey, w, string_split(regexp_replace(translate(w, 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000099111122222222334556'), '9', '', 'g'), '') AS l, substr(w, 1, 1) AS h FROM c),
    f AS (SELECT p_partkey, h, list_filter(l, lambda x, i: x <> '0' AND (i = 1 OR x <> l[i - 1])) AS k, l[1] <> '0' AND h NOT IN ('H', 'W') AS own FROM d)
    SELECT p_partkey, CASE WHEN h = '' THEN '?000' ELSE h || left(array_to_string(CASE WHEN own THEN k[2:] ELSE k END, '') || '000', 3) END AS s, '?000' AS e FROM f""",
)
_CAVER = "lower(w)"
for _pattern, _replacement in CAVERPHONE:
    _CAVER = f"regexp_replace({_CAVER}, '{_pattern}', '{_replacement}', 'g')"
called(
    "fn_phonetic",
    ("refined_soundex", "caverphone"),
    "SELECT p_partkey, refined_soundex(p_type) AS r, caverphone(p_type) AS c, refined_soundex('phonetics') AS a, caverphone('awesome') AS b FROM part",
    f"WITH c AS (SELECT p_partkey, p_type AS w, regexp_replace(upper(p_type), '[^A-Z]', '', 'g') AS u FROM part), l AS (SELECT *, string_split(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{REFINED}'), '') AS l FROM c) SELECT p_partkey, u[1:1] || array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), '') AS r, rpad({_CAVER}, 10, '1') AS c, 'P1080603' AS a, 'AWSM111111' AS b FROM l",
)
called("fn_bytes", ("zeroblob", "get_byte", "set_byte"), "SELECT n_nationkey, octet_length(zeroblob(n_nationkey)) AS z, get_byte(CAST(n_name AS BINARY), 1) AS g, CAST(set_byte(CAST(n_name AS BINARY), 0, 66 + n_nationkey % 20) AS STRING) AS s FROM nation", "SELECT n_nationkey, n_nationkey AS z, ascii(substr(n_name, 2, 1)) AS g, chr(66 + n_nationkey % 20) || substr(n_name, 2) AS s FROM nation")
called("fn_quote", ("quote_text",), "SELECT p_partkey, quote_text(concat(p_name, '''s')) AS q, quote_text(NULL) AS n FROM part", "SELECT p_partkey, '''' || replace(p_name || '''s', '''', '''''') || '''' AS q, 'NULL' AS n FROM part")
called("fn_like_regexp", ("like_match", "regexp_capture"), "SELECT p_partkey, like_match('brand#1%', p_brand) AS l, regexp_like(p_brand, '#[13]') AS r, regexp_substr(p_brand, '[0-9]+') AS s, regexp_capture(p_brand, '(B)rand#(.)', 2) AS c FROM part", "SELECT p_partkey, p_brand ILIKE 'brand#1%' AS l, regexp_matches(p_brand, '#[13]') AS r, regexp_extract(p_brand, '[0-9]+') AS s, regexp_extract(p_brand, '(B)rand#(.)', 2) AS c FROM part")
called("fn_crypto", ("crypto_encode", "crypto_decode"), "SELECT n_nationkey, sha2(n_name, 256) AS a, crypto_encode(CAST(n_name AS BINARY), 'hex') AS h, crypto_encode(CAST(n_name AS BINARY), 'base64') AS b, crypto_encode(CAST(concat(n_name, ' &/é') AS BINARY), 'url') AS u, CAST(crypto_decode(crypto_encode(CAST(n_name AS BINARY), 'base64'), 'base64') AS STRING) AS d FROM nation", "SELECT n_nationkey, sha256(n_name) AS a, lower(hex(n_name)) AS h, to_base64(encode(n_name)) AS b, url_encode(n_name || ' &/é') AS u, n_name AS d FROM nation")
called("fn_unistr", ("unistr", "unistr_quote", "normalize_nfc"), "SELECT n_nationkey, unistr(concat(n_name, '\\\\0041\\\\u00e9\\\\+01F600\\\\U0001F601\\\\\\\\')) AS u, unistr_quote(concat(n_name, '''', char(10))) AS q, normalize_nfc(concat(n_name, 'e', decode(unhex('CC81'), 'UTF-8'))) AS n FROM nation", "SELECT n_nationkey, n_name || 'Aé😀😁\\' AS u, 'unistr(''' || n_name || '''''\\u000a'')' AS q, n_name || 'é' AS n FROM nation")
called("fn_uuid", ("uuid_blob", "uuid_str", "uuid7_timestamp_ms"), "SELECT n_nationkey, uuid_str(uuid_blob('01890A5D-AC96-774B-BCCE-B302099A8057')) AS u, uuid7_timestamp_ms('01890a5d-ac96-774b-bcce-b302099a8057') + n_nationkey AS t, length(uuid()) AS n FROM nation", "SELECT n_nationkey, '01890a5d-ac96-774b-bcce-b302099a8057' AS u, CAST(1688137346198 AS BIGINT) + n_nationkey AS t, 36 AS n FROM nation".replace("1688137346198", str(int("01890a5dac96", 16))))
called("fn_ip4", ("ip4_number", "ip4_text", "iphost", "ipmasklen", "ipfamily"), "SELECT c_custkey, iphost(a) AS h, ipmasklen(a) AS m, ipfamily(a) AS f, concat(ip4_text(ip4_number(iphost(a)) & (-1L << (32 - ipmasklen(a)))), '/', ipmasklen(a)) AS n FROM (SELECT c_custkey, concat('10.', c_custkey % 200, '.', c_custkey % 7, '.9/', 16 + c_custkey % 9) AS a FROM customer)", "SELECT c_custkey, '10.' || c_custkey % 200 || '.' || c_custkey % 7 || '.9' AS h, CAST(m AS INTEGER) AS m, 4 AS f, '10.' || c_custkey % 200 || '.' || CAST(floor(c_custkey % 7 / power(2, 24 - m)) * power(2, 24 - m) AS BIGINT) || '.0/' || m AS n FROM (SELECT *, 16 + c_custkey % 9 AS m FROM customer)")
called("fn_osa", ("osa_distance", "fuzzy_hamming"), "SELECT a.n_name AS x, b.n_name AS y, osa_distance(a.n_name, reverse(b.n_name)) AS o, fuzzy_hamming(a.n_name, b.n_name) AS h FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "SELECT a.n_name AS x, b.n_name AS y, CAST(damerau_levenshtein(a.n_name, reverse(b.n_name)) AS INTEGER) AS o, CASE WHEN length(a.n_name) = length(b.n_name) THEN CAST(hamming(a.n_name, b.n_name) AS INTEGER) ELSE -1 END AS h FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")


@register("fn_printf", "SELECT p_partkey, printf('%05d|%-12s|%8.2f|%x|%X|%o|%d%%', p_size, p_brand, p_retailprice, p_partkey, p_partkey, p_size, 0) || '''it''''s'' NULL' AS t FROM part")
def _printf(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", D.printf("%05d|%-12s|%8.2f|%x|%X|%o|%d%%%Q %Q", c("p_size"), c("p_brand"), c("p_retailprice"), c("p_partkey"), c("p_partkey"), c("p_size"), F.lit(None), F.lit("it's"), F.lit(None)).alias("t"))


@register("fn_typeof", "SELECT o_orderkey, 'integer' AS k, 'real' AS p, 'text' AS d, CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE 'text' END AS s FROM orders")
def _typeof(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("s", F.expr("nullif(o_orderstatus, 'O')"))
    return o.select("o_orderkey", *[D.typeof(o, n).alias(a) for n, a in (("o_orderkey", "k"), ("o_totalprice", "p"), ("o_orderdate", "d"), ("s", "s"))])


# mathematics
called("fn_math_domain", ("log_of", "log_base", "sqrt_of", "acos_of", "acosh_of", "atanh_of", "trunc_of", "mod_of"), "SELECT s_suppkey, round(log_of(s_acctbal), 6) AS l, round(log_base(2, s_suppkey + 1), 6) AS b, round(sqrt_of(s_acctbal), 6) AS s, round(acos_of(s_acctbal / 5000), 6) AS a, round(acosh_of(s_acctbal / 500), 6) AS h, round(atanh_of(s_acctbal / 5000), 6) AS t, trunc_of(s_acctbal) AS tr, round(mod_of(s_acctbal, 7.5D), 4) AS m, round(pi(), 6) AS pi, mod_of(1, 0) AS z FROM supplier", "SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) END, 6) AS l, round(log2(s_suppkey + 1), 6) AS b, round(CASE WHEN s_acctbal >= 0 THEN sqrt(s_acctbal) END, 6) AS s, round(CASE WHEN abs(s_acctbal) <= 5000 THEN acos(s_acctbal / 5000) END, 6) AS a, round(CASE WHEN s_acctbal >= 500 THEN acosh(s_acctbal / 500) END, 6) AS h, round(CASE WHEN abs(s_acctbal) < 5000 THEN atanh(s_acctbal / 5000) END, 6) AS t, trunc(s_acctbal) AS tr, round(s_acctbal % CAST(7.5 AS DOUBLE), 4) AS m, round(pi(), 6) AS pi, CAST(NULL AS DOUBLE) AS z FROM supplier")


@register("fn_lcm_large", "SELECT p_partkey, CAST(lcm(p_partkey * 1000000007, p_size * 1003) AS BIGINT) AS l FROM part")
def _lcm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", D.lcm(F.col("p_partkey") * 1_000_000_007, F.col("p_size").cast("long") * 1_003).alias("l"))


# time
_T = "CAST(o_orderdate AS TIMESTAMP)"
called("fn_time_compare", ("time_after", "time_before", "time_equal", "time_compare"), f"SELECT o_orderkey, time_after({_T}, t) AS a, time_before({_T}, t) AS b, time_equal({_T}, {_T}) AS e, time_compare({_T}, t) AS c FROM (SELECT *, TIMESTAMP '1995-06-01 00:00:00' AS t FROM orders)", "SELECT o_orderkey, o_orderdate > TIMESTAMP '1995-06-01' AS a, o_orderdate < TIMESTAMP '1995-06-01' AS b, true AS e, CASE WHEN o_orderdate > TIMESTAMP '1995-06-01' THEN 1 WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN -1 ELSE 0 END AS c FROM orders")
called("fn_time_arithmetic", ("dur_h", "dur_m", "dur_s", "dur_ms", "time_add", "time_sub", "time_add_date", "time_fmt_iso", "time_fmt_date", "time_fmt_time"), f"SELECT o_orderkey, time_fmt_iso(time_add({_T}, dur_h(5) + dur_m(7) + dur_s(9))) AS a, time_sub(time_add({_T}, dur_ms(1500)), {_T}) AS s, time_fmt_date(time_add_date({_T}, 1, 2, 3)) AS d, time_fmt_time(time_add({_T}, dur_s(61))) AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 5 HOUR + INTERVAL 7 MINUTE + INTERVAL 9 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS a, CAST(1500000000 AS BIGINT) AS s, strftime(o_orderdate + INTERVAL 14 MONTH + INTERVAL 3 DAY, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 61 SECOND, '%H:%M:%S') AS t FROM orders")
called("fn_time_epochs", ("time_unix", "time_milli", "time_micro", "time_nano", "time_to_nano", "unixepoch_subsec", "auto_time", "time_fmt_datetime"), "SELECT event_id, time_fmt_datetime(time_unix(s)) AS a, time_fmt_datetime(time_milli(s * 1000 + 5)) AS b, time_fmt_datetime(time_micro(s * 1000000)) AS c, time_to_nano(time_nano(s * 1000000000)) AS n, unixepoch_subsec(time_milli(s * 1000 + 250)) AS f, time_fmt_datetime(auto_time(CAST(s AS DOUBLE))) AS u, time_fmt_datetime(auto_time(s / 86400D + 2440587.5D)) AS j FROM (SELECT event_id, unix_seconds(CAST(ts AS TIMESTAMP)) AS s FROM events)", "SELECT event_id, f AS a, f AS b, f AS c, s * 1000000000 AS n, s + CAST(0.25 AS DOUBLE) AS f, f AS u, f AS j FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS f FROM events)")


@register("fn_date_modifiers", "SELECT o_orderkey, strftime(make_date(year(o_orderdate), 1, 1) + INTERVAL 8 HOUR + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS a, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS b, strftime(o_orderdate + INTERVAL 6 MONTH, '%Y-%m-%d') AS f, strftime(date_trunc('month', o_orderdate) + INTERVAL 6 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS c, strftime(date_trunc('day', o_orderdate) + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d %H:%M') AS w FROM orders")
def _moment(spark, sf_dir):
    t, text = F.col("o_orderdate"), lambda c, p="yyyy-MM-dd": F.date_format(c, p)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text(D.moment(t, "start of year", "+8 hours", "1.5 hours"), "yyyy-MM-dd HH:mm").alias("a"),
        text(D.moment(t, "start of month", "+1 month", "-1 day")).alias("b"),
        text(D.moment(t, "+6 months", "floor")).alias("f"),
        text(D.moment(t, "+6 months")).alias("c"),
        text(D.moment(t, "start of day", "weekday 0"), "yyyy-MM-dd HH:mm").alias("w"),
    )


@register(
    "fn_timediff",
    """WITH d AS (SELECT o_orderkey, o_orderdate AS a, TIMESTAMP '1995-02-27 10:11:12.5' AS b FROM orders),
    e AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM d), m AS (SELECT *, datediff('month', lo, hi) AS n FROM e),
    k AS (SELECT *, CASE WHEN lo + to_months(CAST(n AS INTEGER)) > hi THEN n - 1 ELSE n END AS w FROM m),
    r AS (SELECT *, CAST(epoch_ms(hi) - epoch_ms(lo + to_months(CAST(w AS INTEGER))) AS BIGINT) AS ms FROM k)
    SELECT o_orderkey, CASE WHEN a < b THEN '-' ELSE '+' END || printf('%04d-%02d-%02d %02d:%02d:%02d.%03d', w // 12, w % 12, ms // 86400000, ms // 3600000 % 24, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS t FROM r""",
)
def _timediff(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.timediff(F.col("o_orderdate"), F.lit("1995-02-27 10:11:12.5").cast("timestamp_ntz")).alias("t"))


@register("fn_now", "SELECT n_nationkey, true AS d, true AS t, true AS m FROM nation")
def _now(spark, sf_dir):
    near = lambda c: F.abs(F.unix_seconds(c) - F.unix_seconds(F.now())) < 86_400
    return table(spark, sf_dir, "nation").select("n_nationkey", near(F.current_date().cast("timestamp")).alias("d"), near(F.current_timestamp()).alias("t"), F.expr("current_time() IS NOT NULL").alias("m"))


# JSON
_DOC = "to_json(named_struct('k', o_orderkey, 'a', array(o_custkey, 2L), 'r', 2.5D, 'o', named_struct('s', o_orderstatus, 'b', o_orderkey % 2 = 0, 'p', nullif(o_orderpriority, '5-LOW'))), map('ignoreNullFields', 'false'))"
_DUCK = "json_object('k', o_orderkey, 'a', json_array(o_custkey, 2), 'r', CAST(2.5 AS DOUBLE), 'o', json_object('s', o_orderstatus, 'b', o_orderkey % 2 = 0, 'p', nullif(o_orderpriority, '5-LOW')))"
_KIND = "CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'real' WHEN 'BOOLEAN' THEN CAST(value AS VARCHAR) ELSE 'integer' END"
_TEXT = "CASE type WHEN 'VARCHAR' THEN value ->> '$' WHEN 'NULL' THEN NULL ELSE CAST(value AS VARCHAR) END"
_ATOM = "CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL WHEN type = 'VARCHAR' THEN value ->> '$' ELSE CAST(value AS VARCHAR) END"
for _name in ("json_each", "json_tree"):
    called(
        _name,
        (_name,),
        f"SELECT o_orderkey, t.key, t.value, t.type, t.atom, t.fullkey, t.path, t.parent IS NULL AS top FROM (SELECT o_orderkey, {_DOC} AS j FROM orders), LATERAL {_name}(j, '$') t",
        f"SELECT o_orderkey, key, {_TEXT} AS value, {_KIND} AS type, {_ATOM} AS atom, fullkey, path, parent IS NULL AS top FROM (SELECT o_orderkey, {_DUCK} AS j FROM orders), {_name}(j)",
    )
    called(
        f"{_name}_path",
        (_name,),
        f"SELECT o_orderkey, t.key, t.value, t.type, t.fullkey FROM (SELECT o_orderkey, {_DOC} AS j FROM orders), LATERAL {_name}(j, '$.o') t WHERE t.key <> 'o'",
        f"SELECT o_orderkey, key, {_TEXT} AS value, {_KIND} AS type, fullkey FROM (SELECT o_orderkey, {_DUCK} AS j FROM orders), {_name}(j, '$.o') WHERE key <> 'o'",
    )
called("fn_json_type", ("json_type_of", "json_error_position"), f"SELECT o_orderkey, json_type_of(j, '$') AS r, json_type_of(j, '$.a[#-1]') AS l, json_type_of(j, '$.r') AS f, json_type_of(j, '$.o.p') AS p, json_type_of(j, '$.none') AS n, json_error_position(j) AS ok, json_error_position(substr(j, 1, 5)) > 0 AS bad FROM (SELECT o_orderkey, {_DOC} AS j FROM orders)", "SELECT o_orderkey, 'object' AS r, 'integer' AS l, 'real' AS f, CASE WHEN o_orderpriority = '5-LOW' THEN 'null' ELSE 'text' END AS p, CAST(NULL AS VARCHAR) AS n, 0 AS ok, true AS bad FROM orders")
called("json_set_remove_patch", ("json_set", "json_insert", "json_replace", "json_remove", "json_patch"), f"SELECT o_orderkey, json_set(j, '$.o.s', '[1]') AS s, json_insert(j, '$.a[#]', 'true') AS i, json_insert(j, '$.k', '0') AS i0, json_replace(j, '$.none', '0') AS r0, json_replace(j, '$.a[0]', 'null') AS r, json_remove(j, '$.a') AS d, json_patch(j, '{{\"o\":{{\"s\":null,\"n\":1}},\"a\":5}}') AS p, json_set('{{bad', '$.x', '1') AS bad FROM (SELECT o_orderkey, {_DOC} AS j FROM orders)", f"""SELECT o_orderkey,
    json_object('k', o_orderkey, 'a', json_array(o_custkey, 2), 'r', CAST(2.5 AS DOUBLE), 'o', json_object('s', json_array(1), 'b', o_orderkey % 2 = 0, 'p', nullif(o_orderpriority, '5-LOW'))) :: VARCHAR AS s,
    json_object('k', o_orderkey, 'a', json_array(o_custkey, 2, true), 'r', CAST(2.5 AS DOUBLE), 'o', j -> '$.o') :: VARCHAR AS i, j :: VARCHAR AS i0, j :: VARCHAR AS r0,
    json_object('k', o_orderkey, 'a', json_array(NULL, 2), 'r', CAST(2.5 AS DOUBLE), 'o', j -> '$.o') :: VARCHAR AS r, json_object('k', o_orderkey, 'r', CAST(2.5 AS DOUBLE), 'o', j -> '$.o') :: VARCHAR AS d,
    json_object('k', o_orderkey, 'a', 5, 'r', CAST(2.5 AS DOUBLE), 'o', json_object('b', o_orderkey % 2 = 0, 'p', nullif(o_orderpriority, '5-LOW'), 'n', 1)) :: VARCHAR AS p, CAST(NULL AS VARCHAR) AS bad FROM (SELECT *, {_DUCK} AS j FROM orders)""")
called("fn_json_text", ("json_quote_text", "json_minify", "json_path_text", "json_pretty_text"), "SELECT n_nationkey, json_quote_text(concat(n_name, '\"')) AS q, json_minify(concat('{ \"b\" : ', n_nationkey, ', \"a\" : [1, 2] }')) AS m, json_path_text(concat('{\"a\":[{\"b\":', n_nationkey, '}]}'), array('a', '0', 'b')) AS p, json_pretty_text(concat('{\"a\":[', n_nationkey, ']}')) AS t FROM nation", "SELECT n_nationkey, CAST(to_json(n_name || '\"') AS VARCHAR) AS q, '{\"a\":[1,2],\"b\":' || n_nationkey || '}' AS m, CAST(n_nationkey AS VARCHAR) AS p, json_pretty('{\"a\":[' || n_nationkey || ']}') AS t FROM nation")
called("fn_json_diff", ("json_diff", "json_apply"), f"SELECT o_orderkey, json_diff(j, k) AS d, json_apply(j, json_diff(j, k)) = k AS same FROM (SELECT o_orderkey, {_DOC} AS j, to_json(named_struct('k', o_orderkey, 'a', array(o_custkey, 2L), 'r', 2.5D, 'o', named_struct('s', 'X', 'b', o_orderkey % 2 = 0, 'p', nullif(o_orderpriority, '5-LOW'))), map('ignoreNullFields', 'false')) AS k FROM orders)", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'X' THEN '[]' ELSE '[{\"op\":\"replace\",\"path\":\"/o/s\",\"value\":\"X\"}]' END AS d, true AS same FROM orders")

# arrays, structs, vectors, places, records
_A = "array(CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 7L)"
called("fn_array_rules", ("array_at", "array_cut", "array_push", "array_count"), f"SELECT n_nationkey, array_at({_A}, 0) AS z, array_at({_A}, -1) AS n, array_cut({_A}, 1, 9) AS c, array_push(NULL, 5) AS p, array_count(NULL) AS k, {_A} < array(5L, 1L) AS lt, {_A} || array(1L) AS cat FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS z, CAST(NULL AS BIGINT) AS n, [n_regionkey :: BIGINT, 7] AS c, [5 :: BIGINT] AS p, CAST(NULL AS INTEGER) AS k, [n_nationkey :: BIGINT, n_regionkey, 7] < [5 :: BIGINT, 1] AS lt, [n_nationkey :: BIGINT, n_regionkey, 7, 1] AS cat FROM nation")
called("fn_vector_forms", ("vector_of", "vector_extract", "vector_slice", "vector_concat", "vector1bit_of", "vector32_sparse_of", "vector8_of"), "SELECT n_nationkey, vector_extract(vector_concat(v, vector_slice(v, 1, 3))) AS t, size(vector_slice(v, 0, 2)) AS n, filter(vector1bit_of(v), b -> b) AS b, vector32_sparse_of(v).idx AS i, vector8_of(v).q AS q FROM (SELECT n_nationkey, vector_of(concat('[0,', n_nationkey, ',-1.5,2]')) AS v FROM nation)", "SELECT n_nationkey, '[0.0,' || n_nationkey || '.0,-1.5,2.0,' || n_nationkey || '.0,-1.5]' AS t, 2 AS n, CASE WHEN n_nationkey > 0 THEN [true, true] ELSE [true] END AS b, CASE WHEN n_nationkey > 0 THEN [1, 2, 3] ELSE [2, 3] END AS i, [CAST(round((x + 1.5) / ((greatest(n_nationkey, 2) + 1.5) / 255)) AS INTEGER) FOR x IN [0 :: DOUBLE, n_nationkey, -1.5, 2]] AS q FROM nation")
called("fn_geo_forms", ("geo_point", "to_geojson", "from_geojson", "geo_envelope"), "SELECT c_custkey, p.lng AS x, p.lat AS y, to_geojson(p) AS j, from_geojson(to_geojson(p)) = p AS same, geo_envelope(array(p, geo_point(0, 0), geo_point(1.5, -2.5))) AS e FROM (SELECT c_custkey, geo_point(c_custkey % 180 + 0.5D, c_custkey % 90 - 0.25D) AS p FROM customer)", "SELECT c_custkey, x, y, '{\"type\":\"Point\",\"coordinates\":[' || x || ',' || y || ']}' AS j, true AS same, [least(x, 0), least(y, -2.5), greatest(x, 1.5), greatest(y, 0)] AS e FROM (SELECT c_custkey, c_custkey % 180 + CAST(0.5 AS DOUBLE) AS x, c_custkey % 90 - CAST(0.25 AS DOUBLE) AS y FROM customer)")
called("fn_records", ("record_of", "record_id", "record_table", "record_text"), "SELECT n_nationkey, record_id(r) AS i, record_table(r) AS t, record_text(r) AS x FROM (SELECT n_nationkey, record_of('nation', CAST(n_nationkey AS STRING)) AS r FROM nation)", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS i, 'nation' AS t, 'nation:' || n_nationkey AS x FROM nation")


@register("fn_path_projection", "SELECT o_orderkey, [o_custkey, o_custkey + 1] AS ks, {'s': o_orderstatus} AS o FROM orders")
def _projection(spark, sf_dir):
    doc = F.expr("named_struct('items', array(named_struct('k', o_custkey, 'x', 1), named_struct('k', o_custkey + 1, 'x', 2)), 'o', named_struct('s', o_orderstatus, 'secret', o_totalprice))")
    d = table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("d"))
    return d.select("o_orderkey", F.transform("d.items", lambda e: e["k"]).alias("ks"), F.col("d.o").dropFields("secret").alias("o"))
