"""The dialect's functions by name for spark.sql: register(spark) makes them temporary functions.

Most are SQL functions, which Catalyst inlines like any expression; those that no
expression gives are Arrow-batched UDFs and a UDTF (functions/udfs.py).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import udfs

#: Codes of the letters A to Z in refined Soundex (fixed values).
REFINED = "01360240043788015936020505"
#: Steps of Caverphone 2, in order (fixed values).
CAVERPHONE = (
    ("[^a-z]", ""), ("e$", ""), ("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f"), ("^trough", "trou2f"), ("^gn", "2n"), ("mb$", "m2"), ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"),
    ("[cqx]", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"),
    ("gh", "22"), ("g", "k"), ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"), ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("r$", "3"), ("r", "2"),
    ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", ""),
)


def _steps(x: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}')"
    return x


#: name -> (parameters, type, body)
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # text
    "like_match": ("pattern STRING, x STRING", "BOOLEAN", "x ILIKE pattern"),
    "char_of": ("codes ARRAY<INT>", "STRING", "array_join(transform(codes, c -> decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')), '')"),
    "concat_all": ("parts ARRAY<STRING>", "STRING", "array_join(parts, '')"),
    "unhex_ignoring": ("x STRING, ignored STRING", "BINARY", "unhex(translate(x, ignored, ''))"),
    "substr0": ("x STRING, start INT, n INT", "STRING", "CASE WHEN start = 0 THEN substr(x, 1, greatest(n - 1, 0)) WHEN start < 0 AND -start > length(x) THEN substr(x, 1, greatest(n + length(x) + start, 0)) ELSE substr(x, start, n) END"),
    "soundex_of": ("x STRING", "STRING", "if(x RLIKE '[A-Za-z]', soundex(regexp_replace(x, '[^A-Za-z]', '')), '?000')"),
    "refined_soundex": (
        "x STRING",
        "STRING",
        f"if(x RLIKE '[A-Za-z]', concat(upper(substr(regexp_replace(x, '[^A-Za-z]', ''), 1, 1)), regexp_replace(translate(upper(regexp_replace(x, '[^A-Za-z]', '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{REFINED}'), '(.)\\\\1+', '$1')), '')",
    ),
    "caverphone": ("x STRING", "STRING", f"if(x = '', '', rpad({_steps('lower(x)', CAVERPHONE)}, 10, '1'))"),
    "zeroblob": ("n INT", "BINARY", "unhex(repeat('00', greatest(n, 0)))"),
    "get_byte": ("b BINARY, i INT", "INT", "CAST(conv(hex(substr(b, i + 1, 1)), 16, 10) AS INT)"),
    "set_byte": ("b BINARY, i INT, v INT", "BINARY", "concat(substr(b, 1, i), unhex(lpad(hex(v & 255), 2, '0')), substr(b, i + 2))"),
    "quote_text": ("x STRING", "STRING", "coalesce(concat('''', replace(x, '''', ''''''), ''''), 'NULL')"),
    "regexp_capture": ("x STRING, pattern STRING, n INT", "STRING", "if(x RLIKE pattern, regexp_extract(x, pattern, n), NULL)"),
    "crypto_encode": ("x BINARY, fmt STRING", "STRING", "CASE lower(fmt) WHEN 'hex' THEN lower(hex(x)) WHEN 'base64' THEN base64(x) WHEN 'url' THEN replace(url_encode(CAST(x AS STRING)), '+', '%20') ELSE raise_error(concat('unknown format ', fmt)) END"),
    "crypto_decode": ("x STRING, fmt STRING", "BINARY", "CASE lower(fmt) WHEN 'hex' THEN unhex(x) WHEN 'base64' THEN unbase64(x) WHEN 'url' THEN CAST(url_decode(x) AS BINARY) ELSE raise_error(concat('unknown format ', fmt)) END"),
    "fuzzy_hamming": ("a STRING, b STRING", "INT", "if(length(a) <> length(b), -1, size(filter(zip_with(split(a, ''), split(b, ''), (p, q) -> p <> q), d -> d)))"),
    "uuid_blob": ("u STRING", "BINARY", "unhex(replace(u, '-', ''))"),
    "uuid_str": ("b BINARY", "STRING", "regexp_replace(lower(hex(b)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')"),
    "uuid7_timestamp_ms": ("u STRING", "BIGINT", "CAST(conv(substr(replace(u, '-', ''), 1, 12), 16, 10) AS BIGINT)"),
    "slugify": ("x STRING", "STRING", "trim(BOTH '-' FROM regexp_replace(lower(x), '[^a-z0-9]+', '-'))"),
    # addresses: IPv4 by bits
    "ip4_number": ("host STRING", "BIGINT", "aggregate(split(host, '[.]'), 0L, (s, p) -> s * 256 + CAST(p AS BIGINT))"),
    "ip4_text": ("n BIGINT", "STRING", "concat_ws('.', shiftright(n, 24) & 255, shiftright(n, 16) & 255, shiftright(n, 8) & 255, n & 255)"),
    "iphost": ("a STRING", "STRING", "substring_index(a, '/', 1)"),
    "ipmasklen": ("a STRING", "INT", "CASE WHEN a LIKE '%/%' THEN CAST(substring_index(a, '/', -1) AS INT) WHEN a LIKE '%:%' THEN 128 ELSE 32 END"),
    "ipfamily": ("a STRING", "INT", "if(a LIKE '%:%', 6, 4)"),
    # mathematics: null outside the domain
    "log_of": ("x DOUBLE", "DOUBLE", "if(x > 0, log10(x), NULL)"),
    "log_base": ("b DOUBLE, x DOUBLE", "DOUBLE", "if(x > 0 AND b > 0 AND b <> 1, ln(x) / ln(b), NULL)"),
    "sqrt_of": ("x DOUBLE", "DOUBLE", "if(x >= 0, sqrt(x), NULL)"),
    "acos_of": ("x DOUBLE", "DOUBLE", "if(abs(x) <= 1, acos(x), NULL)"),
    "asin_of": ("x DOUBLE", "DOUBLE", "if(abs(x) <= 1, asin(x), NULL)"),
    "acosh_of": ("x DOUBLE", "DOUBLE", "if(x >= 1, acosh(x), NULL)"),
    "atanh_of": ("x DOUBLE", "DOUBLE", "if(abs(x) < 1, atanh(x), NULL)"),
    "trunc_of": ("x DOUBLE", "DOUBLE", "if(x < 0, CAST(ceil(x) AS DOUBLE), CAST(floor(x) AS DOUBLE))"),
    "mod_of": ("a DOUBLE, b DOUBLE", "DOUBLE", "try_mod(a, b)"),
    # time
    "dur_ns": ("n BIGINT", "BIGINT", "n"),
    "dur_us": ("n BIGINT", "BIGINT", "n * 1000L"),
    "dur_ms": ("n BIGINT", "BIGINT", "n * 1000000L"),
    "dur_s": ("n BIGINT", "BIGINT", "n * 1000000000L"),
    "dur_m": ("n BIGINT", "BIGINT", "n * 60000000000L"),
    "dur_h": ("n BIGINT", "BIGINT", "n * 3600000000000L"),
    "time_add": ("t TIMESTAMP, ns BIGINT", "TIMESTAMP", "timestamp_micros(unix_micros(t) + ns div 1000)"),
    "time_sub": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "(unix_micros(a) - unix_micros(b)) * 1000L"),
    "time_add_date": ("t TIMESTAMP, y INT, m INT, d INT", "TIMESTAMP", "timestampadd(DAY, d, t + make_ym_interval(y, m))"),
    "time_milli": ("n BIGINT", "TIMESTAMP", "timestamp_millis(n)"),
    "time_micro": ("n BIGINT", "TIMESTAMP", "timestamp_micros(n)"),
    "time_nano": ("n BIGINT", "TIMESTAMP", "timestamp_micros(n div 1000)"),
    "time_unix": ("n BIGINT", "TIMESTAMP", "timestamp_seconds(n)"),
    "time_to_nano": ("t TIMESTAMP", "BIGINT", "unix_micros(t) * 1000L"),
    "time_after": ("a TIMESTAMP, b TIMESTAMP", "BOOLEAN", "a > b"),
    "time_before": ("a TIMESTAMP, b TIMESTAMP", "BOOLEAN", "a < b"),
    "time_equal": ("a TIMESTAMP, b TIMESTAMP", "BOOLEAN", "a = b"),
    "time_compare": ("a TIMESTAMP, b TIMESTAMP", "INT", "CAST(sign(unix_micros(a) - unix_micros(b)) AS INT)"),
    "time_fmt_iso": ("t TIMESTAMP", "STRING", "date_format(t, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"),
    "time_fmt_datetime": ("t TIMESTAMP", "STRING", "date_format(t, 'yyyy-MM-dd HH:mm:ss')"),
    "time_fmt_date": ("t TIMESTAMP", "STRING", "date_format(t, 'yyyy-MM-dd')"),
    "time_fmt_time": ("t TIMESTAMP", "STRING", "date_format(t, 'HH:mm:ss')"),
    "unixepoch_subsec": ("t TIMESTAMP", "DOUBLE", "unix_micros(t) / 1e6D"),
    "auto_time": ("x DOUBLE", "TIMESTAMP", "if(x BETWEEN 0 AND 5373484.5D, timestamp_millis(CAST(round((x - 2440587.5D) * 86400e3D) AS BIGINT)), timestamp_millis(CAST(round(x * 1e3D) AS BIGINT)))"),
    # arrays: subscripts from 0, slices half open, null arrays taken as empty where something is added
    "array_at": ("a ARRAY<BIGINT>, i INT", "BIGINT", "if(i < 0, NULL, get(a, i))"),
    "array_cut": ("a ARRAY<BIGINT>, s INT, e INT", "ARRAY<BIGINT>", "slice(a, greatest(s, 0) + 1, greatest(least(e, size(a)) - greatest(s, 0), 0))"),
    "array_push": ("a ARRAY<BIGINT>, x BIGINT", "ARRAY<BIGINT>", "array_append(coalesce(a, CAST(array() AS ARRAY<BIGINT>)), x)"),
    "array_count": ("a ARRAY<BIGINT>", "INT", "if(a IS NULL, NULL, size(a))"),
    # vectors
    "vector_of": ("x STRING", "ARRAY<FLOAT>", "from_json(x, 'ARRAY<FLOAT>')"),
    "vector64_of": ("x STRING", "ARRAY<DOUBLE>", "from_json(x, 'ARRAY<DOUBLE>')"),
    "vector_extract": ("v ARRAY<FLOAT>", "STRING", "to_json(v)"),
    "vector_slice": ("v ARRAY<FLOAT>, s INT, e INT", "ARRAY<FLOAT>", "slice(v, s + 1, e - s)"),
    "vector_concat": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "ARRAY<FLOAT>", "concat(a, b)"),
    "vector1bit_of": ("v ARRAY<FLOAT>", "ARRAY<BOOLEAN>", "transform(v, x -> x > 0)"),
    "vector32_sparse_of": ("v ARRAY<FLOAT>", "STRUCT<dim: INT, idx: ARRAY<INT>, val: ARRAY<FLOAT>>", "named_struct('dim', size(v), 'idx', filter(transform(v, (x, i) -> if(x <> 0, i, NULL)), i -> i IS NOT NULL), 'val', filter(v, x -> x <> 0))"),
    "vector8_of": (
        "v ARRAY<FLOAT>",
        "STRUCT<low: DOUBLE, step: DOUBLE, q: ARRAY<INT>>",
        "named_struct('low', CAST(array_min(v) AS DOUBLE), 'step', (CAST(array_max(v) AS DOUBLE) - array_min(v)) / 255, 'q', transform(v, x -> CAST(round((CAST(x AS DOUBLE) - array_min(v)) / nullif((CAST(array_max(v) AS DOUBLE) - array_min(v)) / 255, 0)) AS INT)))",
    ),
    # places
    "geo_point": ("lng DOUBLE, lat DOUBLE", "STRUCT<lng: DOUBLE, lat: DOUBLE>", "if(lng BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, named_struct('lng', lng, 'lat', lat), raise_error('longitude or latitude out of range'))"),
    "to_geojson": ("p STRUCT<lng: DOUBLE, lat: DOUBLE>", "STRING", "concat('{\"type\":\"Point\",\"coordinates\":[', p.lng, ',', p.lat, ']}')"),
    "from_geojson": ("x STRING", "STRUCT<lng: DOUBLE, lat: DOUBLE>", "named_struct('lng', CAST(get_json_object(x, '$.coordinates[0]') AS DOUBLE), 'lat', CAST(get_json_object(x, '$.coordinates[1]') AS DOUBLE))"),
    "geo_envelope": (
        "ring ARRAY<STRUCT<lng: DOUBLE, lat: DOUBLE>>",
        "ARRAY<DOUBLE>",
        "array(array_min(transform(ring, p -> p.lng)), array_min(transform(ring, p -> p.lat)), array_max(transform(ring, p -> p.lng)), array_max(transform(ring, p -> p.lat)))",
    ),
    # records
    "record_of": ("t STRING, k STRING", "STRUCT<tb: STRING, id: STRING>", "named_struct('tb', t, 'id', k)"),
    "record_id": ("r STRUCT<tb: STRING, id: STRING>", "STRING", "r.id"),
    "record_table": ("r STRUCT<tb: STRING, id: STRING>", "STRING", "r.tb"),
    "record_text": ("r STRUCT<tb: STRING, id: STRING>", "STRING", "concat(r.tb, ':', r.id)"),
    # JSON
    "json_minify": ("x STRING", "STRING", "to_json(parse_json(x))"),
    "json_quote_text": ("x STRING", "STRING", "coalesce(substr(to_json(array(x)), 2, length(to_json(array(x))) - 2), 'null')"),
    "json_path_text": ("x STRING, steps ARRAY<STRING>", "STRING", "get_json_object(x, concat('$', array_join(transform(steps, s -> if(s RLIKE '^[0-9]+$', concat('[', s, ']'), concat('.', s))), '')))"),
}

#: Arrow-batched UDFs by name.
ARROW_FUNCTIONS = ("damerau", "osa_distance", "jaro_winkler", "json_set", "json_insert", "json_replace", "json_remove", "json_patch", "json_type_of", "json_pretty_text", "json_error_position", "json_apply", "json_diff", "unistr", "unistr_quote", "normalize_nfc", "ip_family", "ip_network", "ip_contains")


def register(spark: SparkSession, *names: str) -> None:
    """Make the functions named, or all, callable in spark.sql of this session."""
    from ..session import ship

    ship(spark)
    for name in names or (*SQL_FUNCTIONS, *ARROW_FUNCTIONS, "json_each", "json_tree"):
        if name in SQL_FUNCTIONS:
            parameters, kind, body = SQL_FUNCTIONS[name]
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
        elif name in ARROW_FUNCTIONS:
            spark.udf.register(name, getattr(udfs, name))
        elif name in ("json_each", "json_tree"):
            spark.udtf.register(name, udfs.JsonEach if name == "json_each" else udfs.JsonTree)
        else:
            raise ValueError(f"no function {name}")


def unregister(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
