"""Vectors, text, graphs, places, deltas and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental, joins, recursive, search
from ..session import table
from ..streaming import views
from .registry import both, register

_Q = [((i * 37) % 64 - 32) / 64 for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"


def _knn(name, distance, sql):
    @register(name, f"SELECT vec_id, round(d, 4) AS distance FROM (SELECT vec_id, {sql} AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_QSQL} AS q FROM embeddings)) ORDER BY d, vec_id LIMIT 10")
    def run(spark, sf_dir):
        return search.knn(table(spark, sf_dir, "embeddings"), "embedding", _Q, 10, "vec_id", distance)


_knn("knn_cosine", search.distance_cos, "1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)))")
_knn("knn_l2", search.distance_l2, "list_distance(e, q)")
_knn("knn_dot", search.distance_dot, "-list_inner_product(e, q)")


@register("vec_jaccard", f"SELECT vec_id, round(1 - list_sum(list_transform(list_zip(e, q), lambda p: least(p[1], p[2]))) / list_sum(list_transform(list_zip(e, q), lambda p: greatest(p[1], p[2]))), 3) AS d FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS e, list_transform({_QSQL}, lambda x: abs(x)) AS q FROM embeddings)")
def _jaccard(spark, sf_dir):
    q = F.array(*[F.lit(abs(x)) for x in _Q])
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(search.distance_jaccard(e, q), 3).alias("d"))


@register(
    "bm25_topk",
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
    r AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'license')) AS a, len(list_filter(t, lambda x: x = 'the')) AS b FROM t),
    s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM r)
    SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score
    FROM r, s WHERE a > 0 OR b > 0 ORDER BY score DESC, doc_id LIMIT 20""",
)
def _bm25(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["license", "the"], 20)


@register("fts_phrase", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' the mit license ')")
def _phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(search.phrase(F.col("text"), ["the", "mit", "license"])).select("doc_id")


_LINKS = [("orders", "c", "o_custkey", "o", "o_orderkey"), ("orders", "o", "o_orderkey", "c", "o_custkey"), ("lineitem", "o", "l_orderkey", "p", "l_partkey"), ("lineitem", "o", "l_orderkey", "s", "l_suppkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]


def _links(spark, sf_dir):
    """(kind of source, kind of target, keys) of customers and their orders both ways, orders to parts and suppliers, those to nations, nations to regions: whole keys, all rows."""
    for name, a, src, b, dst in _LINKS:
        yield a, b, table(spark, sf_dir, name).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src is not null and dst is not null")


def _named(kind, key):
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def _whole_edges(spark, sf_dir):
    return reduce(DataFrame.unionAll, [e.select(_named(a, "src").alias("src"), _named(b, "dst").alias("dst")) for a, b, e in _links(spark, sf_dir)]).distinct()


_W = """e AS (SELECT DISTINCT src, dst FROM (
    SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
    WHERE src IS NOT NULL AND dst IS NOT NULL)"""


@register("graph_two_hop", f"WITH {_W} SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src")
def _two_hop(spark, sf_dir):
    """By kinds, as keys: no two chains of kinds give the same pair, so each is made distinct by itself and named last."""
    links, found = list(_links(spark, sf_dir)), {}
    for a, b, e in links:
        for c, d, f in links:
            if b == c:
                hops = e.alias("a").join(f.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
                found[a, d] = found[a, d].unionAll(hops) if (a, d) in found else hops
    return reduce(DataFrame.unionAll, [h.repartition("src", "dst").distinct().select(_named(a, "src").alias("src"), _named(d, "dst").alias("dst")) for (a, d), h in found.items()])


@register("graph_reachable", f"WITH RECURSIVE {_W}, r AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM e WHERE src LIKE 'c%' UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 6) SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node HAVING min(depth) >= 1")
def _reachable(spark, sf_dir):
    """Nodes as numbers, key * 8 and the place of the kind, named last; by their names where a key has over 60 bits."""
    kinds, links = "copsnr", list(_links(spark, sf_dir))
    widest = reduce(DataFrame.unionAll, [e.agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")) for *_, e in links]).agg(F.min("low"), F.max("high")).first()
    if not all(x is None or -(2**60) <= x < 2**60 for x in widest):
        e = _whole_edges(spark, sf_dir)
        return recursive.reachable(e, e.where("src LIKE 'c%'").select("src"), 1, 6)
    number = lambda kind, key: F.col(key) * 8 + kinds.index(kind)
    name = lambda node: F.concat(F.substring(F.lit(kinds), (F.pmod(node, F.lit(8)) + 1).cast("int"), F.lit(1)), F.shiftright(node, 3).cast("string"))
    edges = reduce(DataFrame.unionAll, [e.select(number(a, "src").alias("src"), number(b, "dst").alias("dst")) for a, b, e in links])
    found = recursive.reachable(edges, edges.where("pmod(src, 8) = 0").select("src"), 1, 6)
    return found.select(name(F.col("start")).alias("start"), name(F.col("node")).alias("node"), "depth")


@register("graph_paths", f"WITH RECURSIVE {_W}, r AS (SELECT 'c1' AS start, 'c1' AS node, ['c1'] AS path UNION ALL SELECT r.start, e.dst, list_append(path, e.dst) FROM r JOIN e ON r.node = e.src WHERE len(path) <= 4 AND NOT list_contains(path, e.dst)) SELECT start, node, path FROM r WHERE len(path) > 1")
def _paths(spark, sf_dir):
    return recursive.simple_paths(_whole_edges(spark, sf_dir), spark.sql("SELECT 'c1' AS s"), 1, 4)


@register("recursive_union_dedupe", "WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation UNION SELECT (k * 3 + 1) % 50 FROM r) SELECT k FROM r")
def _dedupe(spark, sf_dir):
    return recursive.union_distinct(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), lambda f: f.select(((F.col("k") * 3 + 1) % 50).alias("k")))


_PLACES = "SELECT c_custkey AS id, CAST(c_custkey * 7919 % 3600 AS DOUBLE) / 10 - 180 AS lng, CAST(c_custkey * 104729 % 1700 AS DOUBLE) / 10 - 85 AS lat FROM customer"
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians({b1} - {b0}) / 2), 2) + cos(radians({b0})) * cos(radians({b1})) * pow(sin(radians({a1} - {a0}) / 2), 2)))"


def _places(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("id"), ((c * 7919 % 3600).cast("double") / 10 - 180).alias("lng"), ((c * 104729 % 1700).cast("double") / 10 - 85).alias("lat"))


@register("geo_within", f"SELECT id FROM ({_PLACES}) WHERE {_HAVERSINE.format(a0='lng', b0='lat', a1='10.0', b1='48.0')} <= 3000000")
def _within(spark, sf_dir):
    return search.within(_places(spark, sf_dir), "lng", "lat", 10.0, 48.0, 3_000_000).select("id")


@register("geo_distance", f"SELECT id, round({_HAVERSINE.format(a0='lng', b0='lat', a1='10.0', b1='48.0')} / 1000, 3) AS km FROM ({_PLACES})")
def _distance(spark, sf_dir):
    return _places(spark, sf_dir).select("id", F.round(search.sphere_distance(F.col("lng"), F.col("lat"), F.lit(10.0), F.lit(48.0)) / 1000, 3).alias("km"))


@register("geo_contains", f"SELECT id FROM ({_PLACES}) WHERE lng > -10.05 AND lng < 40.05 AND lat > 30.05 AND lat < 60.05")
def _contains(spark, sf_dir):
    return _places(spark, sf_dir).where(search.contains([(-10.05, 30.05), (40.05, 30.05), (40.05, 60.05), (-10.05, 60.05)], F.col("lng"), F.col("lat"))).select("id")


@register("geo_cell_counts", f"SELECT x AS cx, y AS cy, count(*) AS n FROM (SELECT CAST(floor((lng + 180) / 360 * 4) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 4) AS BIGINT) AS y FROM ({_PLACES})) GROUP BY 1, 2")
def _cells(spark, sf_dir):
    cell = search.morton_cell(F.col("lng"), F.col("lat"), 2)
    bit = lambda k: F.shiftright(F.col("cell"), k).bitwiseAND(F.lit(1))
    counts = _places(spark, sf_dir).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    return counts.select((bit(0) + 2 * bit(2)).cast("long").alias("cx"), (bit(1) + 2 * bit(3)).cast("long").alias("cy"), "n")


both("record_fetch", "SELECT o_orderkey, named_struct('id', c_custkey, 'name', c_name).name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")


@register("relation_fetch", "SELECT c_custkey, coalesce(list_slice(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), 1, 3), []) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _relation(spark, sf_dir):
    return search.inverse_links(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", ["o_orderkey"], "o_orderkey", 0, 3)


@register("join_asof_events", "SELECT a.event_id, b.event_id AS prior FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("c"))
    return joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "c", "prior").select("event_id", "prior")


@register("join_or", "SELECT DISTINCT s_suppkey, c_custkey FROM supplier, customer WHERE s_suppkey = c_custkey OR s_nationkey + 1000 = c_custkey")
def _or(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("n", (F.col("s_nationkey") + 1000).cast("long"))
    return joins.or_join(s, table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey")), [("s_suppkey", "k"), ("n", "k")], "s_suppkey", "c_custkey")


_DELTA = "SELECT event_type, user_id % 10 AS g, CASE WHEN event_id % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS weight FROM events"
_delta = lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("g"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).cast("long").alias("weight"))


@register("zset_consolidate", f"SELECT event_type, g, CAST(sum(weight) AS BIGINT) AS weight FROM ({_DELTA}) GROUP BY 1, 2 HAVING sum(weight) <> 0")
def _consolidate(spark, sf_dir):
    return incremental.consolidate(_delta(spark, sf_dir))


@register("mv_group_sum_count", "SELECT event_type, CAST(sum(user_id) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY event_type")
def _mv(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("v"))
    view = e.where("event_id % 2 = 0").groupBy("event_type").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return incremental.view_sum_count(view, e.where("event_id % 2 = 1").withColumn("weight", F.lit(1)), ["event_type"], "v")


@register("cdc_apply_latest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def _cdc(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"))
    return incremental.apply_changes(changes, "user_id", ["ts", "event_id"]).drop("ts")


@register("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer")
def _upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return incremental.upsert(c, c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


@register("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _tumbling(spark, sf_dir):
    return views.tumbling(views.read(spark, f"{sf_dir}/events.parquet"), "ts", "1 day", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@register("stream_session", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, n FROM (SELECT user_id, s, count(*) AS n FROM g GROUP BY user_id, s)")
def _sessions(spark, sf_dir):
    return views.sessions(views.read(spark, f"{sf_dir}/events.parquet"), "ts", "6 hours", "user_id").select("user_id", "n")


@register("stream_dedupe", "SELECT DISTINCT user_id FROM events")
def _stream_dedupe(spark, sf_dir):
    return views.deduplicated(views.read(spark, f"{sf_dir}/events.parquet"), "ts", ["user_id"])
