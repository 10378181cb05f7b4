"""Vectors, full text and places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def distance_l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def distance_cos(a: Column, b: Column) -> Column:
    """1 - cosine; 0 for two zero vectors, 1 where the product is 0."""
    d, x, y = dot(a, b), dot(a, a), dot(b, b)
    return F.when((x == 0) & (y == 0), 0.0).when(d == 0, 1.0).otherwise(1 - d / (F.sqrt(x) * F.sqrt(y)))


def distance_jaccard(a: Column, b: Column) -> Column:
    """1 - sum of minima / sum of maxima; NaN where the maxima sum to 0."""
    low = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    high = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(high == 0, F.lit(float("nan"))).otherwise(1 - low / F.nullif(high, F.lit(0.0)))


def knn(df: DataFrame, vector: str, query: list[float], k: int, id_col: str, distance=distance_cos, digits: int = 4) -> DataFrame:
    """Exact nearest rows to one vector: a top-k over a scan, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id_col, distance(F.col(vector), q).alias("distance")).orderBy("distance", id_col).limit(k).select(id_col, F.round("distance", digits).alias("distance"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of ASCII."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(df: DataFrame, id_col: str, text: str, query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best rows by BM25, ties by id.

    Counts of the query's terms are taken in the scan; only rows with a term go on.
    """
    rows = df.select(id_col, tokens(F.col(text)).alias("t"))

    def count_of(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == F.lit(term)))

    rows = rows.select(id_col, F.size("t").alias("len"), *[count_of(q).alias(f"f{i}") for i, q in enumerate(query)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(query))])
    scored = rows.where(" or ".join(f"f{i} > 0" for i in range(len(query)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(query)):
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.ln(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def phrase(text: Column, words: list[str]) -> Column:
    """Whether the words follow each other in the text."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(" " + " ".join(words) + " ")


def sphere_distance(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def within(df: DataFrame, lng: str, lat: str, at_lng: float, at_lat: float, metres: float) -> DataFrame:
    """Rows at most `metres` away; a box comes first, so that a scan can skip."""
    d_lat = math.degrees(metres / EARTH_RADIUS_M) * 1.001
    d_lng = d_lat / max(1e-9, math.cos(math.radians(min(89.9, abs(at_lat) + d_lat))))
    box = F.col(lat).between(at_lat - d_lat, at_lat + d_lat) & F.col(lng).between(at_lng - d_lng, at_lng + d_lng)
    return df.where(box).where(sphere_distance(F.col(lng), F.col(lat), F.lit(at_lng), F.lit(at_lat)) <= metres)


def morton_cell(lng: Column, lat: Column, bits: int = 8) -> Column:
    """Cell number of a grid over the globe, bits of both axes interleaved."""
    x = F.least(F.floor((lng + 180) / 360 * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1)), 2 * i + 1))
    return out


def contains(ring: list[tuple[float, float]], lng: Column, lat: Column) -> Column:
    """Point in polygon by the crossings of a ray (even-odd)."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            inside = inside != (((lat < y1) != (lat < y2)) & (lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1))
    return inside


def inside_ring(ring: Column, lng: Column, lat: Column) -> Column:
    """Point in polygon for a column of rings (arrays of x and y), by the crossings of a ray (even-odd)."""
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda a, b: ((lat < a["y"]) != (lat < b["y"])) & (lng < (b["x"] - a["x"]) * (lat - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def inverse_links(parents: DataFrame, children: DataFrame, key: str, foreign: str, order: list[str], item: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Parents with a page of their children's items in order."""
    ranked = children.withColumn("_r", F.row_number().over(Window.partitionBy(foreign).orderBy(*order))).where((F.col("_r") > offset) & (F.col("_r") <= offset + limit))
    pages = ranked.groupBy(foreign).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda e: e[item]).alias("items"))
    return parents.join(pages, parents[key] == pages[foreign], "left").select(parents["*"], F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
