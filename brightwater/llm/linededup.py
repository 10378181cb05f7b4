"""Line deduplication by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_NO_ID = (1 << 63) - 1


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (id, n_lines, n_removed, text, *keep).

    keep: columns of the input to pass through.
    Lines are split at line feeds.  A window is `window` consecutive lines of one
    document; of equal windows the first, by (id, position), stands, and lines
    covered by any later one are removed.  Windows are judged on the input.

    Windows are compared by two 64-bit hashes with different seeds.  The first
    occurrence of a window is a minimum, combined before the shuffle; the join back
    is an equi-join, so that adaptive execution can split a window that a third of
    all documents hold.  Covered positions are merged into intervals and the text is
    rebuilt from the slices between them, in time linear in its lines.

    Null text stays null, with no lines.  A null id sorts after all others.  Rows
    with one id and one text are one document and get the same result; with one id
    and different texts they are ordered by a hash of the text.  An empty table
    gives an empty result.  Other columns are not read.
    """
    ship(docs.sparkSession)
    split = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("o"),
        F.xxhash64(text_col).alias("th"),
        F.split(text_col, "\n", -1).alias("lines"),
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
    )
    held = [f"_k{i}" for i in range(len(keep))]
    hashed = split.where(F.size("lines") >= window).select("o", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit(97), x)).alias("b"))

    def gram(column: str, seed: int):
        return lambda i: F.xxhash64(F.lit(seed), *[F.element_at(column, (i + k).cast("int")) for k in range(1, window + 1)])

    places = F.sequence(F.lit(0), F.size("a") - window)
    windows = hashed.select("o", "th", F.posexplode(F.arrays_zip(F.transform(places, gram("a", 1)).alias("x"), F.transform(places, gram("b", 2)).alias("y"))).alias("pos", "w"))
    windows = windows.select("o", "th", "pos", F.col("w.x").alias("x"), F.col("w.y").alias("y"))
    here = F.struct("o", "th", "pos")
    first = windows.groupBy("x", "y").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last").drop("last")
    later = windows.join(first, ["x", "y"]).where(here > F.col("first"))
    starts = later.groupBy("o", "th").agg(F.sort_array(F.collect_set("pos")).alias("s"))

    joined = split.join(starts.hint("shuffle_hash"), ["o", "th"], "left")
    k = F.size("s")
    opens = F.filter("s", lambda x, i: (i == 0) | (x - F.get("s", i - 1) > window))
    closes = F.filter("s", lambda x, i: (i == k - 1) | (F.get("s", i + 1) - x > window))
    marked = joined.withColumns({"opens": opens, "closes": closes})
    n, m = F.size("lines"), F.size("opens")

    def between(j):
        low = F.when(j == 0, F.lit(0)).otherwise(F.get("closes", j - 1) + window)
        high = F.when(j == m, n).otherwise(F.get("opens", j))
        return F.slice("lines", (low + 1).cast("int"), (high - low).cast("int"))

    kept = F.when(F.col("s").isNull(), F.col("lines")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), m), between)))
    lines = F.coalesce(n, F.lit(0)).cast("long")
    rebuilt = marked.select("id", F.when(F.col("lines").isNull(), F.lit(0)).otherwise(lines).cast("long").alias("n_lines"), kept.alias("kept"), *held)
    return rebuilt.select(
        F.col("id").alias(id_col),
        "n_lines",
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("text"),
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
    )
