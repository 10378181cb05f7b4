"""b-bit MinHash near-duplicate detection, confirmed on the shingles themselves.

One pass over the texts gives each document K minima.  Bands of whole minima
give candidate groups; only the low b bits of each minimum are kept, packed into
a signature whose bit counts estimate, corrected for chance collisions, the
similarity of a candidate pair.  Pairs that can reach the threshold are then
confirmed on their texts: words are numbered by their bytes and shingles by their
words, so that no hash decides a link.

Documents with equal sets form one class and are represented by its smallest id;
sets count as equal where their sizes and two 64-bit sums over two different hashes
of the shingles agree.
Within a band's group, members are first held against one pivot (the smallest
id); groups whose members all join the pivot's component need no further
comparison.  What remains (members outside it) is held against the group, with
the signature test inside the join, so that pairs within a group are not
expanded and the work is linear in a group for each member that stands apart.
No partner or candidate is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release
from .components import connected_components
from .textkernel import Words, buffers, exact_runs, gram_hashes, lean, mix, slices

K = 512
#: Minima that are compared first; most pairs need no more.
ROUGH = 128
BITS = 4
ROWS = 4
BANDS = 24
_rng = np.random.Generator(np.random.PCG64(20240601))
_MULTIPLY = _rng.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, K, dtype=np.uint32)
_BAND = _rng.integers(0, 1 << 63, (ROWS, BANDS), dtype=np.uint64) | np.uint64(1)

SIGNED = "n_shingles long, s1 long, s2 long, bands array<long>, sig array<long>"


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, two hashes of all shingles, their texts' bounds) by slices of bounded size."""
    for a, b in slices(column):
        data, offsets = buffers(column.slice(a, b - a))
        found = Words(data, offsets, lower=True)
        second = found.second()
        at = found.starts(words)
        grams, other = (gram_hashes(h, words, k)[at] if len(at) else np.empty(0, np.uint64) for k, h in enumerate((found.hash, second)))
        doc = found.doc[at]
        count = np.diff(found.first)
        few = np.flatnonzero((count > 0) & (count < words))
        if len(few):
            short = np.array([[gram_hashes(h[found.first[i] : found.first[i + 1]], int(count[i]), k)[0] for i in few] for k, h in enumerate((found.hash, second))], np.uint64)
            grams, other, doc = np.concatenate([grams, short[0]]), np.concatenate([other, short[1]]), np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            grams, other, doc = grams[order], other[order], doc[order]
        yield a, grams, other, np.searchsorted(doc, np.arange(b - a + 1))


def shingle_numbers(doc: np.ndarray, first: np.ndarray, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of all shingles, from words' texts and numbers: equal if and only if the shingles are.

    first: each text's first word, and the number of words.  A text of fewer than n
    words is one shingle, which no longer text has.
    """
    at = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
    runs = exact_runs(numbers, n)[at] if len(at) else at
    of, count = doc[at], np.diff(first)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        known: dict[bytes, int] = {}
        short = [known.setdefault(numbers[first[i] : first[i + 1]].tobytes(), -1 - len(known)) for i in few]
        of, runs = np.concatenate([of, few]), np.concatenate([runs, np.array(short, np.int64)])
    return of, runs


def _list(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    flat = pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)


def _sums(grams: np.ndarray, other: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    """What tells a set from others: its size, and the sums of both hashes of its shingles."""
    own, at = np.unique(grams, return_index=True)
    return len(own), own.sum(dtype=np.uint64), other[at].sum(dtype=np.uint64)


def _signer(words: int):
    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, grams, other, bounds in shingle_sets(batch.column(1), words):
                n = len(bounds) - 1
                sizes = np.zeros(n, np.int64)
                sums = np.zeros((n, 2), np.uint64)
                minima = np.zeros((n, K), np.uint32)
                full = np.flatnonzero(np.diff(bounds) > 0)
                if len(full):
                    at = bounds[:-1][full]
                    h32 = (grams >> np.uint64(32)).astype(np.uint32)
                    for k in range(K):
                        value = h32 ^ _FLIP[k]
                        value *= _MULTIPLY[k]
                        minima[full, k] = np.minimum.reduceat(value, at)
                    for i in full:
                        sizes[i], *sums[i] = _sums(grams[bounds[i] : bounds[i + 1]], other[bounds[i] : bounds[i + 1]])
                rows = minima[:, : ROWS * BANDS].reshape(n, BANDS, ROWS).astype(np.uint64)
                key = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    key = mix(key ^ (rows[:, :, r] * _BAND[r]))
                key = mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                # bit p of 64 minima stands in one number, the bits of the same minima side by side
                planes = [np.packbits((minima >> np.uint32(p) & np.uint32(1)).astype(np.uint8), axis=1).view(np.uint64) for p in range(BITS)]
                packed = np.stack(planes, axis=2).reshape(n, -1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, n), pa.array(sizes), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), _list(key), _list(packed)],
                    names=["id", "n_shingles", "s1", "s2", "bands", "sig"],
                )

    return sign


def _keyer(words: int):
    """(id, text, s1, s2, n): texts with their classes."""

    @lean
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, grams, other, bounds in shingle_sets(batch.column(1), words):
                own = [_sums(grams[x:y], other[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                sums = np.array([x[1:] for x in own], np.uint64).reshape(len(own), 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(own)), batch.column(1).slice(a, len(own)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([x[0] for x in own], pa.int64())], names=["id", "text", "s1", "s2", "n"]
                )

    return key


def linked(left: pa.Array, right: pa.Array, words: int, numerator: int, denominator: int) -> np.ndarray:
    """Which pairs of texts have denominator * |A & B| >= numerator * |A | B| on their sets of shingles."""
    one, other = (Words(*buffers(c), lower=True) for c in (left, right))
    n = len(left)
    # one numbering for both sides, which stand end to end
    doc, first = np.concatenate([one.doc, other.doc + n]), np.concatenate([one.first, other.first[1:] + len(one.start)])
    doc, runs = shingle_numbers(doc, first, np.concatenate(one.numbers(other)), words)
    runs = np.unique(runs, return_inverse=True)[1]
    width = int(runs.max(initial=0)) + 1
    a, b = (np.unique(doc[side] % n * width + runs[side]) for side in (doc < n, doc >= n)) if n else (doc, doc)
    common = np.intersect1d(a, b, assume_unique=True)
    size_a, size_b, shared = (np.bincount(x // width, minlength=n) for x in (a, b, common))
    return denominator * shared >= numerator * (size_a + size_b - shared)


def _confirmer(words: int, numerator: int, denominator: int):
    @lean
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                mask = pa.array(linked(part.column(2), part.column(3), words, numerator, denominator))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["u", "v"])

    return confirm


def estimate(a: str, b: str, minima: int = K) -> Column:
    """Similarity from the packed signatures in two columns: share of equal b-bit groups, less what chance makes equal."""
    differ = " + ".join("bit_count(" + " | ".join(f"({a}[{i}] ^ {b}[{i}])" for i in range(g * BITS, (g + 1) * BITS)) + ")" for g in range(minima // 64))
    chance = 1.0 / (1 << BITS)
    return F.expr(f"(({minima} - ({differ})) / {float(minima)}D - {chance}D) / {1 - chance}D")


def slack(threshold: float, minima: int = K, deviations: float = 4.8) -> float:
    """The estimate below which a pair is given up: a pair at the threshold falls below with a chance of 8e-7."""
    chance = 1.0 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return (p - deviations * math.sqrt(p * (1 - p) / minima) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One row per input row: (id, n_shingles, class_id, component_id, kept).

    Two documents are linked when denominator * |A & B| >= numerator * |A | B| on
    their sets of distinct shingles of `words` words (A-Z lower-cased; a text of
    fewer words is one shingle).  component_id is the smallest id reachable by
    links, kept says that it is the row's own.

    Null text, and text without words: empty set, linked with nothing.  A null id:
    linked with nothing, component_id null, kept.  Rows that repeat an id are one
    document as far as links go: each class (texts of one set) goes by its smallest
    id, ids are linked when any of their classes are, and each row gets the
    component of its own class.
    An empty table gives an empty result.  Other columns are not read.  A pair at
    0.8 shares no band with a chance of (1 - 0.8**4)**24 = 4e-6, at 0.85 of 2e-8.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.put("signed", source.mapInArrow(_signer(words), "id long, " + SIGNED))

    whole = signed.where("n_shingles > 0 and id is not null")
    classes = whole.groupBy("s1", "s2", "n_shingles").agg(F.min_by(F.struct("id", "bands", "sig"), "id").alias("r"))
    reps = scratch.put("reps", classes.select("s1", "s2", F.col("n_shingles").alias("n"), "r.*"))
    banded = reps.select("id", F.explode("bands").alias("key"))
    # a group needs two different sets; the smallest id in it is its pivot
    groups = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("m")).where("m > 1").drop("m")
    members = scratch.put("members", banded.join(groups, "key"))

    sketch = reps.select("id", "n", "sig")
    limit, rough = slack(numerator / denominator), slack(numerator / denominator, ROUGH)

    def plausible(pairs: DataFrame) -> DataFrame:
        a = sketch.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
        b = sketch.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
        return pairs.join(a, "u").join(b, "v").where(_may_link("nu", "nv", "su", "sv")).select("u", "v")

    def _may_link(nu: str, nv: str, su: str, sv: str) -> Column:
        sizes = denominator * F.least(nu, nv) >= numerator * F.greatest(nu, nv)
        return sizes & (estimate(su, sv, ROUGH) >= rough) & (estimate(su, sv) >= limit)

    wanted = members.select("id").distinct()
    texts = source.join(wanted.hint("shuffle_hash"), "id", "left_semi")
    if _repeats(whole):
        # an id may stand on other texts too; those of all classes that it represents count
        keyed = texts.mapInArrow(_keyer(words), "id long, text string, s1 long, s2 long, n long").dropDuplicates(["id", "s1", "s2", "n"])
        texts = keyed.join(reps.select("id", "s1", "s2", "n"), ["id", "s1", "s2", "n"], "left_semi").select("id", "text")
    texts = scratch.put("texts", texts)

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("u"), F.col("text").alias("a"))
        b = texts.select(F.col("id").alias("v"), F.col("text").alias("b"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_confirmer(words, numerator, denominator), "u long, v long")

    stars = members.where("id != pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct()
    links = scratch.put("links-1", confirmed(plausible(stars)))
    first = scratch.put("first", connected_components(links, scratch, "cc1"))
    release(spark)

    # what is not in its pivot's component is held against the rest of its group
    of = first.select(F.col("node").alias("id"), "component")
    own = members.join(of, "id", "left").select("key", "id", "pivot", F.coalesce("component", "id").alias("c"))
    of_pivot = first.select(F.col("node").alias("pivot"), F.col("component").alias("pc"))
    own = own.join(of_pivot, "pivot", "left").select("key", "id", "c", F.coalesce("pc", "pivot").alias("pc"), "pivot")
    apart = scratch.put("apart", own.where("c != pc"))
    open_groups = apart.select("key").distinct()
    seen = reps.select("id", "n", "sig", "bands")
    group = own.join(open_groups, "key", "left_semi").where("id != pivot").join(seen, "id")
    x = apart.join(seen, "id").select("key", F.col("id").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"), F.col("sig").alias("su"), F.col("bands").alias("bu"))
    y = group.select("key", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("sig").alias("sv"), F.col("bands").alias("bv"), F.col("pc").alias("pv"))
    # two members that both stand apart meet once
    once = (F.col("cv") == F.col("pv")) | (F.col("u") < F.col("v"))
    # a pair is tested in the first band that both share: there one of them is the pivot, and was tested, or stands apart
    first_band = F.expr("coalesce(" + ", ".join(f"if(bu[{i}] = bv[{i}], bu[{i}], null)" for i in range(BANDS)) + ")")
    rest = x.join(y, "key").where((F.col("cu") != F.col("cv")) & once & (first_band == F.col("key")) & _may_link("nu", "nv", "su", "sv"))
    later = scratch.put("links-2", confirmed(rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    final = connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(later), scratch, "cc2")

    labelled = reps.select("s1", "s2", F.col("n").alias("n_shingles"), F.col("id").alias("class_id")).join(final.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    out = signed.join(labelled, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "class_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").cast(kind).alias(id_col),
        "n_shingles",
        F.coalesce("class_id", "id").cast(kind).alias("class_id"),
        component.cast(kind).alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )


def _repeats(whole: DataFrame) -> bool:
    """Whether any id stands on several rows."""
    return not whole.groupBy("id").count().where("count > 1").isEmpty()
