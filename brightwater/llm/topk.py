"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .embeddings import matrix
from .textkernel import lean

_LONG = np.iinfo(np.int64)
#: Bytes of a block of candidates and of a block of queries, and blocks that one task searches.
BLOCK, QUERIES, STRAND = 2 << 20, 256 << 10, 64


def _quantiser(scale: int):
    """Usable vectors as whole numbers: (id, dim, norm, q, query)."""

    @lean
    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat, starts = matrix(batch.column(1))
            rows = np.flatnonzero(lengths > 0)
            whole = np.floor(scale * flat).clip(-(2.0**62), 2.0**62)
            parts = [whole[starts[r] : starts[r] + lengths[r]] for r in rows]
            at = pa.array(rows)
            columns = [batch.column(0).take(at), pa.array(lengths[rows].astype(np.int32)), pa.array([float(np.sqrt(x @ x)) for x in parts], pa.float64()), pa.array([x.astype("<i8").tobytes() for x in parts], pa.binary()), batch.column(2).take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "norm", "q", "query"])

    return quantise


_PACKED = "dim int, norm double, ids binary, m binary"


def _packer(size: int):
    """Rows of one dimension that follow each other, as one row of `size` bytes or so: their ids and their matrix."""

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, float, bytes]] = []
        dim = held_bytes = 0

        def out() -> pa.RecordBatch:
            ids = np.array([h[0] for h in held], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([max(h[1] for h in held)], pa.float64()), pa.array([ids], pa.binary()), pa.array([b"".join(h[2] for h in held)], pa.binary())], names=["dim", "norm", "ids", "m"])

        for batch in batches:
            for i, d, norm, q in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (d != dim or held_bytes >= size):
                    yield out()
                    held, held_bytes = [], 0
                dim = d
                held.append((i, norm, q))
                held_bytes += len(q)
        if held:
            yield out()

    return pack


class Best:
    """The k best rows so far of each query of a block, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (minus score, row id), best first
        #: Rows scored for any query.
        self.scored = 0

    def least(self, w: int) -> float:
        """The kth score, that a row must reach."""
        return -self.found[w][-1][0] if len(self.found[w]) == self.k else -math.inf

    def take(self, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.ids[w]
        scores, ids = scores[other], ids[other]
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        keep = scores >= self.least(w)
        if keep.any():
            self.found[w] = sorted(self.found[w] + [(-int(s), int(i)) for s, i in zip(scores[keep], ids[keep], strict=True)])[: self.k]


def threshold_search(best: Best, rows: np.ndarray, row_ids: np.ndarray, depth: int = 64) -> None:
    """Improve the best rows of each query by those of one block.

    Each dimension has its rows sorted by value; a query reads it from the top where
    its own component is positive, from the bottom where negative, and not at all
    where it is nothing.  Lists are read to a depth; rows that come up for the first
    time, and only these, are scored.  The bound is the score of a row that stands
    at that depth in every list: a query whose kth score, of this block or of those
    before, is above it stops (an equal one could still win by its id), the others
    read on to four times the depth.  A block whose first rows cannot beat the kth
    score is not read.
    """
    n, dim = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    rising = np.take_along_axis(rows, order, 0)
    largest = float(np.abs(rows).astype(np.float64).max(initial=0)) * float(np.abs(best.queries).astype(np.float64).max(initial=0)) * dim
    kind = np.float64 if largest < 2.0**53 else object
    r, rising = rows.astype(kind), rising.astype(kind)
    for w, q in enumerate(best.queries.astype(kind)):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if best.least(w) > q[up] @ rising[-1, up] + q[down] @ rising[0, down]:
            continue
        seen = np.zeros(n, bool)
        read, to = 0, min(n, depth)
        while True:
            new = np.zeros(n, bool)
            if to == n:
                new[:] = True
            else:
                new[order[n - to : n - read, up]] = True
                new[order[read:to, down]] = True
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            best.scored += len(at)
            best.take(w, r[at] @ q, row_ids[at])
            if to == n or best.least(w) > q[up] @ rising[n - to, up] + q[down] @ rising[to - 1, down]:
                break
            read, to = to, min(n, to * 4)


def _searcher(k: int):
    """(query_id, id, score) of the best rows of a strand; its blocks follow each other, the longest vectors first."""

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(int(q), i, min(max(-s, _LONG.min), _LONG.max)) for q, found in zip(best.ids, best.found, strict=True) for s, i in found] if best else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(3)], names=["query_id", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                strand, dim, qi, qm, ids, m = (c[i].as_py() for c in batch.columns[:6])
                if key != (strand, dim, qi):
                    yield from out()
                    key, best = (strand, dim, qi), Best(np.frombuffer(qm, "<i8").reshape(-1, dim), np.frombuffer(qi, "<i8"), k)
                threshold_search(best, np.frombuffer(m, "<i8").reshape(-1, dim), np.frombuffer(ids, "<i8"))
        yield from out()

    return search


def exact_topk(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score): each query's k best other rows by inner product of floor(scale * x).

    Queries are the rows for which is_query holds; candidates are all rows but the
    query's own.  Ties go to the smaller id; fewer candidates give fewer rows.

    Candidates are dealt into blocks by their length (Euclidean norm), and blocks
    into strands of STRAND or so.  A task takes a block of queries through one
    strand, the longest vectors first, and carries each query's kth score from block
    to block; the strands' winners are ranked.

    Rows with a null id, and vectors that are null or empty or hold null or
    non-finite components, take no part; vectors of different lengths do not meet.
    Rows that repeat an id count once (the one with the smallest hash).  Scores are
    exact; one beyond a long is the nearest long.  An empty table gives an empty
    result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    kind = dict(vectors.dtypes)[id_col]
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"), F.coalesce(is_query, F.lit(False)).alias("query")).where("id is not null")
    one = source.groupBy("id").agg(F.min_by(F.struct("e", "query"), F.xxhash64("e")).alias("s")).select("id", "s.e", "s.query")
    ready = scratch.put("ready", one.mapInArrow(_quantiser(scale), "id long, dim int, norm double, q binary, query boolean"))
    size = ready.agg(F.coalesce(F.sum("dim"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("query"), F.col("dim"))), F.lit(0)).alias("m")).first()
    blocks, query_blocks = max(1, math.ceil(size["n"] * 8 / block)), max(1, math.ceil(size["m"] * 8 / query_block))

    def packed(name: str, rows: DataFrame, n: int, limit: int) -> DataFrame:
        order = [F.col("dim"), F.desc("norm"), F.col("id")]
        near = rows.select("id", "dim", "norm", "q").repartitionByRange(n, *order).sortWithinPartitions(*order)
        return scratch.put(name, near.mapInArrow(_packer(limit), _PACKED))

    strands = max(1, math.ceil(blocks / STRAND))
    q = packed("queries", ready.where("query"), query_blocks, query_block)
    q = q.select("dim", F.col("ids").alias("qi"), F.col("m").alias("qm"), F.explode(F.sequence(F.lit(0), F.lit(strands - 1))).alias("strand"))
    c = packed("blocks", ready, blocks, block).withColumn("strand", F.pmod(F.xxhash64("ids"), F.lit(strands)).cast("int"))
    # the stated query set against all rows, in blocks
    pairs = q.join(c, ["dim", "strand"]).select("strand", "dim", "qi", "qm", "ids", "m", "norm")
    dealt = pairs.repartition(max(1, min(strands * query_blocks, 100_000)), "strand", "dim", "qi").sortWithinPartitions("strand", "dim", "qi", F.desc("norm"))
    best = dealt.mapInArrow(_searcher(k), "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").cast(kind), F.col("rank").cast("int").alias("rank"), F.col("id").cast(kind).alias(id_col), "score")
