"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, exact verification."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components, forest
from .textkernel import lean, lean_group

TABLES, PROBES = 8, 6
#: Rows of a component's block, and a sixteenth of those of a table's axis: what is larger is compared block by block.
BLOCK = 4096
#: Vectors up to which all tables are searched at once.
AT_ONCE = 100_000
#: Edges of a forest that one task finishes: 16 bytes each, without the rounds (and their plans in the driver).
LOCAL = 1_000_000
_SEED = 7919


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, orthonormal."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


@functools.lru_cache(maxsize=4)
def _rotations(width: int, tables: int) -> np.ndarray | None:
    """Matrices of the rotations, (tables, 2, width, width), where these are small."""
    if width > 256:
        return None
    rng = np.random.Generator(np.random.PCG64(_SEED))
    return np.stack([np.stack([_rotated(np.eye(width), rng) for _ in range(2)]) for _ in range(tables)])


def _rotated(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size=y.shape[1]))
    return y


def cross_polytope(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Codes of unit rows, (rows, tables, probes): the row's own bucket, then the next likely ones.

    A table joins two hashes; a hash is the signed axis nearest to the rotated row,
    and the probes take the pairs of axes that lose the least.
    """
    n, dim = x.shape
    width = _width(dim)
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    rng = np.random.Generator(np.random.PCG64(_SEED))
    matrices = _rotations(width, tables)
    out = np.empty((n, tables, probes), np.int64)
    best = min(4, width)
    for t in range(tables):
        axes, losses = [], []
        for k in range(2):
            y = _rotated(padded, rng) if matrices is None else padded @ matrices[t, k]
            size = np.abs(y)
            order = np.argpartition(-size, best - 1, axis=1)[:, :best]
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(size, order, 1), axis=1, kind="stable"), 1)
            axes.append(order * 2 + (np.take_along_axis(y, order, 1) < 0))
            losses.append(size.max(axis=1, keepdims=True) - np.take_along_axis(size, order, 1))
        code = (axes[0][:, :, None] * (2 * width) + axes[1][:, None, :]).reshape(n, -1)
        loss = (losses[0][:, :, None] + losses[1][:, None, :]).reshape(n, -1)
        out[:, t] = np.take_along_axis(code, np.argsort(loss, axis=1, kind="stable")[:, :probes], 1)
    return out


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the lists (0 for unusable ones), and the flat doubles with each list's start."""
    values = column.flatten() if column.null_count == 0 else pa.array([x for v in column.to_pylist() if v is not None for x in v], pa.float64())
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes nan
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    finite = np.isfinite(flat)
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~finite, out=bad[1:])
    lengths = np.where(bad[starts + lengths] - bad[starts] > 0, 0, lengths)
    return lengths, flat, starts


def _width(dim: int) -> int:
    """Axes of the rotated space."""
    return max(4, 1 << (dim - 1).bit_length())


def _code_type(dim: int) -> str:
    """What holds a code: two signed axes."""
    return "<u2" if (2 * _width(dim)) ** 2 <= 1 << 16 else "<i4"


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch (id, label, vector, ...) by length, with their vectors: finite and not all zero."""
    lengths, flat, starts = matrix(batch.column(2))
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        for k in range(0, len(rows), 2048):
            part = rows[k : k + 2048]
            raw = flat[starts[part][:, None] + np.arange(dim)] + 0.0  # no negative zeros
            good = raw.any(axis=1)
            if good.any():
                yield part[good], raw[good]


def _held(raw: np.ndarray) -> list[bytes]:
    """Vectors as floats where these hold them exactly, else as doubles."""
    with np.errstate(over="ignore"):
        single = raw.astype("<f4")
        exact = (single == raw).all(axis=1)
    return [(single[i] if exact[i] else raw[i]).tobytes() for i in range(len(raw))]


def _unit(held: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of what _held() gave."""
    x = np.empty((len(rows), dim))
    for k, r in enumerate(rows.tolist()):
        one = held[r].as_buffer()
        x[k] = np.frombuffer(one, "<f4" if one.size == 4 * dim else "<f8")
    return _normed(x)


def _normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lean
def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors: length and a 128-bit hash."""
    for batch in batches:
        for part, raw in _usable(batch):
            h = [hashlib.blake2b(x, digest_size=16).digest() for x in _held(raw)]
            at = pa.array(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(part), raw.shape[1], np.int32)), pa.array(h, pa.binary())], names=["id", "label", "dim", "h"])


@lean
def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class representatives (id, label, vector, n): what _held() gives, and the codes."""
    for batch in batches:
        for part, raw in _usable(batch):
            dim, at = raw.shape[1], pa.array(part)
            codes = cross_polytope(_normed(raw)).reshape(len(part), -1).astype(_code_type(dim))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in (0, 1, 3)), pa.array(np.full(len(part), dim, np.int32)), pa.array(_held(raw), pa.binary()), pa.array([row.tobytes() for row in codes], pa.binary())],
                names=["id", "label", "n", "dim", "x", "codes"],
            )


def _axes(codes: pa.Array, rows: np.ndarray, dim: int, tables: range) -> tuple[np.ndarray, ...]:
    """For each row, table and first axis among its probes: row, table, axis, whether it is the row's own; its entries' starts; their second axes, the own first."""
    kind, sides = _code_type(dim), 2 * _width(dim)
    code = np.stack([np.frombuffer(codes[r].as_buffer(), kind) for r in rows.tolist()]).astype(np.int64).reshape(len(rows), TABLES, -1)[:, tables.start : tables.stop]
    probes = code.shape[2]
    place = np.arange(len(rows) * len(tables)).repeat(probes)  # row and table
    key = place * sides + (code // sides).reshape(-1)
    order = np.argsort(key, kind="stable")  # the own bucket comes first among its axis's
    key, own = key[order], order % probes == 0
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    place, axis = key[starts] // sides, key[starts] % sides
    return place // len(tables), place % len(tables) + tables.start, axis, own[starts], np.append(starts, len(key)), (code % sides).reshape(-1)[order]


def _counter(tables: range):
    """How many rows of a batch meet in a table's first axis."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                row, t, axis, *_ = _axes(batch.column(2), rows, dim, tables)
                out = pa.table([batch.column(0).take(pa.array(rows[row])), pa.array(t, pa.int32()), pa.array(axis, pa.int32())], names=["label", "t", "axis"])
                out = out.group_by(["label", "t", "axis"]).aggregate([([], "count_all")])
                yield from out.append_column("dim", pa.array(np.full(len(out), dim, np.int32))).select(["label", "dim", "t", "axis", "count_all"]).rename_columns(["label", "dim", "t", "axis", "m"]).to_batches()

    return count


def _dealer(tables: range):
    """Each vector once for each first axis that it probes: in bytes, a scale, and a bound of what the bytes lose."""

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                every = np.flatnonzero(dims == dim)
                for k in range(0, len(every), 1024):
                    rows = every[k : k + 1024]
                    x = _unit(batch.column(3), rows, dim)
                    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
                    small = np.rint(x / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
                    lost = np.linalg.norm(x - small * scale[:, None].astype(np.float64), axis=1) * (1 + 1e-6) + 1e-6 + dim * np.finfo(np.float32).eps  # sums in single precision
                    row, t, axis, own, starts, second = _axes(batch.column(4), rows, dim, tables)
                    at = pa.array(row)
                    held = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * dim).astype(np.int32)), pa.py_buffer(small)])
                    probes = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(second.astype("<i4"))])
                    both = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(both), batch.column(1).take(both), batch.column(2).take(both), pa.array(t, pa.int32()), pa.array(axis, pa.int32()), pa.array(own), probes, held.take(at), pa.array(scale).take(at), pa.array(lost.astype(np.float32)).take(at)],
                        names=["id", "label", "dim", "t", "axis", "own", "second", "q", "scale", "lost"],
                    )

    return deal


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of rows (each the smallest row reached so far) after the links a, b."""
    u, v = label[a], label[b]
    different = u != v
    if not different.any():
        return label
    nodes, roots = forest(np.maximum(u, v)[different], np.minimum(u, v)[different])
    to = np.arange(len(label))
    to[nodes] = roots
    return to[label]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by keys (the last one within a run), and where runs of equal keys but the last begin and end."""
    order = np.lexsort(keys[::-1])
    changed = np.zeros(max(0, len(order) - 1), bool)
    for k in keys[:-1]:
        changed |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(np.concatenate([[True], changed, [True]]))


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    return pc.dictionary_encode(column.combine_chunks()).indices.to_numpy(zero_copy_only=False)


def _candidates(threshold: float):
    """A spanning forest of the pairs that share a bucket and, for all that their bytes say, may reach the threshold."""

    @lean_group
    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, dims, t, axis, i, j, role = (table[c].to_numpy() for c in ("id", "dim", "t", "axis", "i", "j", "role"))
        scales, losses = table["scale"].to_numpy(), table["lost"].to_numpy()
        small, probes = (table[c].combine_chunks() for c in ("q", "second"))
        order, edges = _runs(_numbered(table["label"]), dims, t, axis, i, j, ids)
        us, vs = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            dim, name, role_here = int(dims[rows[0]]), ids[rows], role[rows]
            own = role_here != 1
            if len(rows) < 2 or not own.any():
                continue
            x = np.stack([np.frombuffer(small[r].as_buffer(), np.int8) for r in rows.tolist()]).reshape(len(rows), dim).astype(np.float32) * scales[rows][:, None]
            lost = losses[rows]
            seconds = [np.frombuffer(probes[r].as_buffer(), "<i4") for r in rows.tolist()]
            home = np.array([s[0] for s in seconds])
            who, where = np.arange(len(rows)).repeat([len(s) for s in seconds]), np.concatenate(seconds)
            asks = role_here[who] != 0
            who, where = who[asks], where[asks]
            sort = np.argsort(where, kind="stable")
            who, where = who[sort], where[sort]
            bases = np.flatnonzero(own)
            bases = bases[np.argsort(home[bases], kind="stable")]
            buckets, first = np.unique(home[bases], return_index=True)
            last = np.append(first[1:], len(bases))
            lo, hi = np.searchsorted(where, buckets), np.searchsorted(where, buckets, "right")
            label = np.arange(len(rows))
            for f, g, p, q in zip(first.tolist(), last.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for k in range(f, g, 512):
                    base = bases[k : min(g, k + 512)]
                    for m in range(p, q, 2048):
                        prober = who[m : min(q, m + 2048)]
                        near = x[base] @ x[prober].T >= np.float32(threshold) - (1 + lost[base])[:, None] * (1 + lost[prober]) + 1
                        near &= label[base][:, None] != label[prober]
                        at, to = np.nonzero(near)
                        if len(at):
                            label = _merged(label, base[at], prober[to])
            other = np.flatnonzero(label != np.arange(len(rows)))
            us.append(name[other]), vs.append(name[label[other]])
        none = [np.empty(0, np.int64)]
        return pa.table({"u": pa.array(np.concatenate(us or none)), "v": pa.array(np.concatenate(vs or none))})

    return search


def _verifier(threshold: float):
    """Counts of links and a spanning forest of them, over pairs of blocks of a component, in double precision."""

    @lean_group
    def verify(key: tuple, table: pa.Table) -> pa.Table:
        ids, size, dims, component, i, j, block = (table[c].to_numpy() for c in ("id", "n", "dim", "component", "i", "j", "block"))
        held = table["x"].combine_chunks()
        order, edges = _runs(component, i, j, ids)
        us, vs, ns = [], [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            x, name, weight = _unit(held, rows, int(dims[rows[0]])), ids[rows], size[rows].astype(np.float64)
            left, right = np.flatnonzero(block[rows] == i[rows[0]]), np.flatnonzero(block[rows] == j[rows[0]])
            alone = i[rows[0]] == j[rows[0]]
            label, links = np.arange(len(rows)), np.zeros(len(rows))
            for k in range(0, len(left), 512):
                part = left[k : k + 512]
                near = x[part] @ x[right].T >= threshold
                if alone:
                    near[np.arange(len(part)), part] = False
                links[part] += near @ weight[right]
                if not alone:
                    links[right] += weight[part] @ near
                at, to = np.nonzero(near & (label[part][:, None] != label[right]))
                label = _merged(label, part[at], right[to])
            some, other = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rows)))
            us += [name[some], name[other]]
            vs += [np.full(len(some), -1), name[label[other]]]
            ns += [links[some].astype(np.int64), np.zeros(len(other), np.int64)]
        linked = np.concatenate([np.repeat([k % 2 == 1], len(v)) for k, v in enumerate(vs)])
        return pa.table({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs), mask=~linked), "n": pa.array(np.concatenate(ns))})

    return verify


def _search(reps: DataFrame, tables: range, threshold: float, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that join the candidates of some tables."""
    keys = ["label", "dim", "t", "axis"]
    counted = reps.select("label", "dim", "codes").mapInArrow(_counter(tables), "label string, dim int, t int, axis int, m long").groupBy(*keys).agg(F.sum("m").alias("m"))
    counted = scratch.put(f"counted-{tables.start}", counted)
    total, most = counted.agg(F.sum("m"), F.max("m")).first()
    dealt = reps.select("id", "label", "dim", "x", "codes").mapInArrow(_dealer(tables), "id long, label string, dim int, t int, axis int, own boolean, second binary, q binary, scale float, lost float")
    # roles: 0 base, 1 prober, 2 both; where an axis has several blocks each row meets all blocks of the other role
    if (most or 0) <= 16 * BLOCK:
        dealt = dealt.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("own"), 2).otherwise(1).alias("role"))
    else:
        hot = counted.where(F.col("m") > 16 * BLOCK).select(*keys, F.ceil(F.col("m") / (16 * BLOCK)).cast("int").alias("nb"))
        dealt = dealt.join(hot, keys, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        at, every = F.pmod(F.xxhash64("id"), "nb").cast("int"), F.sequence(F.lit(0), F.col("nb") - 1)
        base = F.when(F.col("own"), F.transform(every, lambda k: F.struct(at.alias("i"), k.alias("j"), F.lit(0).alias("role")))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))
        places = F.concat(base, F.transform(every, lambda k: F.struct(k.alias("i"), at.alias("j"), F.lit(1).alias("role"))))
        dealt = dealt.withColumn("place", F.explode(places)).select(*[c for c in dealt.columns if c != "nb"], "place.*")
    group = F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(max(1, round((total or 0) / 5_000)))).alias("g")
    return dealt.drop("own").groupBy(group).applyInArrow(_candidates(threshold), "u long, v long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.93) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    Two vectors are linked when their labels are equal and not null and their cosine,
    in double precision, is at least `threshold`.  n_links counts the other vectors
    linked directly; component_id is the smallest id reachable.

    A pair is a candidate if one of the two probes the other's bucket in some table; at a
    cosine of 0.93 in 64 dimensions all eight tables miss a pair with a chance of 4e-6.
    Buckets get each vector as bytes, with a bound of the rounding, so that no pair is
    lost there; what leaves them is a spanning forest of the pairs that may reach the
    threshold.  Whole vectors go to their component of candidates alone, where all pairs
    are compared in double precision, by blocks of at most BLOCK rows or so; what leaves
    a block is a count per vector and a spanning forest, never its pairs.
    Equal vectors of a label (by a 128-bit hash) are one class and are compared as
    one; each of them links with the others.

    Vectors that are null, empty or zero, or hold null or non-finite components, and
    those without a label or an id, are linked with nothing; a null id has a null
    component and is kept.  Vectors of different lengths are not compared.  Rows that
    repeat an id are one vector, the one with the smallest hash.  An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = dict(vectors.dtypes)[id_col]
    source = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label_col else F.lit(0)).alias("label"), F.col(vector_col).alias("e"))
    one = source.where("id is not null and label is not null and e is not null")
    digest = F.xxhash64("label", F.col("e").cast("array<double>"))
    if not scratch.put("twice", one.groupBy("id").count().where("count > 1")).isEmpty():
        one = scratch.put("one", one.groupBy("id").agg(F.min_by(F.struct("label", "e"), digest).alias("s")).select("id", "s.label", "s.e"))
    one = one.select("id", F.col("label").cast("string").alias("label"), "e")
    # equal vectors of a label are one class, which goes by its smallest id
    same = ["label", "dim", "h"]
    hashed = scratch.put("hashed", one.withColumn("e", F.col("e").cast("array<double>")).mapInArrow(_hasher, "id long, label string, dim int, h binary"))
    groups = hashed.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.put("classes", hashed.join(groups, same).select("id", "rep", "n"))
    chosen = one.join(classes.where("id = rep").select("id", "n"), "id").select("id", "label", F.col("e").cast("array<double>").alias("e"), "n")
    reps = scratch.put("reps", chosen.mapInArrow(_coder, "id long, label string, n long, dim int, x binary, codes binary"))
    scratch.drop("hashed", "one")
    # candidates, some tables at a time: what is dealt out at once stays below twice the input
    step = TABLES if reps.count() <= AT_ONCE else max(1, TABLES // 4)
    maybe = None
    for t in range(0, TABLES, step):
        edges = scratch.put(f"maybe-{t}", _search(reps, range(t, min(TABLES, t + step)), threshold, scratch))
        maybe = edges if maybe is None else maybe.unionAll(edges)
    near = connected_components(maybe, scratch, "near", local=LOCAL)
    sizes = near.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    # a component of several blocks: each block meets each
    held = reps.join(near.join(sizes, "component").withColumnRenamed("node", "id"), "id").withColumn("block", F.pmod(F.xxhash64("id"), "nb").cast("int"))
    held = held.select("id", "n", "dim", "x", "component", "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k"))
    held = held.select("id", "n", "dim", "x", "component", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    tasks = near.groupBy("component").count().select(F.sum(F.col("count") * F.ceil(F.col("count") / BLOCK))).first()[0] or 0
    group = F.pmod(F.xxhash64("component", "i", "j"), F.lit(max(1, round(tasks / 20_000)))).alias("g")
    found = scratch.put("found", held.groupBy(group).applyInArrow(_verifier(threshold), "u long, v long, n long"))
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("v is not null").select("u", "v"), scratch, "links", local=LOCAL)
    linked = classes.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = source.select("id").join(linked, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast(kind).alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
