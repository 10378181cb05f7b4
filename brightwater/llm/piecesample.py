"""Sampled SentencePiece segmentations by forward filtering, backward sampling; lossless decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textkernel import lean, mix, slices

#: Segments that no piece crosses: spaces go with the word after them.
_SEGMENT = re.compile(r" *[^ \n]+| +|\n")


def piece_weights(vocabulary, theta: float) -> np.ndarray:
    """Unnormalised piece weights: a merge's score is minus its rank, and weight falls with rank as Zipf's law has it.

    theta sharpens (above 1) or flattens the choice.  The fallback to bytes weighs
    less than any piece.
    """
    rank = 2.0 - np.minimum(vocabulary.scores, 0)
    rank = np.minimum(rank, vocabulary.total)  # pieces without a rank of their own
    weight = (1.0 / rank) ** theta
    return np.append(weight, weight.min() * 0.1)[:, None] / weight.sum()


def _uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in [0, 1) that depends on the row's seed and the place in its text only."""
    value = mix(seed ^ mix(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return (value >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of characters end to end, and how many each has."""
    raw = np.frombuffer("".join(map(chr, codes.tolist())).encode(), np.uint8)
    return raw, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


class Sampler:
    """Lattices of segments, kept from slice to slice, and draws from them.

    Chances are held per node, so a draw never depends on what else is kept.
    """

    #: Edges that are kept; beyond them all are dropped before the next slice.
    LIMIT = 1_000_000
    #: Segments that go on together; when no more are left, each goes by itself.
    FEW = 8

    def __init__(self, vocabulary, weight: np.ndarray):
        self.vocabulary, self.weight = vocabulary, weight
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        none = np.empty(0, np.int32)
        #: By segment: the number of its first node, and its characters.
        self.root, self.size = none, none
        #: By node: its first edge (of those that end in it).
        self.first = none
        #: By edge: chances up to and with it, the node it starts from, its piece, its first character.
        self.ladder, self.start, self.piece, self.code = np.empty(0), none, none, none.astype(np.uint32)

    def _add(self, fresh: list[str]) -> None:
        from .lattice import word_codes

        lattice = self.vocabulary.lattice(*word_codes(fresh))
        _, share = lattice.forward(self.weight, shares=True)
        new = np.flatnonzero(np.concatenate([[True], lattice.end[1:] != lattice.end[:-1]]))
        size = np.diff(np.append(new, len(share)))
        ladder = share
        for k in range(1, int(size.max())):
            at = new[size > k] + k
            ladder[at] += ladder[at - 1]
        ladder[new + size - 1] = 1.0
        nodes = len(self.first)
        first = np.full(int(lattice.lengths.sum()) + len(fresh), -1, np.int32)
        first[lattice.end[new]] = new + len(self.ladder)
        self.index.update(zip(fresh, range(len(self.root), len(self.root) + len(fresh)), strict=True))

        def more(held: np.ndarray, added: np.ndarray) -> np.ndarray:
            return np.concatenate([held, added.astype(held.dtype)])

        self.root = more(self.root, lattice.first + np.arange(len(fresh)) + nodes)
        self.size = more(self.size, lattice.lengths)
        self.first = more(self.first, first)
        self.ladder = more(self.ladder, ladder)
        self.start = more(self.start, lattice.start + nodes)
        self.piece = more(self.piece, lattice.piece)
        self.code = more(self.code, lattice.codes[lattice.start_char])

    def _path(self, node: int, root: int, seed: np.uint64, place: int) -> list[int]:
        """Edges back from a node to its segment's first one, in time linear in the segment."""
        first, u = self.first[root : node + 1].tolist(), _uniform(np.full(node - root + 1, seed), place + np.arange(node - root + 1)).tolist()
        ladder, start, path, at = self.ladder, self.start, [], node - root
        while at > 0:
            edge, draw = first[at], u[at]
            while draw >= ladder[edge]:
                edge += 1
            path.append(edge)
            at = int(start[edge]) - root
        return path

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each."""
        from .lattice import LITERAL, SPACE

        segments = [_SEGMENT.findall(t) for t in texts]
        held = np.fromiter(map(len, segments), np.int64, len(texts))
        if not held.any():
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        coded = pa.array(chain.from_iterable(segments), pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.ladder) > self.LIMIT:
            self._clear()
        if fresh := [s for s in distinct if s not in self.index]:
            self._add(fresh)
        which = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(texts)), held)
        sizes, root = self.size[which].astype(np.int64), self.root[which]
        place = np.cumsum(sizes) - sizes  # of each occurrence, in characters of its text
        at = np.cumsum(held) - held
        place -= np.repeat(place[at.clip(max=len(doc) - 1)], held)
        seed = seeds[doc]
        node, active = root + sizes, np.arange(len(which))
        taken, owner = [], []
        while len(active) > self.FEW:
            here = node[active]
            edge, u = self.first[here], _uniform(seed[active], place[active] + here - root[active])
            higher = np.flatnonzero(u >= self.ladder[edge])
            while len(higher):
                edge[higher] += 1
                higher = higher[u[higher] >= self.ladder[edge[higher]]]
            taken.append(edge), owner.append(active)
            node[active] = here = self.start[edge]
            active = active[here > root[active]]
        # the few that are left may be long: each by itself
        rest = [(s, self._path(int(node[s]), int(root[s]), seed[s], int(place[s]))) for s in active.tolist()]
        # pieces come last first; each step has one for each segment that is not at its start
        count = np.zeros(len(which), np.int64)
        for own in owner:
            count[own] += 1
        done = {s: int(count[s]) for s, _ in rest}
        for s, path in rest:
            count[s] += len(path)
        end, edges = np.cumsum(count), np.empty(int(count.sum()), np.int64)
        for k, (edge, own) in enumerate(zip(taken, owner, strict=True)):
            edges[end[own] - 1 - k] = edge
        for s, path in rest:
            edges[end[s] - 1 - done[s] - np.arange(len(path))] = path
        piece, owners = self.piece[edges], np.repeat(doc, count)
        bytewise = piece == self.vocabulary.size
        ids = np.where(bytewise, 0, self.vocabulary.ids[np.minimum(piece, self.vocabulary.size - 1)])
        if bytewise.any():
            codes = self.code[edges[bytewise]].astype(np.int64)
            codes = np.where(codes == LITERAL, SPACE, np.where(codes == SPACE, 0x20, codes))
            raw, width = _utf8(codes)
            count = np.ones(len(ids), np.int64)
            count[bytewise] = width
            spread = np.repeat(bytewise, count)
            ids, owners = np.repeat(ids, count), np.repeat(owners, count)
            ids[spread] = self.vocabulary.byte_ids[raw]
        return ids, np.searchsorted(owners, np.arange(len(texts) + 1))


def _encoder(path: str, theta: float, seed: int, shown: list[int]):
    """shown: which input columns go on."""

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brightwater.llm import lattice

        vocabulary = lattice.vocabulary(path)
        sampler = Sampler(vocabulary, piece_weights(vocabulary, theta))
        for batch in batches:
            for a, b in slices(batch.column(1)):
                seeds = mix(batch.column(0).slice(a, b - a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed))
                texts = batch.column(1).slice(a, b - a)
                ids, bounds = sampler.sample(texts.fill_null("").to_pylist(), seeds)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                if texts.null_count:
                    lists = pc.if_else(texts.is_null(), pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in shown), lists], names=[*map(str, range(len(shown))), "ids"])

    return encode


def _decoder(path: str, column: int):
    @lean
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brightwater.llm import lattice

        vocabulary = lattice.vocabulary(path)
        table: list[bytes] = [b""] * vocabulary.total
        for i, piece in zip(vocabulary.ids.tolist(), vocabulary.pieces, strict=True):
            table[i] = piece.replace("▁", " ").encode()
        for value, i in enumerate(vocabulary.byte_ids.tolist()):
            table[i] = bytes([value])
        parts = pa.array(table, pa.binary())
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                ids = part.column(column)
                lists = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), parts.take(ids.flatten())) if not ids.null_count else pa.array([None if x is None else [table[i] for i in x] for x in ids.to_pylist()], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(lists, b"").cast(pa.string())], names=[*part.schema.names, "decoded"])

    return decode


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", theta: float = 1.0, seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (id, *keep, ids).

    A segmentation drawn from the distribution of the lattice's weights: forward
    sums, then pieces drawn backwards.  The draw depends on the row's id, `seed` and
    the place in the text only, never on partitions or other rows.  Characters that
    no piece has are their bytes' pieces, so decode() gives back every text.

    Null text: null ids; empty text: none.  A null id draws as id 0.  Rows with one
    id and text get one segmentation.  Whole texts, of any length.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)
    out = (id_col, *keep)
    shape = ", ".join(f"`{c}` {kind[c]}" for c in out)
    # the text goes to Python once, also where it is kept
    apart = [c for c in out if c != text_col]
    shown = [1 if c == text_col else 2 + apart.index(c) for c in out]
    source = docs.select(F.col(id_col).cast("long").alias("_k"), F.col(text_col).alias("_t"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(apart)])
    return source.mapInArrow(_encoder(model_path, theta, seed, shown), f"{shape}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The input's columns and `decoded`, the text of `ids` (null for null)."""
    ship(encoded.sparkSession)
    column = encoded.columns.index("ids")
    shape = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(_decoder(model_path, column), f"{shape}, decoded string")


def ids_text(ids: str) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")
