"""Best-fit-decreasing packing with certified bin counts.

Texts become token pieces of at most `capacity`; pieces are dealt evenly into
partitions by a hash and each is packed by best-fit decreasing.  Dual-feasible
functions give a lower bound on the bins of a partition: where it equals the
count, the packing is certified optimal.  Partitions with a gap, and the nearly
empty bins that each certified one ends with, exchange their documents: what
their unfilled bins hold is dealt anew and packed again, and the new packing
stands if it has fewer bins.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textkernel import lean, lean_group, slices

CAPACITY = 2048
#: Characters whose classes (letter, number, space, other) are the same in every Unicode version.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u2030-\u205e\u20ac\u2122]*")
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
_SPECIAL = "<|endoftext|>"
_CACHE = 300_000


class _Pieces(dict):
    """Ids of a split word, as bytes; found once."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class ByteTokenizer:
    """Ids of byte_bpe_50k.json as little-endian unsigned 32-bit bytes.

    Texts of plain characters are split here and their words encoded with the same
    vocabulary as ranks, which gives the same ids; any other text goes to the
    tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_path)
        self.words = _Pieces(encoding._encode_single_piece)

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and _SPECIAL not in text:
            return b"".join(map(self.words.__getitem__, _SPLIT.findall(text)))
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_tokenizers: dict[tuple[str, str], ByteTokenizer] = {}


def _tokenizer(paths: tuple[str, str]) -> ByteTokenizer:
    if paths not in _tokenizers:
        _tokenizers[paths] = ByteTokenizer(*paths)
    return _tokenizers[paths]


def _piece_maker(paths: tuple[str, str], capacity: int, with_ids: bool):
    @lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brightwater.llm import packing  # the worker's own module keeps the tokenizer between tasks

        encode = packing._tokenizer(paths)
        end = np.zeros(1, "<u4").tobytes()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                    tokens = memoryview(encode(text or "") + end)
                    total = len(tokens) // 4
                    at = 0
                    to = total % capacity or capacity
                    k = 0
                    while at < total:
                        part = tokens[4 * at : 4 * to]
                        row.append(i), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(np.frombuffer(part, "<i4"))
                        at, to, k = to, to + capacity, k + 1
                columns = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return make


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fills."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r left
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, largest_k: int = 24) -> int:
    """The best bound of two families of dual-feasible functions.

    One rounds items above capacity - e up to a whole bin and those below e down to
    nothing, for each e; the other is floor((k + 1) x) / k, and x itself where
    (k + 1) x is whole, for each k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(object)
    size = np.arange(capacity + 1, dtype=object)
    items, weight = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(weight[-1]) // capacity)
    for e in range(1, capacity // 2 + 1):
        total = (items[-1] - items[capacity - e]) * capacity + weight[capacity - e] - weight[e - 1]
        best = max(best, -(-int(total) // capacity))
    for k in range(1, largest_k + 1):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _packer(capacity: int, round_no: int):
    @lean_group
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        # in an order of its own, whatever order the rows came in
        order = np.lexsort((table["start"].to_numpy(), table["ids_crc32"].to_numpy(), table["id"].combine_chunks().fill_null(-1).to_numpy(), -lengths))
        lengths = lengths[order]
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        free = fills < capacity if len(fills) > bound else 2 * fills <= capacity
        n = len(lengths)
        return pa.table(
            {
                **{name: table[name].take(pa.array(order)) for name in ("id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": pa.array((round_no << 58) + (key[0].as_py() << 24) + bins),
                "offset": pa.array(offsets),
                "part_bins": pa.array(np.full(n, len(fills))),
                "part_bound": pa.array(np.full(n, bound)),
                "free": pa.array(free[bins]),
            }
        )

    return pack


_PIECE = "id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECE}, sequence_id long, offset long, part_bins long, part_bound long, free boolean"


def pack(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, part_pieces: int = 25_000, rounds: int = 4, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids, then id 0.  Only one longer than `capacity` is cut, into
    pieces of `capacity` and a first one that may be shorter.  offset is the place
    in the sequence, gapless from 0.  with_ids: the ids themselves, as a column.
    part_bins and part_bound tell the bins of the partition that placed a piece and
    the certified lower bound of its bins.

    Null and empty texts are one id, 0.  A null id is kept as null.  Repeated rows
    are packed each.  An empty table gives an empty result.  Other columns are not
    read.  A partition holds `part_pieces` pieces on average, whatever the input.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shape = _PIECE + (", ids array<int>" if with_ids else "")
    made = source.mapInArrow(_piece_maker((json_path, ranks_path), capacity, with_ids), shape)
    made = scratch.put("pieces", made)
    current = made.drop("ids")
    settled = None
    for r in range(rounds):
        # the first round packs all; each later one, what the unfilled bins of the last one hold
        pool = current.where("free") if r else current
        held = pool.agg(F.count("*").alias("n"), (F.countDistinct("sequence_id") if r else F.lit(0)).alias("bins")).first()
        if r and held["bins"] < 2:
            break
        parts = max(1, round(held["n"] / (part_pieces * 2**r)))  # wider with each exchange
        part = F.pmod(F.xxhash64(F.lit(r), "id", "piece", "ids_crc32"), F.lit(parts))
        dealt = pool.select("id", "piece", "start", "length", "ids_crc32", part.alias("part"))
        packed = scratch.put(f"round-{r}", dealt.groupBy("part").applyInArrow(_packer(capacity, r), _PLACED))
        if r:
            if packed.agg(F.countDistinct("sequence_id").alias("bins")).first()["bins"] >= held["bins"]:
                break  # the exchange gained nothing: the packing before it stands
            stays = current.where("not free")
            settled = stays if settled is None else settled.unionAll(stays)
        current = packed
    out = current if settled is None else settled.unionAll(current)
    out = out.drop("free")
    if with_ids:
        # crc and length go along, so that rows that repeat an id meet their own pieces
        key = ["id", "piece", "start", "length", "ids_crc32"]
        ids = made.groupBy(*key).agg(F.first("ids").alias("ids"))
        a, b = out.alias("a"), ids.alias("b")
        same = F.lit(True)
        for name in key:
            same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
        out = a.join(b, same).select("a.*", "b.ids")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
