"""Incremental substring deduplication over a log-structured fingerprint index.

The index holds immutable runs of historical window fingerprints: for each
bucket (the leading bits of the fingerprint) a sorted, delta-coded array without
repeats, and the batch that each came from first.  Documents pass through it in
generations of rising ids, and a generation is dealt into batches of consecutive
ids.  Each batch sends its distinct windows once to each bucket; the bucket
merge-joins them with the runs and with each other.  Runs of one tier are
compacted by merging.

A fingerprint that is found is only a candidate.  The bucket asks the batch that
had it first, which sends the words of its windows to the batches that found
them; those compare word by word, and only equal words are removed.  Windows
whose fingerprint another window shares are judged once more by their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, release
from .textkernel import Words, buffers, exact_runs, lean, lean_group, slices

#: A null id sorts after all others; such rows are held against everything but each other.
_NO_ID = np.iinfo(np.int64).max
#: Rows that are looked at for each batch when batches are laid out, and fingerprints that are judged again at once.
SAMPLE, AGAIN = 64, 1 << 20


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned numbers in the fewest bytes that hold them; the high bytes, mostly zeros, stand together."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return wide.view("<u8").reshape(-1)


def pack(hashes: np.ndarray, beside: np.ndarray | None = None) -> bytes:
    """Sorted fingerprints as deltas, and a number beside each."""
    if not len(hashes):
        return b""
    width, deltas = _planes(np.diff(hashes))
    wide, numbers = _planes(beside) if beside is not None else (0, b"")
    return np.array([len(hashes), width, wide, hashes[0]], "<u8").tobytes() + deltas + numbers


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not raw:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n, width, wide, first = (int(x) for x in np.frombuffer(raw, "<u8", 4))
    deltas = np.empty(n, np.uint64)
    deltas[0] = first
    deltas[1:] = _unplaned(raw, 32, n - 1, width)
    beside = _unplaned(raw, 32 + (n - 1) * width, n, wide).astype(np.int64) if wide else np.empty(0, np.int64)
    return np.cumsum(deltas, dtype=np.uint64), beside


class Batches:
    """Ranges of ids, cut by bytes; an id that fills several batches is dealt among them by its texts.

    Laid out from SAMPLE rows a batch or so, which the driver holds; any layout gives the same result.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, batches: int):
        order = np.argsort(ids, kind="stable")
        ids, total = ids[order], np.cumsum(sizes[order])
        cuts = ids[np.searchsorted(total, total[-1] / batches * np.arange(1, batches))] if len(ids) and total[-1] else ids[:0]
        values, often = np.unique(cuts, return_counts=True)
        starts, dealt = [np.iinfo(np.int64).min], [1]
        for value, n in zip(values.tolist(), often.tolist(), strict=True):
            if starts[-1] != value:
                starts.append(value), dealt.append(n)
            else:
                dealt[-1] = n
            if n > 1 and value < _NO_ID:
                starts.append(value + 1), dealt.append(1)
        self.starts, self.dealt = np.array(starts), np.array(dealt)
        self.first = np.cumsum(self.dealt) - self.dealt
        self.count = int(self.dealt.sum())

    def of(self, ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, ids, "right") - 1
        return self.first[segment] + np.mod(texts, self.dealt[segment])

    def ids(self, low: int, high: int) -> tuple[int, int]:
        """The smallest and the largest id that batches low .. high - 1 may have."""
        a, b = np.searchsorted(self.first, [low, high - 1], "right") - 1
        return int(self.starts[a]), int(self.starts[b + 1] - 1) if b + 1 < len(self.starts) else _NO_ID


class _Docs:
    """A batch's texts in order of id, their words and windows."""

    def __init__(self, table: pa.Table, window: int, mask: np.uint64):
        ids, texts = table["id"].to_numpy(), table["th"].to_numpy()
        order = np.lexsort((texts, ids))
        self.ids, self.th = ids[order], texts[order]
        text = table["text"].combine_chunks().take(pa.array(order))
        self.data, self.offsets = buffers(text)
        self.words = Words(self.data, self.offsets)
        self.hashes, self.at = self.words.grams(window)
        self.hashes &= mask
        self.doc = self.words.doc[self.at]


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings equal values together, and where a new one begins in it."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    return order, new


_SENT = "bucket long, batch long, payload binary"


def _sender(window: int, mask: np.uint64, bits: int):
    """A batch's distinct windows for each bucket."""

    @lean_group
    def send(key: tuple, table: pa.Table) -> pa.Table:
        hashes = np.unique(_Docs(table, window, mask).hashes)
        cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cuts) > 0)
        rows = [pack(hashes[cuts[b] : cuts[b + 1]]) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int64()), "batch": pa.array([key[0].as_py()] * len(full), pa.int64()), "payload": pa.array(rows, pa.binary())})

    return send


@lean_group
def _merge(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
    """One bucket: what each owner is asked for (batch, fingerprints and askers), and the run to add (batch null)."""
    bucket = key[0].as_py()
    batches = new["batch"].to_numpy() if new.num_rows else np.empty(0, np.int64)
    rank = np.argsort(batches, kind="stable")
    parts = [unpack(new["payload"][int(i)].as_py())[0] for i in rank]
    hashes = np.concatenate([np.empty(0, np.uint64), *parts])
    asker = np.repeat(batches[rank], [len(p) for p in parts])
    del parts
    order, first = _groups(hashes)
    hashes, asker = hashes[order], asker[order]
    known, owner = hashes[first], asker[first]
    fresh = np.ones(len(known), bool)
    for i in range(old.num_rows):
        run, owners = unpack(old["payload"][i].as_py())
        at = np.searchsorted(run, known)
        at[at == len(run)] = 0
        hit = run[at] == known if len(run) else np.zeros(len(known), bool)
        owner = np.where(hit, owners[at] if len(run) else 0, owner)
        fresh &= ~hit
    whose = owner[np.cumsum(first) - 1]
    asked = np.flatnonzero(whose != asker)
    asked = asked[np.argsort(whose[asked], kind="stable")]
    cuts = np.append(np.flatnonzero(np.diff(whose[asked], prepend=-1)), len(asked))
    rows = [(bucket, int(whose[asked[a]]), pack(hashes[asked[a:b]], asker[asked[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if fresh.any():
        rows.append((bucket, None, pack(known[fresh], owner[fresh])))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


@lean_group
def _compact(key: tuple, runs: pa.Table) -> pa.Table:
    """Runs of one bucket, which share no window, as one."""
    parts = [unpack(runs["payload"][i].as_py()) for i in range(runs.num_rows)]
    hashes, owners = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(hashes)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "batch": pa.array([None], pa.int64()), "payload": pa.array([pack(hashes[order], owners[order])], pa.binary())})


def _witness(window: int, mask: np.uint64):
    """The words that a batch's first windows stand for, to those that ask: (asker, id, text), a row for each run of windows."""

    @lean_group
    def tell(key: tuple, docs: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if asks.num_rows and docs.num_rows:
            held = _Docs(docs, window, mask)
            order, new = _groups(held.hashes)
            known, place = held.hashes[order][new], order[new]
            parts = [unpack(p.as_py()) for p in asks["payload"]]
            wanted, asker = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            at = place[np.searchsorted(known, wanted)]
            order = np.lexsort((at, asker))
            at, asker = at[order], asker[order]
            word, doc = held.at[at], held.doc[at]
            cut = np.ones(len(at) + 1, bool)
            cut[1:-1] = (np.diff(word) != 1) | (np.diff(doc) != 0) | (np.diff(asker) != 0)
            edge, raw = np.flatnonzero(cut), held.data.tobytes()
            for a, b in zip(edge[:-1].tolist(), (edge[1:] - 1).tolist(), strict=True):
                out.append((int(asker[a]), int(held.ids[doc[a]]), raw[held.words.start[word[a]] : held.words.end[word[b] + window - 1]]))
        return pa.table({"asker": pa.array([r[0] for r in out], pa.int64()), "id": pa.array([r[1] for r in out], pa.int64()), "text": pa.array([r[2] for r in out], pa.binary()).cast(pa.string())})

    return tell


def _same(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, window: int) -> np.ndarray:
    """Whether the words a[i], a[i + 1] and on are b[j], b[j + 1] and on."""
    same = np.ones(len(i), bool)
    for k in range(window):
        same &= a[i + k] == b[j + k]
    return same


_JUDGED = "id long, th long, starts array<long>, again long"


def _judge(window: int, mask: np.uint64):
    """A batch's windows to remove, by text (word numbers in starts), and fingerprints to judge again."""

    @lean_group
    def judge(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        held = _Docs(docs, window, mask)
        other = Words(*buffers(told["text"])) if told.num_rows else Words(np.empty(0, np.uint8), np.zeros(1, np.int64))
        own_number, other_number = held.words.numbers(other)
        drop, again = np.zeros(len(held.at), bool), np.empty(0, np.uint64)
        # an earlier text of this batch
        order, new = _groups(held.hashes)
        group = np.cumsum(new) - 1
        more = np.flatnonzero(~new)
        if len(more) and not _same(own_number, held.at[order[more]], own_number, held.at[order[new][group[more]]], window).all():
            order, new = _groups(exact_runs(own_number, window)[held.at])
            group = np.cumsum(new) - 1
        drop[order] = held.ids[held.doc[order]] > held.ids[held.doc[order[new][group]]] if len(order) else False
        # an earlier batch
        if told.num_rows:
            ids = told["id"].to_numpy()
            known, at = other.grams(window)
            known &= mask
            place = np.argsort(known, kind="stable")
            known, at = known[place], at[place]
            slot = np.searchsorted(known, held.hashes)
            slot[slot == len(known)] = 0
            hit = np.flatnonzero(known[slot] == held.hashes) if len(known) else np.empty(0, np.int64)
            slot = slot[hit]
            same = _same(own_number, held.at[hit], other_number, at[slot], window)
            drop[hit[same]] |= held.ids[held.doc[hit[same]]] > ids[other.doc[at[slot[same]]]]
            again = np.unique(held.hashes[hit[~same]])
        rows = np.flatnonzero(drop)
        texts, first = np.unique(held.doc[rows], return_index=True)
        starts = np.split(held.at[rows] - held.words.first[held.doc[rows]], first[1:]) if len(rows) else []
        n, m = len(texts), len(again)
        return pa.table(
            {
                "id": pa.array([*held.ids[texts].tolist(), *[None] * m], pa.int64()),
                "th": pa.array([*held.th[texts].tolist(), *[None] * m], pa.int64()),
                "starts": pa.array([*starts, *[None] * m], pa.list_(pa.int64())),
                "again": pa.array([*[None] * n, *again.view(np.int64).tolist()], pa.int64()),
            }
        )

    return judge


def _windows_of(window: int, mask: np.uint64, wanted):
    """(id, th, start, words) of the windows that have one of some fingerprints."""

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                data, offsets = buffers(batch.column(2).slice(a, b - a))
                words = Words(data, offsets)
                hashes, at = words.grams(window)
                at = at[np.isin((hashes & mask).view(np.int64), wanted.value)]
                raw = data.tobytes()
                joined = [b" ".join(raw[s:e] for s, e in zip(words.start[i : i + window], words.end[i : i + window], strict=True)) for i in at]
                rows = pa.array(words.doc[at] + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - words.first[words.doc[at]]), pa.array(joined, pa.binary())], names=["id", "th", "start", "words"])

    return find


def _cutter(window: int, n_held: int):
    """Texts without the words that their windows cover."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, offsets = buffers(part.column(1))
                words = Words(data, offsets)
                lists = part.column(2)
                counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                at = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(words.first[:-1], counts)
                mark = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                covered = np.cumsum(mark[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(covered)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                raw, out, spans = data.tobytes(), [], []
                for i in range(len(removed)):
                    low, high = int(offsets[i]), int(offsets[i + 1])
                    if not removed[i]:
                        out.append(raw[low:high]), spans.append([])
                        continue
                    first = words.first[i]
                    edge = np.diff(np.concatenate([[0], covered[first : words.first[i + 1]].astype(np.int8), [0]]))
                    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    pieces, at_byte = [], low
                    for s, e in zip(starts, ends, strict=True):
                        # a word goes with the separators before it
                        pieces.append(raw[at_byte : int(words.end[first + s - 1]) if s else low])
                        at_byte = int(words.end[first + e - 1])
                    out.append(b"".join([*pieces, raw[at_byte:high]]))
                    spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(starts, ends, strict=True)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                columns = [part.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), pa.array(spans, kind), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "text", "spans", *[f"_k{k}" for k in range(n_held)]])

    return cut


class FingerprintIndex:
    """Runs of window fingerprints in a folder; generations are added in order of id.

    bits: buckets are 2**bits; choose so that a bucket of all windows fits a task's
    memory.  fingerprint_bits: fewer only make more candidates, never another result.
    """

    FAN_IN = 2

    def __init__(self, spark: SparkSession, window: int = 13, bits: int = 6, fingerprint_bits: int = 64):
        self.scratch = Scratch(spark, "substring")
        self.spark, self.window, self.bits = spark, window, bits
        self.mask = np.uint64((1 << 64) - (1 << (64 - fingerprint_bits)))
        self.runs: list[tuple[int, str]] = []  # (tier, table)
        self.asked: list[str] = []
        self.generation = self.compactions = 0

    def _table(self, names: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], _SENT)
        for name in names:
            rows = rows.unionAll(self.scratch.get(name, rows))
        return rows

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Merge-join a generation (id, th, text, batch) with the runs and itself; last: the runs need not take it in."""
        if not last:
            self.compact()
        g = self.generation = self.generation + 1
        sent = docs.select("id", "th", "text", "batch").groupBy("batch").applyInArrow(_sender(self.window, self.mask, self.bits), _SENT)
        history = self._table([name for _, name in self.runs])
        merged = sent.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(_merge, _SENT)
        if last:
            merged = merged.where("batch is not null")
        self.scratch.put(f"merged-{g}", merged.withColumn("kind", F.when(F.col("batch").isNull(), "run").otherwise("ask")), ["kind"])
        release(self.spark)
        if self.scratch.has(f"merged-{g}/kind=run"):  # not where no window was new
            self.runs.append((0, f"merged-{g}/kind=run"))
        if self.scratch.has(f"merged-{g}/kind=ask"):
            self.asked.append(f"merged-{g}/kind=ask")

    def compact(self) -> None:
        """Merge the newest runs while FAN_IN of them are of one tier."""
        while len(self.runs) >= self.FAN_IN and len({tier for tier, _ in self.runs[-self.FAN_IN :]}) == 1:
            tier, old = self.runs[-1][0], [name for _, name in self.runs[-self.FAN_IN :]]
            name = f"run-{self.generation}-{tier + 1}"
            self.scratch.put(name, self._table(old).groupBy("bucket").applyInArrow(_compact, _SENT))
            self.runs[-self.FAN_IN :] = [(tier + 1, name)]
            self.compactions += 1
            self.scratch.drop(*old)
            release(self.spark)

    def removals(self, docs: DataFrame) -> DataFrame:
        """(id, th, starts): the windows that an earlier text has word by word, of all documents added (docs: all of them).

        The runs are given up.
        """
        self.scratch.drop(*[name for _, name in self.runs])
        self.runs = []
        held = docs.select("id", "th", "text", "batch").groupBy("batch")
        asks = self._table(self.asked).select("batch", "payload")
        told = held.cogroup(asks.groupBy("batch")).applyInArrow(_witness(self.window, self.mask), "asker long, id long, text string")
        told = self.scratch.put("told", told)
        self.scratch.drop(*self.asked)
        release(self.spark)
        judged = self.scratch.put("judged", held.cogroup(told.groupBy("asker")).applyInArrow(_judge(self.window, self.mask), _JUDGED))
        self.scratch.drop("told")
        release(self.spark)
        found = judged.where("again is null").select("id", "th", "starts")
        again = judged.where("again is not null").select("again").distinct()
        n = again.count()
        if not n:
            return found.dropDuplicates(["id", "th"])
        parts = [found]
        for k in range(math.ceil(n / AGAIN)):
            # AGAIN fingerprints or so at once
            some = again.where(F.pmod(F.xxhash64("again"), F.lit(math.ceil(n / AGAIN))) == k).toPandas()["again"].to_numpy(np.int64)
            shared = self.spark.sparkContext.broadcast(some)
            windows = self.scratch.put(f"again-{k}", docs.select("id", "th", "text").mapInArrow(_windows_of(self.window, self.mask, shared), "id long, th long, start long, words binary"))
            least = windows.groupBy("words").agg(F.min("id").alias("least"))
            late = windows.join(least, "words").where(F.col("id") > F.col("least"))
            parts.append(late.select("id", "th", F.array("start").alias("starts")))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionAll(part)
        return every.select("id", "th", F.explode("starts").alias("s")).groupBy("id", "th").agg(F.collect_set("s").alias("starts"))


def _batched(layout: Batches) -> Column:
    """A row's batch: its segment by two short searches, then its place in the segment."""

    def constant(values: list, kind: str) -> Column:
        return F.from_json(F.lit(str(values)), kind)

    starts = layout.starts.tolist()
    width = math.ceil(math.sqrt(len(starts)))
    chunks = [starts[k : k + width] for k in range(0, len(starts), width)]
    upto = lambda array: F.size(F.filter(array, lambda s: s <= F.col("id"))) - 1
    chunk = upto(constant([c[0] for c in chunks], "array<bigint>"))
    segment = chunk * width + upto(F.get(constant(chunks, "array<array<bigint>>"), chunk))
    dealt = F.get(constant(layout.dealt.tolist(), "array<bigint>"), segment)
    return F.get(constant(layout.first.tolist(), "array<bigint>"), segment) + F.pmod("th", dealt)


def batch_size(total: int, least: int) -> int:
    """Bytes of a batch: `least`, and more as the square root of the input, so that messages to buckets do not shrink to nothing; 256 MB at most."""
    return int(min(1 << 28, max(least, 40 * math.sqrt(total))))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, generations: int = 4, batch_bytes: int = 8 << 20, bucket_windows: int = 1 << 20, keep: tuple[str, ...] = (), fingerprint_bits: int = 64) -> DataFrame:
    """One row per input row: (id, n_words, n_removed, text, spans, *keep).

    keep: columns of the input to pass through.
    Words are runs of bytes other than 0x20 and 0x09-0x0D.  A word is removed when
    a window of `window` words that covers it also starts in a document with a
    smaller id.  text is the input without the removed words (and the separators
    before each); spans are the runs removed, in words.

    The table passes through the index in `generations` parts by id, whatever its
    size; the source is read once for these and three times whole: for the words
    that owners send, the comparison, and the cut.  Fingerprints only pick
    candidates: words are compared before any is removed.

    Null text is empty; a null id counts as larger than every other and equal to
    other null ids; rows with one id remove nothing from each other, and those with
    one text too have one result.  Tables without rows give none.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    held = [f"_k{i}" for i in range(len(keep))]
    whole = source.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    size = whole["b"] or 0
    wanted = max(generations, math.ceil(size / batch_size(size, batch_bytes)))
    some = source.sample(min(1.0, SAMPLE * wanted / max(1, whole["n"])), 1).select("id", F.octet_length("text").alias("b")).toPandas()
    layout = Batches(some["id"].to_numpy(np.int64), some["b"].to_numpy(np.int64), wanted)
    batched = source.withColumn("batch", _batched(layout))
    # a word takes six bytes or so; a bucket gets the windows of all generations
    index = FingerprintIndex(spark, window, max(3, math.ceil(math.log2(max(1, size / 6 / bucket_windows)))), fingerprint_bits)
    cuts = [layout.count * g // generations for g in range(generations + 1)]
    for g, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if low < high:
            a, b = layout.ids(low, high)
            index.add(batched.where(F.col("id").between(a, b)).where(F.col("batch").between(low, high - 1)), last=g == generations - 1)
    gone = index.removals(batched)
    joined = source.join(gone.hint("shuffle_hash"), ["id", "th"], "left").select("own", "text", "starts", *held)
    shape = T.StructType.fromDDL(f"id {kind}, n_words long, n_removed long, text string, spans array<struct<start:long,length:long>>")
    for c in held:
        shape = shape.add(c, joined.schema[c].dataType)
    out = joined.mapInArrow(_cutter(window, len(held)), shape)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "text", "spans", *[F.col(c).alias(name) for c, name in zip(held, keep, strict=True)])
