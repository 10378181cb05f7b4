"""Substring dedup against brute force: generations, compaction, hot ids, colliding fingerprints and word hashes."""

import numpy as np
import pytest

from brightwater.llm import substring

def thue_morse(n):
    """A word of 2**n letters and its complement: sums of powers modulo 2**64 are equal from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


SCHEMA = "doc_id long, text string, batch string, id int, th int, own int, starts int, n_words int, spans int"
REST = ("batch", "id", "th", "own", "starts", "n_words", "spans")


def words(text):
    return (text or "").encode().split()


def brute(rows, window=13):
    """(id, words, removed, what stays) of each row, and the runs removed."""
    least, out = {}, []
    for i, text in rows:
        own = words(text)
        for k in range(len(own) - window + 1):
            at = tuple(own[k : k + window])
            least[at] = min(least.get(at, 1 << 62), 1 << 61 if i is None else i)
    for i, text in rows:
        own = words(text)
        drop = [False] * len(own)
        for k in range(len(own) - window + 1):
            if least[tuple(own[k : k + window])] < (1 << 61 if i is None else i):
                drop[k : k + window] = [True] * window
        out.append((str(i), len(own), sum(drop), b" ".join(w for w, d in zip(own, drop, strict=True) if not d)))
    return sorted(out)


def got(done):
    rows = done.collect()
    for r in rows:
        assert sum(s.length for s in r.spans) == r.n_removed
    return sorted((str(r.doc_id), r.n_words, r.n_removed, b" ".join(words(r.text))) for r in rows)


def corpus(seed, n=160):
    rng = np.random.default_rng(seed)
    passages = [[f"p{p}x{i}" for i in range(int(rng.integers(5, 60)))] for p in range(12)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(int(rng.integers(0, 6))):
            text += passages[int(rng.integers(0, 12)) if rng.random() < 0.6 else 0] if rng.random() < 0.5 else [f"w{x}" for x in rng.integers(0, 4, int(rng.integers(1, 30)))]
        # a third of the rows have one id, some none
        i = 40 if rng.random() < 0.33 else None if rng.random() < 0.1 else int(rng.integers(0, 100))
        rows.append((i, " ".join(text) if k % 9 else "\t".join(text) + "\n"))
    return rows + [(3, None), (4, ""), (5, " \n"), (101, " ".join(f"w{x}" for x in rng.integers(0, 3, 20_000)))]


@pytest.mark.parametrize(("seed", "bits", "generations"), [(1, 64, 4), (3, 9, 5)])
def test_brute_force(spark, seed, bits, generations):
    """With nine bits nearly every window shares its fingerprint with others."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "b", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)
    done = substring.substring_dedup(docs, batch_bytes=6000, generations=generations, fingerprint_bits=bits, keep=REST)
    want = brute(rows)
    plain = done.toDF("doc_id", "n_words", "n_removed", "text", "spans", *[f"x{k}" for k in range(len(REST))])
    assert got(plain) == want
    assert done.columns == ["doc_id", "n_words", "n_removed", "text", "spans", *REST] and sum(x[2] for x in want) > 500


def test_empty(spark):
    assert substring.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = spark.createDataFrame([(None, "a " * 40), (None, None)], "doc_id long, text string")
    assert got(substring.substring_dedup(alone)) == brute([(None, "a " * 40), (None, None)])


def test_unequal_words_stay(spark):
    """Words that a sum of powers takes for equal."""
    one, other = thue_morse(10)
    rows = [(1, " ".join([one] * 13)), (2, " ".join([other] * 13)), (3, " ".join([other] * 13))]
    assert [r[2] for r in got(substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=9000))] == [0, 0, 13]


def test_compaction(spark):
    index = substring.FingerprintIndex(spark, bits=3)
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(g, g, f"{passage} own{g} " + " ".join(f"g{g}x{k}" for k in range(20)), g) for g in range(6)]
    docs = spark.createDataFrame(rows, "id long, th long, text string, batch long")
    for g in range(6):
        index.add(docs.where(f"id = {g}"), last=g == 5)
    assert index.compactions == 3 and [tier for tier, _ in index.runs] == [2, 0]
    gone = {r.id: len(r.starts) for r in index.removals(docs).collect()}
    assert gone == dict.fromkeys(range(1, 6), 28)


def test_pack_format():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        hashes, owners = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64)), rng.integers(0, 70_000, n)
        a, b = substring.unpack(substring.pack(hashes, owners))
        assert np.array_equal(a, hashes) and np.array_equal(b, owners)


def test_layout():
    rng = np.random.default_rng(1)
    ids = np.sort(np.where(rng.random(4000) < 0.4, 7, rng.integers(0, 50, 4000)))
    layout = substring.Batches(ids, np.full(4000, 10), 25)
    texts = rng.integers(-(1 << 62), 1 << 62, 4000)
    batch = layout.of(ids, texts)
    assert batch.max() < layout.count and np.bincount(batch).max() < 500
    for low in range(layout.count):
        a, b = layout.ids(low, low + 1)
        own = ids[batch == low]
        assert ((own >= a) & (own <= b)).all()
    rank = np.searchsorted(layout.starts, ids, "right")
    assert (np.diff(rank) >= 0).all()
