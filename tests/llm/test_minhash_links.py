"""MinHash links against brute force: planted pairs from 0.6 to 1, unequal sets that a sum of powers takes for equal."""

import numpy as np
import pyarrow as pa

from brightwater.llm import textkernel
from brightwater.llm.minhash import linked, near_duplicates


def thue_morse(n):
    """A word of 2**n letters and its complement: sums of powers modulo 2**64 are equal from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def shingles(text, n=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def components(links, ids):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            for x in (a, b):
                changed |= root[x] != low
                root[x] = low
    return root


def test_planted_pairs(spark):
    numerator = 85
    rng = np.random.default_rng(numerator)
    rows = []
    for k in range(150):
        size = int(rng.integers(5, 400))
        own = [f"{k}x{i}" for i in range(size)]
        rows.append((10 * k, " ".join(own)))
        for c in range(1, 4):
            near = list(own)
            for place in rng.integers(0, size, int(rng.integers(0, 1 + size // 25))):
                near[place] = f"other{c}"
            rows.append((10 * k + c, " ".join(near).upper() if c == 2 else "  ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    near = [(i, j) for i, _ in rows for j in range(i + 1, i - i % 10 + 4) if j in sets]
    share = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in near}
    links = [(i, j) for i, j in near if 100 * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j])]
    assert sum(numerator <= 100 * s < 95 for s in share.values()) > 30 and sum(50 < 100 * s < numerator for s in share.values()) > 30
    want = components(links, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, numerator=numerator).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_unequal_words_stay_apart(spark):
    one, other = thue_morse(10)
    docs = spark.createDataFrame([(1, " ".join([one] * 13)), (2, " ".join([other] * 13))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()} == {(1, 1), (2, 2)}
    words = textkernel.Words(*textkernel.buffers(pa.array([f"{one} {other}", one[:200] + " " + other[:200]])))
    assert len(set(words.hash.tolist())) == len(set(words.second().tolist())) == 4


def test_hashes_do_not_decide(monkeypatch):
    """With word hashes that are all equal, pairs are still judged by their words."""
    monkeypatch.setattr(textkernel, "_hash_spans", lambda data, start, end, which: np.zeros(len(start), np.uint64))
    left = pa.array(["a b c d e f", "a b c d e f", "a b", "", None])
    right = pa.array(["A b c\td e f", "a b c d e g", "a c", "a", None])
    assert linked(left, right, 5, 50, 100).tolist() == [True, False, False, False, True]


def test_runs():
    numbers = np.random.default_rng(4).integers(0, 3, 400)
    for n in (1, 2, 3, 5, 7, 13):
        exact, hashed = textkernel.exact_runs(numbers, n), textkernel.gram_hashes(textkernel.mix(numbers.astype(np.uint64)), n)
        want = [tuple(numbers[i : i + n]) for i in range(len(numbers) - n + 1)]
        assert len(set(zip(exact.tolist(), want, strict=True))) == len(set(exact.tolist())) == len(set(want)) == len(set(hashed.tolist()))
