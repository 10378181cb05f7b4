"""Licence scans on copies in a row and against brute force."""

import re

import numpy as np
import pytest

from brightwater.llm import licenses


def rows(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.license, r.matched, r.start_word, r.end_word, r.start, r.end) for r in licenses.scan_licenses(docs).collect())


@pytest.mark.parametrize("name", ["MIT-notice", "CC-BY-NC-4.0-notice", "Apache-2.0-notice"])
def test_copies_in_a_row(spark, name):
    notice = licenses.TEMPLATES[name]
    size = len(re.findall("[A-Za-z0-9]+", notice))
    for copies, between in ((2, ""), (3, ""), (2, "and so "), (9, "")):
        text = f"{notice} {between}" * copies
        step, far = size + len(between.split()), len(notice) + 1 + len(between)
        want = [(0, name, size, k * step, k * step + size, k * far, k * far + len(notice.rstrip("."))) for k in range(copies)]
        assert rows(spark, text) == want


def test_reworded_and_stretched_notices(spark):
    assert [r[1:3] for r in rows(spark, "Released under an MIT License.")] == [("MIT-notice", 4)]
    for name in ("Apache-2.0-notice", "CC-BY-NC-4.0-notice", "ISC"):
        words = re.findall("[A-Za-z0-9]+", licenses.TEMPLATES[name])
        texts = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(len(words))]
        assert [r[:3] for r in rows(spark, *texts)] == [(k, name, len(words) - 1) for k in range(len(words))]
    words = re.findall("[A-Za-z0-9]+", licenses.TEMPLATES["BSD-3-Clause"])
    texts = [" ".join([*words[:40], *["inserted"] * n, *words[40:]]) for n in (12, 40)]
    assert [r[1:5] for r in rows(spark, *texts)] == [("BSD-3-Clause", len(words), 0, len(words) + n) for n in (12, 40)]


def best_ends(template, text):
    """(last + 1, score, matched, first) of the best alignment at each end, over the whole table."""
    table = [(0, 0, -1)] * (len(text) + 1)
    best = {}
    for i, w in enumerate(template):
        new = [(table[0][0] - 1, 0, -1)]
        for j, x in enumerate(text):
            ways = [(s - 1, c, f) for s, c, f in (table[j], table[j + 1], new[j])]
            if x == w:
                s, c, f = table[j]
                ways.append((s + 2, c + 1, f if c else j))
                at_end = (s + 2 - (len(template) - 1 - i), *ways[-1][1:])
                best[j + 1] = max(best.get(j + 1, at_end), at_end)
            new.append(max(ways))
        table = new
    return [(j, *v) for j, v in best.items()]


def brute(templates, text):
    found, stretches = [], [(0, len(text))]
    while stretches:
        later = []
        for low, high in stretches:
            every = []
            for t, (name, template) in enumerate(templates.items()):
                for last, score, matched, first in best_ends(template, text[low:high]):
                    if matched >= 0.8 * len(template):
                        every.append((-matched, -matched / len(template), -score, t, low + first, low + last, name))
            kept = []
            for m in sorted(every):
                if all(m[5] <= k[4] or m[4] >= k[5] for k in kept):
                    kept.append(m)
            found += [(m[6], -m[0], m[4], m[5]) for m in kept]
            bounds = [low, *sorted(x for m in kept for x in m[4:6]), high]
            later += [(a, b) for a, b in zip(bounds[::2], bounds[1::2], strict=True) if kept and a < b]
        stretches = later
    return sorted(found)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    long = [f"t{k}" for k in rng.integers(0, 15, 30)]
    templates = {"four": "a b c d".split(), "five": "a c e b f".split(), "seven": "d d e f g a b".split(), "long": long}
    texts = []
    for _ in range(300):
        text = []
        for _ in range(int(rng.integers(1, 6))):
            for w in [*templates.values()][int(rng.integers(0, 4))]:
                chance = rng.random()
                text += [] if chance < 0.06 else ["x"] if chance < 0.12 else [w, *["y"] * int(rng.integers(1, 9))] if chance < 0.18 else [w]
            text += list(rng.choice(list("abcdefgxy"), int(rng.integers(0, 12))))
        texts.append(text)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in licenses.scan_licenses(docs, templates={n: " ".join(t) for n, t in templates.items()}).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.matched, r.start_word, r.end_word))
    assert sum(map(len, got.values())) > 300
    for k, text in enumerate(texts):
        assert sorted(got.get(k, [])) == brute(templates, text), " ".join(text)
