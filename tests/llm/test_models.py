"""Learned and sampled operators: packing against the tokenizer, held-out accuracy, edits and samples against enumeration."""

import itertools
import math
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brightwater.llm import langid, packing, piecesample, queries, toxicity

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_packing_against_tokenizer(spark):
    """Ids, pieces, starts and checksums of all documents, which pieces make up again; places without gaps."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10**6, "word " * 5000), (10**6 + 1, None), (10**6 + 2, "x"), (10**6 + 3, " y" * 2047), (10**6 + 4, " y" * 2048)]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = Tokenizer.from_file(paths[0]).encode
    rows = packing.pack(docs, *paths, part_pieces=100, with_ids=True).collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        ids = [x for r in own for x in r.ids]
        assert ids == [*encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in own] == list(itertools.accumulate([0, *(r.length for r in own)]))[:-1]
        assert len(own) == -(-len(ids) // 2048) and all(r.length == 2048 for r in own[1:])
    for pieces in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(pieces))]
        assert [at for at, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * total / 2048 + 2


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.col("text").alias("t"))
    got = queries.op4_langid(spark, SF).join(docs, "doc_id").where("held_out").collect()
    told = [r for r in got if r.lang_pred != "und" and r.lang is not None]
    assert len(told) > 150 and sum(r.lang_pred == r.lang for r in told) >= 0.97 * len(told)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.t or "")) for r in got)


def test_language_sample_is_bounded(spark):
    """A language with nearly all rows does not bring them all to one task, and a rare one is learned."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3000 == 0, "de").otherwise("en").alias("lang"), F.when(F.col("id") % 3000 == 0, "der und ist nicht ein").otherwise("the and of that with").alias("text"))
    model = langid.fit(rows.unionAll(rows.limit(0)), F.lit(True), MODEL, docs_per_language=50)
    assert model.langs == ["de", "en"]
    got = {r.text: r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "nicht und ein"), (2, "that of the")], "doc_id long, text string"), model, keep=("text",)).collect()}
    assert got == {"nicht und ein": "de", "that of the": "en"}


def test_margin_tells_languages_from_strings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, F.lit(True), MODEL)
    rows = docs.where("length(text) > 100").select("doc_id", F.translate("text", "0123456789", "").alias("text")).limit(200)
    letters = np.random.default_rng(3).choice(list("bcdfghjklmnpqrstvwxz"), (20, 12, 14))
    strings = [(10**6 + k, " ".join("".join(w) for w in words)) for k, words in enumerate(letters)]
    got = langid.identify(rows.unionAll(spark.createDataFrame(strings, rows.schema)), model, margin=True).collect()
    assert all((r.margin < -3) == (r.doc_id >= 10**6) for r in got)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic").distinct()
    got = queries.op5_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(bad) > 50 and sum(r.predicted for r in good) <= 0.01 * len(good)
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_edits_against_brute_force():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abc"), int(rng.integers(2, 14)))) for _ in range(60)]
    words.append("x" * 60)
    stems = ["".join(rng.choice(list("abc"), n)) for n in (4, 5, 7, 8)]
    lexicon = toxicity.Lexicon([(w, False) for w in words] + [(s, True) for s in stems])
    texts = ["".join(rng.choice(list("abcd"), int(rng.integers(1, 16)))) for _ in range(400)]
    for w in words[:40]:
        place = int(rng.integers(0, len(w)))
        texts += [w, w[:place] + w[place + 1 :], w[:place] + "d" + w[place:], w[:place] + "d" + w[place + 1 :], w[1:-1], "x" * 58, "x" * 57]
    for text in texts:
        found = [e for w in words if (e := edit_distance(text, w)) <= toxicity.allowed(w)]
        for s in stems:
            found += [e for n in range(len(text) + 1) if (e := edit_distance(text[:n], s)) <= (1 if len(s) >= 7 else 0)]
        assert lexicon.edits(text) == min(found, default=9), text


def test_quotations():
    text = 'a "b c" d “e\nf” g «h» `i` "open'
    inside = toxicity._Inside(toxicity.quotations(text))
    quoted = {w for w in "abcdefghi" if inside(text.index(w), text.index(w) + 1)}
    assert quoted == {"b", "c", "h", "i"}
    long = "x " * 400 + '"' + "y " * 400 + "z" + '"'
    assert toxicity._Inside(toxicity.quotations(long))(long.index("z"), long.index("z") + 1)


def test_samples_against_enumeration():
    """How often each segmentation is drawn, against its share of the sum over all."""
    from brightwater.llm.lattice import vocabulary

    pieces = vocabulary(MODEL)
    weight = piecesample.piece_weights(pieces, 1.0)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    word = "▁then"
    chance = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = tuple(word[a:b] for a, b in itertools.pairwise(at))
        if all(p in number for p in parts):
            chance[parts] = math.prod(float(weight[number[p], 0]) for p in parts)
    total = sum(chance.values())
    n = 20_000
    sampler = piecesample.Sampler(pieces, weight)
    ids, bounds = sampler.sample([" then"] * n, piecesample.mix(np.arange(n, dtype=np.uint64)))
    back = {int(i): p for i, p in zip(pieces.ids, pieces.pieces, strict=True)}
    drawn = Counter(tuple(back[int(x)] for x in ids[a:b]) for a, b in itertools.pairwise(bounds))
    assert len(chance) > 3 and set(drawn) <= set(chance)
    for parts, value in chance.items():
        p = value / total
        assert abs(drawn[parts] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_long_runs_take_linear_time():
    from brightwater.llm.lattice import vocabulary, word_codes

    pieces = vocabulary(MODEL)
    weight = piecesample.piece_weights(pieces, 1.0)
    run = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnop0123456789"), 150_000))
    sampler = piecesample.Sampler(pieces, weight)
    began = time.time()
    ids, _ = sampler.sample([run, "short words"], np.array([5, 6], np.uint64))
    pieces.lattice(*word_codes([run])).forward(weight)
    assert time.time() - began < 30
    back = {int(i): p for i, p in zip(pieces.ids, pieces.pieces, strict=True)}
    assert "".join(back[int(i)] for i in ids) == run + "short▁words"


def test_long_words_as_short_ones(monkeypatch):
    from brightwater.llm import lattice

    pieces = lattice.vocabulary(MODEL)
    weight = np.random.default_rng(2).random((pieces.size + 1, 2))
    made = pieces.lattice(*lattice.word_codes([" the", "ab" * 300, " x", "the" * 50]))
    want, share = made.forward(weight, shares=True)
    monkeypatch.setattr(lattice, "_LONG", 100)
    got, other = made.forward(weight, shares=True)
    assert np.allclose(want, got) and np.allclose(share, other)


@pytest.mark.parametrize("text", ["", None])
def test_empty_scores(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = toxicity.ToxicityModel([("grobnik", False)], np.array([-2.0] + [0.0] * (toxicity.FEATURES - 1)))
    assert round(toxicity.score(docs, model).first().score, 4) == round(1 / (1 + math.exp(2)), 4)
