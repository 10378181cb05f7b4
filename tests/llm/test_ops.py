"""Edge rows and brute force on small tables."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brightwater.llm import langid, licenses, packing, piecesample, toxicity
from brightwater.llm.embeddings import near_vectors
from brightwater.llm.linededup import line_dedup
from brightwater.llm.minhash import near_duplicates
from brightwater.llm.topk import exact_topk

PASSAGE = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (3, f"start here {PASSAGE} end"),
    (4, f"another start\nx\ny\nz\n{PASSAGE}"),
    (5, "a\nx\ny\nz\nb"),
    (6, None),
    (7, ""),
    (8, " \n\t "),
    (None, f"no id {PASSAGE}"),
    (9, "short"),
    (9, "short"),
    (10, "long " * 3000),
]
SCHEMA = "doc_id long, text string, batch string, id int, key string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    """Columns beside the two have names that the operators use inside."""
    return spark.createDataFrame([(*r, "b", 1, "k", 2) for r in ROWS], SCHEMA)


def test_minhash(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert (2, 10, 1, False) in got and (1, 10, 1, True) in got
    assert (6, 0, 6, True) in got and (7, 0, 7, True) in got and (9, 1, 9, True) in got
    assert any(r[0] is None and r[2] is None and r[3] for r in got)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_lines(docs):
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert got[5].n_removed == 3 and got[5].text == "a\nb" and got[4].n_removed == 0
    assert got[6].text is None and got[6].n_lines == 0 and got[7].n_lines == 1
    assert line_dedup(docs.limit(0)).count() == 0


def test_packing(docs):
    path = public_tokenizers.path
    rows = packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), part_pieces=8, with_ids=True).collect()
    bins = {}
    for r in rows:
        assert len(r.ids) == r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([r.length for r in rows])
    assert packing.lower_bound(lengths, 2048) <= len(bins) <= math.ceil(lengths.sum() / 2048) + 1


def test_bounds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 101, 60)
        bins, _, fills = packing.best_fit_decreasing(lengths, 100)
        assert fills.max() <= 100 and len(set(bins.tolist())) == len(fills) >= packing.lower_bound(lengths, 100)
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


def test_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path
    ours, theirs = packing.ByteTokenizer(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in ("", " a  b\n\n c's 12½ “x”—y", "<|endoftext|>x", "日本語 　 text", "a b \x85 c", "x" * 300):
        assert ours(text) == np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.05 * rng.normal(size=8)], i % 2) for i in range(60)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [None] + [1.0] * 7, 1), (104, [1.0] * 8, None), (None, [1.0] * 8, 1), (105, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def usable(rows):
    return [r for r in rows if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]


def test_vectors(vectors):
    rows = vectors.collect()
    got = {r.vec_id: r for r in near_vectors(vectors).collect()}
    good = [r for r in usable(rows) if r.label is not None and any(r.embedding)]
    for a in good:
        x = np.array(a.embedding, float)
        linked = [b.vec_id for b in good if b.vec_id != a.vec_id and b.label == a.label and len(b.embedding) == len(a.embedding) and x @ np.array(b.embedding, float) / np.linalg.norm(x) / np.linalg.norm(np.array(b.embedding, float)) >= 0.93]
        assert got[a.vec_id].n_links == len(linked)
    assert got[100].component_id == 100 and got[104].n_links == 0 and got[None].kept
    assert near_vectors(vectors.limit(0)).count() == 0


def test_topk(vectors):
    got = {}
    for r in exact_topk(vectors, F.col("vec_id") % 10 == 0, block=1024, query_block=256).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = usable(vectors.collect())
    whole = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int) for r in good}
    for q in [r.vec_id for r in good if r.vec_id % 10 == 0]:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_language(spark):
    rows = [(i, ("der die und ist nicht " if i % 2 else "the and is not with ") * 10, "de" if i % 2 else "en") for i in range(40)] + [(50, None, None), (51, "123 !", "en"), (52, "the house is not with", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[52].lang_pred == "en" and got[1].lang_pred == "de" and got[50].lang_pred == got[51].lang_pred == "und" and got[50].score == 0


def test_lattice_sums_all_segmentations():
    from brightwater.llm.lattice import vocabulary, word_codes

    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    weight = np.full((pieces.size + 1, 1), 0.01)
    known = set(pieces.pieces)

    def total(word):
        ways = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            ways[j] = sum(0.01 * ways[i] for i in range(j) if word[i:j] in known or (j - i == 1 and word[i:j] not in known))
        return ways[-1]

    tests = [" the", " nothing", "日x", " " + "ab" * 40]
    got, _ = pieces.lattice(*word_codes(tests)).forward(weight)
    for word, value in zip(tests, got[:, 0], strict=True):
        assert abs(value - math.log(total(word.replace(" ", "▁")))) < 1e-9


def test_sampling(spark):
    texts = ["", None, "plain words here", "tabs\tand\n\nlines  ", "▁ literal ▁x", "日本 😀 \x00", " lead", "word " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    one = {r.doc_id: r for r in piecesample.decode(piecesample.encode(docs, path, keep=("text",)), path).collect()}
    assert all(r.decoded == r.text for r in one.values())
    again = {r.doc_id: r.ids for r in piecesample.encode(docs.repartition(3), path).collect()}
    assert all(again[i] == r.ids for i, r in one.items())
    assert len(set(map(tuple, (again[7][k : k + 2] for k in range(0, 100, 2))))) > 1


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, labels = [], []
    for i in range(120):
        text = list(rng.choice(filler, 30))
        if i % 3 == 0:
            for place in rng.integers(0, 30, 2):
                text[place] = "grobnik"
        rows.append((i, " ".join(text))), labels.append((i, int(i % 3 == 0)))
    rows += [(200, "alpha gronik beta"), (201, 'the word "grobnik" is an insult'), (202, None), (203, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(120)) and got[201] < 0.5 and got[202] == got[203] < 0.5
    lexicon = toxicity.Lexicon([("grobnik", False)])
    assert [lexicon.edits(w) for w in ("grobnik", "gronik", "grobnnik", "grabnik", "grbnk", "alpha")] == [0, 1, 1, 1, 9, 9]
    assert toxicity.Lexicon([("grobnikant", False)]).edits("grbnkant") == 2


def test_licenses(spark):
    text = licenses.TEMPLATES["MIT"].replace("free of charge", "without charge")
    docs = spark.createDataFrame([(1, "Intro. " + text), (2, "Released under the MIT License."), (3, None), (4, "nothing"), (5, "Licensed under the Apache License, Version 2.0.\nmore")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert set(got) == {1, 2, 5} and got[1].license == "MIT" and got[1].coverage > 0.95 and got[2].coverage == 1.0
    assert got[5].license == "Apache-2.0-notice" and (got[5].start, got[5].end) == (0, len("Licensed under the Apache License, Version 2.0"))


def test_pipeline_on_edges(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {1, 3, 9, 10} <= {r.doc_id for r in rows} and not {2, 6, 7, 8} & {r.doc_id for r in rows}
