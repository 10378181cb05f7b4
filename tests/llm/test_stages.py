"""Each stage of the pipeline against a plain version of it, with extra columns whose names the operators use."""

import numpy as np
import pytest

import corpus_pipeline

CLASH = ("score", "lang_pred", "margin", "_text", "_rest", "_none", "n_lines", "n_removed", "n_words", "spans", "kept", "component_id", "id", "own", "th", "starts", "batch", "lines", "key", "a b", "x.y", "s", "o", "free", "part", "ids")
ENGLISH = "the and of that with for this from have were which their would there about".split()
GERMAN = "der und ist nicht ein wird auch noch nach bei aus dem wenn kann oder durch".split()


def text(rng, words, n):
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for k in range(60):
        out.append((k, text(rng, ENGLISH if k % 2 else GERMAN, int(rng.integers(20, 200))), ("en" if k % 2 else "de") if k % 5 else None))
    out += [(100, "9f8b3c 0xb64b244acde2e3b0aa8f051af1ec018ebaba3add qxzvkjq wqxzj " * 4, "en"), (101, None, "en"), (102, "", None), (103, "12 3 !", "de"), (None, text(rng, ENGLISH, 60), None)]
    passage = " ".join(f"p{i}" for i in range(60))
    own = [" ".join(f"{k}u{i}" for i in range(120)) for k in range(8)]
    out += [(110, f"{own[0]} {passage}", "en"), (111, f"{passage}\n{own[1]}", "en"), (112, own[2], "en"), (113, own[2].upper(), "en"), (114, own[2].replace("2u60 ", "other "), "en"), (115, "the and of that\nwith for this\nhave were which\nown line", "en"), (116, "the and of that\nwith for this\nhave were which\nanother", "en"), (117, "the and of that\nwith for this\nhave were which", "en")]
    return out + [(118, own[3], "en"), (118, own[3], "en"), (118, own[4], "de")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, lang, len(t) if t is not None else None, *CLASH) for i, t, lang in rows], schema)


def stage(spark, docs, k):
    name, run = corpus_pipeline.STAGES[k]
    done = run(spark, docs, "")
    got = done.collect()
    if k < 4:
        assert done.columns == docs.columns and done.dtypes == docs.dtypes
        for r in got:
            assert tuple(r)[4:] == CLASH
    empty = run(spark, docs.limit(0), "")
    assert empty.count() == 0
    return got


def texts(got):
    return sorted((str(r.doc_id), r.text) for r in got)


def test_language(spark, docs, rows):
    got = stage(spark, docs, 0)
    gone = {100, 101, 102, 103}
    assert {(i, t) for i, t, _ in rows if i not in gone} == {(r.doc_id, r.text) for r in got}
    assert all(r.lang == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id is not None and r.doc_id < 60)
    assert next(r.lang for r in got if r.doc_id is None) == "en"


def test_lines(spark, docs, rows):
    want, seen = [], set()
    for i, t, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: 1 << 62 if r[0] is None else r[0]):
        lines = t.split("\n")
        drop = set()
        for k in range(len(lines) - 2):
            if (w := tuple(lines[k : k + 3])) in seen:
                drop |= {k, k + 1, k + 2}
            seen.add(w)
        if not drop or len(drop) < len(lines):
            want.append((str(i), "\n".join(x for k, x in enumerate(lines) if k not in drop)))
    got = stage(spark, docs, 1)
    assert texts(got) == sorted(want) and ("117", "the and of that\nwith for this\nhave were which") not in want
    assert all(r.n_chars == len(r.text) for r in got)


def test_near(spark, docs, rows):
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    link = {}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                link.setdefault(i, set()).add(j)
    reach = {i: {i} for i, _ in sets if i is not None}
    for _ in range(6):
        reach = {i: set().union(*(link.get(j, {j}) for j in own)) for i, own in reach.items()}
    want = [(str(i), t) for i, t, _ in rows if i is None or min(reach[i]) == i]
    got = stage(spark, docs, 2)
    assert sorted(str((str(r.doc_id), r.text)) for r in got) == sorted(map(str, want))


def test_passages(spark, docs, rows):
    least = {}
    for i, t, _ in rows:
        w = (t or "").split()
        for k in range(len(w) - 12):
            at = tuple(w[k : k + 13])
            least[at] = min(least.get(at, 1 << 62), 1 << 61 if i is None else i)
    want = []
    for i, t, _ in rows:
        w = (t or "").split()
        drop = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < (1 << 61 if i is None else i) for j in range(13)}
        if not drop or len(drop) < len(w):
            want.append((str(i), [x for k, x in enumerate(w) if k not in drop]))
    got = stage(spark, docs, 3)
    assert sorted((str(r.doc_id), (r.text or "").split()) for r in got) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_packing(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    got = stage(spark, docs, 4)
    want = sorted((str(i), len(encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.length) for r in got) == want
    assert len({r.sequence_id for r in got}) == -(-sum(n for _, n in want) // 2048)


def test_run(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, text(rng, ENGLISH, 100), None if k == 3 else "en", "s", 0) for k in range(20)]
    rows += [(30, rows[0][1], "en", "s", 0), (31, "q9x7 zqxj 0xb64b244acde2e3b0aa8f051af1ec018ebaba3add " * 3, None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))
