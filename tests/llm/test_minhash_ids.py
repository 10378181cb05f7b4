"""Near duplicates where an id stands on rows with different texts."""

import pytest

from brightwater.llm.minhash import near_duplicates


@pytest.mark.parametrize("turn", [0, 1])
def test_texts_under_one_id(spark, turn):
    base = [" ".join(f"{k}w{i}" for i in range(200)) for k in range(6)]
    near = [t.replace("w199", "other") for t in base]
    # each of the texts of id 1 has a near copy of its own
    rows = [(1, t) for t in (base if turn else base[::-1])] + [(10 + k, t) for k, t in enumerate(near)] + [(30, "apart " * 9)]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (30, 30, True)} | {(10 + k, 1, False) for k in range(6)}
