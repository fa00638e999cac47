"""No bound on what is broadcast leaves out what it does not hold."""

import random

import pytest

from segno.llm import lm_score


@pytest.mark.parametrize("most", [0, 8])
def test_bigrams_that_are_not_broadcast_count_in_full(spark, monkeypatch, most):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("sun moon star red blue green one two three four".split()) for _ in range(n))
    docs = spark.createDataFrame([(i % 20, text(40)) for i in range(25)] + [(None, text(9)), (30, ""), (31, None)], "doc_id long, text string")
    target = spark.createDataFrame([(text(30),) for _ in range(6)], "text string")
    rows = lambda: sorted(lm_score.cross_entropy_difference(docs, target).collect(), key=lambda x: (x.doc_id is None, x.doc_id, x.score))
    want = rows()
    monkeypatch.setattr(lm_score, "BIGRAMS", most)
    got = rows()
    assert len(got) == len(want) == 28
    for a, b in zip(got, want):
        assert [x is None for x in a] == [x is None for x in b]
        assert [x or 0 for x in a] == pytest.approx([x or 0 for x in b], rel=1e-9, abs=1e-12)
