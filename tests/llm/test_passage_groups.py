"""Large groups of near copies: all are joined, by rows that don't grow with the square of their number."""

from __future__ import annotations

import random

import pytest

from loomspark.llm import passages
from tests.llm.test_copies import roots


@pytest.mark.parametrize("hot", [passages.HOT, 50])
def test_rows_of_near_copies(spark, monkeypatch, hot):
    """Copies without 50 equal words, which all had a row with each other; also where a group is dealt out in tiles."""
    monkeypatch.setattr(passages, "HOT", hot)
    rnd = random.Random(15)

    def new(n):
        return [f"u{rnd.getrandbits(40)}" for _ in range(n)]

    passage, n = new(90), 120
    docs = {i: [*new(30 + i % 7), *passage[:45], *new(1), *passage[46:], *new(20)] for i in range(n)}
    other = new(200)
    docs |= {1000 + i: new(5) + other[50 * i : 50 * i + 130] + new(9) for i in range(2)}
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)).collect()
    pairs = {frozenset((r.doc_id, r.class_doc)) for r in found if r.doc_id != r.class_doc}
    assert set(roots(list(docs), lambda a, b: frozenset((a, b)) in pairs).values()) == {0, 1000}
    assert len(pairs) < n * (n - 1) / 4
    assert all(r.similarity >= passages.LEAST for r in found)
