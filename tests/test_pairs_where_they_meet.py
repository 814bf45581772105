"""Pairs of labels are made where these meet: nothing that is written grows with their number."""

from __future__ import annotations

from itertools import combinations

from loomspark.operators import canon, setjoin
from loomspark.plans import shared


def test_pairs_are_not_written(spark, monkeypatch):
    """Labels with three words in common, so that every two of them are similar; all three are dealt out over several keys."""
    rows = [(f"c{i % 5}", f"c{i % 5}:entity-{i:03d}", f"Alpha beta gamma w{i // 2}x", "conversation") for i in range(80)]
    records = spark.createDataFrame(rows, "corpus_id string, member_id string, label string, entity_type string")
    sizes = {}

    def noted(df, name="rows", by=None):
        out = shared.written(df, name, by)
        sizes[name] = out.count()
        return out

    for module in (canon, setjoin):
        monkeypatch.setattr(module, "written", noted)
    got = {(r.left_id, r.right_id): r.score for r in canon.suggestions(records, "entity-alias", threshold=0.3).collect()}
    want = {}
    for a, b in combinations(sorted(rows, key=lambda r: r[1]), 2):
        x, y = set(a[2].lower().split()), set(b[2].lower().split())
        if a[0] != b[0]:
            want[a[1], b[1]] = round(len(x & y) / len(x | y), 4)
    assert got == want and len(want) > 2000
    assert max(sizes.values()) <= 2 * len(rows), sizes
