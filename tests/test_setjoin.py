"""The set-similarity join and the groups of entity aliases against plain versions."""

from __future__ import annotations

import random

import pytest

from loomspark.operators import canon, neardup, setjoin


@pytest.mark.parametrize(("most", "threshold"), [(9, 0.3), (9, 0.7), (80, 0.35)])
def test_similar_sets(spark, most, threshold):
    draw = random.Random(most)
    sets = {k: {f"w{int(draw.random() ** 2 * most * 2)}" for _ in range(draw.randint(1, most))} for k in range(150)}
    rows = spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "set_id long, items array<string>")
    want = {(a, b): round(x, 6) for a in sets for b in sets if a < b and (x := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold - 1e-9}
    got = {(r.left_set, r.right_set): round(r.jaccard, 6) for r in setjoin.similar_sets(rows, threshold).collect()}
    assert want and got == want


def test_linked_groups(spark, monkeypatch):
    """The same as the components of all pairs, which are not formed."""
    draw = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(f"c{draw.randint(0, 2)}", f"m{k:03d}", " ".join(draw.sample(words, draw.choice([0, 1, 1, 3, 4]))), draw.choice(["concept", "concept", "conversation", None])) for k in range(60)]
    rows += [("c0", "n1", "one two", "concept"), ("c0", "n2", "two one", "concept"), ("c0", "n3", "lone", "concept"), ("c1", "n4", "lone", "concept"), ("c1", "n5", "Alone", "concept"), ("c2", "n6", "alone", "person"), ("c1", "n7", "alone", "concept")]
    records = spark.createDataFrame(rows, "corpus_id string, member_id string, label string, entity_type string")
    want = {tuple(r) for r in canon.components(records, canon.suggestions(records, "entity-alias")).select("member_id", "root").collect()}
    monkeypatch.setattr(canon, "suggestions", None)
    got = {tuple(r) for r in canon.linked_groups(records).collect()}
    assert got == want and ("n2", "n2") in got and ("n4", "n4") in got and ("n7", "n5") in got


def test_trigram_pairs_of_copies(spark, monkeypatch):
    """Copies go through the join of sets once, and all their pairs are there."""
    texts = ["alpha beta gamma", "alpha beta gamma", "beta alpha gamma", "alpha beta delta", "omega", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    joined = []
    of = neardup.similar_sets
    monkeypatch.setattr(neardup, "similar_sets", lambda sets, threshold: joined.append(sets.count()) or of(sets, threshold))
    got = {(r.left_key, r.right_key) for r in neardup.trigram_pairs(rows, "k", "t", 0.4).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)} and joined == [3]


@pytest.mark.parametrize(("words", "crowded"), [(60, True), (4000, False)])
def test_long_sets(spark, monkeypatch, words, crowded):
    """Sets of a few words are compared pair by pair, those of many where they meet; none of the pairs is dealt out in the first case."""
    monkeypatch.setattr(setjoin, "BLOCK", 50)
    monkeypatch.setattr(setjoin, "TILE", 9)
    monkeypatch.setattr(setjoin, "ITEMS", 16)
    draw, seen, of = random.Random(words), [], setjoin._meeting
    monkeypatch.setattr(setjoin, "_meeting", lambda *x: seen.append(x) or of(*x))
    sets = {k: {f"w{draw.randrange(words)}" for _ in range(draw.randint(1, 50))} for k in range(120)}
    sets |= {k + 200: set(sorted(sets[k])[1:]) | {"more"} for k in range(60)}
    sets = {min(k for k in sets if sets[k] == x): x for x in sets.values()}
    rows = spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "set_id long, items array<string>")
    want = {(a, b): x for a in sets for b in sets if a < b and (x := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.2}
    got = {(r.left_set, r.right_set): r.jaccard for r in setjoin.similar_sets(rows, 0.2).collect()}
    assert want and got == want and bool(seen) != crowded
