"""Texts in which a few words repeat: few windows stand for a repetition, and rows don't grow with pairs of them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import passages
from tests.llm.test_copies import roots


def _new(rnd, n):
    return [f"u{rnd.getrandbits(40)}" for _ in range(n)]


@pytest.mark.parametrize("period", [2, 3, 7, 20])
def test_windows_of_a_repetition(period):
    """Each of the repeated places was a window of each function."""
    rnd = random.Random(period)
    words = [*_new(rnd, 100), *_new(rnd, period) * (560 // period), *_new(rnd, 100)]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words).encode()])], names=["doc_id", "text"])
    keys = np.concatenate([b.column("key").to_numpy() for b in passages._windows()(iter([batch]))])
    assert np.unique(keys, return_counts=True)[1].max() <= 12


def test_repetitions_are_joined(spark):
    """Runs of one pair of words of other lengths and starts; a pair of runs of 50 words that only shift lays on each other."""
    rnd = random.Random(8)
    pair, other = _new(rnd, 2), _new(rnd, 3)
    docs = {i: [*_new(rnd, 20 + i % 5), *(pair * 150)[i % 2 : 60 + 5 * i + i % 2], *_new(rnd, 15)] for i in range(40)}
    docs |= {100 + i: [*_new(rnd, 9 * i), *(other * 60)[i : 52 + 30 * i], *_new(rnd, 70)] for i in range(5)}
    docs |= {200 + i: _new(rnd, 300) for i in range(5)}
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)).collect()
    linked = {frozenset((r.doc_id, r.class_doc)) for r in found if r.doc_id != r.class_doc}
    assert set(roots(list(docs), lambda a, b: frozenset((a, b)) in linked).values()) == {0, 100, *range(200, 205)}


def test_rows_of_a_group_of_repetitions():
    """276 windows of each text were in a group, 79,091 in all, which weren't compared within some 50 s."""
    rnd = random.Random(9)
    pair, rows = _new(rnd, 2), []
    for i in range(100):
        words = [*_new(rnd, 90), *pair * 276, *_new(rnd, 90)]
        rows.append((i, " ".join(words).encode()))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    bits = 12
    shared = type("Shared", (), {"value": (bits, np.full(1 << (bits - 6), 2**64 - 1, dtype=np.uint64))})
    table = pa.Table.from_batches(list(passages._windows(shared)(iter([batch])))).sort_by([("key", "ascending"), ("doc_id", "ascending"), ("c", "ascending")])
    found = pa.Table.from_batches(list(passages._met(iter(table.to_batches(max_chunksize=500)))))
    ends = list(zip(found.column("doc_id").to_pylist(), found.column("class_doc").to_pylist(), strict=True))
    linked = {frozenset(e) for e in ends}
    assert set(roots(list(range(100)), lambda a, b: frozenset((a, b)) in linked).values()) == {0}
    assert table.num_rows < 8_000 and len(ends) < 40_000


def test_equal_windows_stand_for_each_other():
    """A passage in many texts, alone and twice in one of them: each is in a row, and none of those that are alike is lost."""
    rnd = random.Random(10)
    passage, docs = _new(rnd, 200), {}
    for i in range(30):
        docs[i] = [*_new(rnd, 10), *passage, *_new(rnd, 10)]
    docs[30] = [*_new(rnd, 10), *passage, *_new(rnd, 10), *passage, *_new(rnd, 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(docs)), pa.array([" ".join(w).encode() for w in docs.values()])], names=["doc_id", "text"])
    bits = 12
    shared = type("Shared", (), {"value": (bits, np.full(1 << (bits - 6), 2**64 - 1, dtype=np.uint64))})
    table = pa.Table.from_batches(list(passages._windows(shared)(iter([batch])))).sort_by([("key", "ascending"), ("doc_id", "ascending"), ("c", "ascending")])
    said = set()
    for b in passages._met(iter(table.to_batches(max_chunksize=500))):
        for x in b.to_pylist():
            assert docs[x["doc_id"]][x["s"] : x["e"]] == docs[x["class_doc"]][x["class_s"] : x["class_e"]]
            for d, s, e in ((x["doc_id"], x["s"], x["e"]), (x["class_doc"], x["class_s"], x["class_e"])):
                said |= {(d, k) for k in range(s, e)}
    assert {(d, k) for d, w in docs.items() for k in range(len(w)) if w[k] in passage} == said
