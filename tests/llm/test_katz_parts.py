"""The model by parts: words that are dealt out over several parts, chunks, ids of other types, what is written of it."""

from __future__ import annotations

import math
import random
import zlib

import pytest

from loomspark.llm import katz, katz_parts
from tests.llm.test_corpus import PlainKatz, plain_words


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_words_dealt_out_over_parts(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "FREQUENT_WORDS", 12)
    monkeypatch.setattr(katz_parts, "PART", 40)
    monkeypatch.setattr(katz_parts, "PARTS", 7)
    rnd = random.Random(3)
    docs = [(f"d{i}", " ".join(f"v{int(90 * rnd.random() ** 4)}" for _ in range(rnd.randint(0, 30)))) for i in range(150)]
    docs += [(f"e{i}", "is here") for i in range(90)]
    train = [t for i, t in docs if zlib.crc32(i.encode()) % 7 != 2]
    plain = PlainKatz(train, order)
    got = {r.doc_id: r for r in katz.scored(spark.createDataFrame(docs, "doc_id string, text string").repartition(5), order=order).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        said = [*plain_words(t), "END"]
        assert (got[i].n_tokens, got[i].n_known) == (len(said), sum(w in plain.words for w in said))
        assert math.isclose(got[i].score, plain.score(t), rel_tol=1e-9, abs_tol=1e-9)


def test_less_is_written_than_tokens_take(spark):
    """Each token was some 40 bytes in shuffles of its n-grams alone; now all that the job writes is less than that."""
    rnd = random.Random(4)
    docs = [(i, " ".join(f"w{int(9000 * rnd.random() ** 3)}" for _ in range(300))) for i in range(1000)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert katz.scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).count() == 1000
    assert 0 < (written() - before) / 301_000 < 30


def test_memory_of_a_part():
    """A part is counted and scored in slices: scoring then holds some 45 bytes an event, not 155, and gives the same."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rnd = random.Random(6)
    texts = [" ".join(f"w{int(3000 * rnd.random() ** 3)}" for _ in range(300)).encode() for _ in range(2000)]
    hashes = katz.Numbered()
    hashes.tokens(texts)
    top = hashes.hashes()
    known = katz_parts.Words(top, np.ones(len(top), dtype=np.int64), np.zeros(len(top)), np.full(len(top), 1 / len(top)))
    shared = SimpleNamespace(value=(known, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))))
    rows = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([True] * 2000), pa.array(texts)], names=["doc_id", "train", "b"])
    dealt = pa.Table.from_batches(list(katz_parts._dealer(shared, 3, 1)(iter([rows]))))
    said = pa.table({k: pa.array([], t) for k, t in (("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("v", pa.float64()))})
    scorer = katz_parts._scorer(shared, 3, [[], *[[0.5] * (katz.K + 1)] * 3], pa.int64())
    out = {}
    for at in (10**9, 50_000):
        katz_parts.SLICE, before = at, katz_parts.SLICE
        try:
            tracemalloc.start()
            counted = katz_parts._counter(shared, 3)(dealt)
            counted = counted.filter(pa.compute.equal(counted.column("kind"), katz_parts.EVENTS)).select(["part", "blob"])
            tracemalloc.reset_peak()
            scores = scorer(counted, said)
            out[at] = tracemalloc.get_traced_memory()[1] / 602_000, scores
        finally:
            tracemalloc.stop()
            katz_parts.SLICE = before
    assert out[50_000][1].equals(out[10**9][1])
    assert out[50_000][0] < 70


@pytest.mark.parametrize("most", [40, 2**24])
def test_order_of_events(most):
    """Events went through one sort for each column; in numbers that hold all words they come in the same order."""
    import numpy as np

    rnd = np.random.default_rng(7)
    columns, of = [rnd.integers(0, most, 3000, dtype=np.int32) for _ in range(3)], rnd.integers(0, 50, 3000, dtype=np.int32)
    by = np.lexsort([of, *reversed(columns)])
    got, docs = katz_parts._sorted(columns, of)
    assert all((g == c[by]).all() for g, c in zip(got, columns, strict=True)) and (docs == of[by]).all()
    steps = np.diff(columns[1], prepend=np.int32(0))
    for x in (steps, of, of[:0]):
        assert (katz_parts._whole(katz_parts._planes(x), len(x)) == x).all()
