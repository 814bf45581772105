"""Exact and near copies against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import exact_dedup as X
from loomspark.llm import simhash as H
from loomspark.llm.components import connected_components

DOCS = [(1, "same text"), (2, "same text"), (3, None), (4, ""), (5, "Same text"), (6, "é" * 70_000), (7, "é" * 70_000), (7, "é" * 70_000), (None, "same text"), (9, "b" * 65_536), (10, "b" * 65_537)]
SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("keep_id", "fp", "fp_a", "kept", "key", "n_bytes", "group_size", "component_id", "a", "b", "t")})


def test_fingerprints_compose():
    rnd = random.Random(1)
    for _ in range(50):
        data = rnd.randbytes(rnd.choice([0, 1, 100, 65_536, 65_537, 200_000]))
        cut = rnd.randint(0, len(data))
        assert X.combine(X.fingerprint(data[:cut]), X.fingerprint(data[cut:])) == X.fingerprint(data)
    plain = 0
    for x in b"some bytes":
        plain = (plain * X.BASES[0] + x) % X.PRIMES[0]
    assert X.fingerprint(b"some bytes")[0] == plain


@pytest.mark.parametrize(("huge", "moduli"), [(X.HUGE, X.PRIMES), (50_000, X.PRIMES), (X.HUGE, (1, 1))])
def test_exact_groups(spark, huge, moduli):
    """Also with texts cut into chunk rows, and with fingerprints that tell lengths only."""
    docs = [*DOCS, (11, "some texts"), (12, "more texts"), (13, "some texts")]
    got = X.exact_groups(frame(spark, docs), huge=huge, moduli=moduli).collect()
    assert len(got) == len(docs)
    by_text = {}
    for i, t in docs:
        by_text.setdefault(t or "", []).append(i)
    want = sorted((str(i), str(max(x for x in by_text[t or ""] if x is not None)), len(by_text[t or ""]), i == max(x for x in by_text[t or ""] if x is not None), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_comparison_sees_every_difference(spark):
    a = b"x" * 200_000
    texts = [(1, a), (2, a), (3, a[:150_000] + b"y" + a[150_001:]), (4, b"y" + a[1:]), (5, a[:-1] + b"y"), (6, b""), (7, b"")]
    member = spark.createDataFrame([(i, 1) for i in (2, 3, 4, 5)] + [(6, 7)], "doc_id long, keep_id long")
    for part in (1 << 20, 65_536, 199_999, 1_000):
        assert sorted(r.doc_id for r in X.differing(spark.createDataFrame(texts, "doc_id long, b binary"), member, part).collect()) == [3, 4, 5]


def test_ids_of_text(spark):
    rows = spark.createDataFrame([("a", "same words here now"), ("b", "same words here now"), (None, "same words here now"), (None, "x"), (None, "x")], "doc_id string, text string")
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in X.exact_groups(rows).collect()) == [("None", "None", 2, True)] * 2 + [("None", "b", 3, False), ("a", "b", 3, False), ("b", "b", 3, True)]
    assert sorted((str(r.doc_id), str(r.component_id)) for r in H.simhash_components(rows).collect()) == [("None", "None")] * 2 + [("None", "a"), ("a", "a"), ("b", "a")]
    assert sorted((str(r.doc_id), r.text) for r in H.drop_near_copies(rows).collect()) == [("None", "x"), ("a", "same words here now")]


def test_near_copies_of_rows_that_share_an_id(spark):
    rows = frame(spark, [(1, "one two three four five"), (1, "another text with other words"), (2, "one two three four five"), (None, "another text with other words"), (3, "y " * 200_000), (4, "y " * 200_000)])
    kept = H.drop_near_copies(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id, r.text[:3]) for r in kept.collect()) == [(1, "ano"), (1, "one"), (3, "y y")]


def test_exact_stage_and_empty(spark):
    kept = X.drop_exact_copies(frame(spark, DOCS))
    assert kept.columns == frame(spark, DOCS).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7, 9, 10]
    assert X.exact_groups(frame(spark, [])).count() == 0
    assert X.drop_exact_copies(frame(spark, [])).count() == 0


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    up = {x: x for x in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    return {x: find(x) for x in items}


def test_simhash_components(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(1001, None), (1002, ""), (1003, "ONE two"), (1004, "one\ttwo x É"), (1004, "one\ttwo x É"), (1005, rows[0][1] + " more")]
    fps = [(i, plain_simhash(t)) for i, t in rows]
    assert all(H.simhash((t or "").encode()) == f for (_, t), (_, f) in zip(rows, fps, strict=True))
    values = sorted({f for _, f in fps})
    root = roots(values, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, f in fps:
        first[root[f]] = min(first.get(root[f], i), i)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in H.simhash_components(frame(spark, rows)).collect())
    assert got == sorted((i, f"{f:016x}", first[root[f]]) for i, f in fps)
    kept = [r.doc_id for r in H.drop_near_copies(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted({i for i, f in fps if first[root[f]] == i})


def test_links_in_crowded_cells(spark):
    """A cluster far larger than a block, and random fingerprints with planted neighbours."""
    rnd = random.Random(3)
    center = rnd.getrandbits(64)
    values = {center ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)}
    for _ in range(150):
        x = rnd.getrandbits(64)
        values |= {x, *(x ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (4, 5))}
    values = sorted(values)
    fps = spark.createDataFrame([(H._signed(v),) for v in values], "fp long")
    found = H.links(fps, block=16).collect()
    edges = {tuple(sorted((r.a & (2**64 - 1), r.b & (2**64 - 1)))) for r in found}
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    assert roots(values, lambda a, b: (a, b) in edges) == roots(values, lambda a, b: (a ^ b).bit_count() <= 4)


def test_embedding_is_a_lower_bound():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 1 << 63, 2000, dtype=np.uint64), rnd.integers(0, 1 << 63, 2000, dtype=np.uint64)
    distance = np.bitwise_count(H._embed(a) ^ H._embed(b))
    plain = [sum(abs((int(x) >> 2 * s & 3).bit_count() - (int(y) >> 2 * s & 3).bit_count()) for s in range(32)) for x, y in zip(a, b, strict=True)]
    assert distance.tolist() == plain
    assert (distance <= np.bitwise_count(a ^ b)).all()


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2100)] + [(7, 7)]
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    near = {frozenset(e) for e in edges}
    want = roots(nodes, lambda a, b: frozenset((a, b)) in near)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
