"""Queries that SQL can't express, over a whole small table, against plain versions."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import pytest

from loomspark.llm import edit_counts
from loomspark.llm.queries import QUERIES
from tests.llm.test_corpus import PlainKatz, plain_words


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_language_model(spark, small, docs):
    plain = PlainKatz([t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {r.doc_id: r for r in QUERIES["op10_katz"](spark, small).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert math.isclose(got[i].score, plain.score(t), rel_tol=1e-9)
        assert got[i].n_known == sum(w in plain.words for w in [*plain_words(t), "END"])


def test_every_shared_passage_is_found(spark, small, docs):
    """Documents with 51 words in a row in common are both in the result, with a place that covers such words."""
    holders = defaultdict(set)
    for i, t in docs.items():
        words = plain_words(t)
        for k in range(len(words) - 50):
            holders[tuple(words[k : k + 51])].add(i)
    want = {i for of in holders.values() if len(of) > 1 for i in of}
    found = QUERIES["op2_passages"](spark, small).collect()
    assert want and want <= {r.doc_id for r in found}
    for r in found:
        if r.doc_id != r.class_doc:
            a, b = plain_words(docs[r.doc_id]), plain_words(docs[r.class_doc])
            grams = [{tuple(x[k : k + 5]) for k in range(s, s + r.end_word - r.start_word - 4)} for x, s in ((a, r.start_word), (b, r.class_start))]
            assert r.end_word <= len(a) and len(grams[0] & grams[1]) >= 36


def test_edited_counts(spark, small, docs):
    import public_tokenizers

    with open(public_tokenizers.path(edit_counts.RANKS), "rb") as f:
        encoder = edit_counts.Encoder(f.read(), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in QUERIES["op9_edited_counts"](spark, small).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        third, half = len(t) // 3, len(t) // 2
        after = t[:third] + " amended" + t[third + 12 :]
        after = after[:half] + t[:24] + after[half:]
        after = after[5:]
        assert (got[i].n_tokens, got[i].n_tokens_after, got[i].chars_after) == (sum(encoder.counts(encoder.split(t))), sum(encoder.counts(encoder.split(after))), len(after))


def test_pieces_come_back(spark, small, docs):
    got = QUERIES["op7_pieces"](spark, small).collect()
    assert {r.doc_id for r in got} == set(docs) and all(r.exact for r in got)
    assert all(len(r.alternatives) == 2 and r.score >= r.alternatives[0].score >= r.alternatives[1].score for r in got if len(docs[r.doc_id]) > 20)
