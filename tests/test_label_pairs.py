"""Entries of label pairs are summed where they meet."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomspark.operators import canon, labelpairs, review
from tests.conftest import SMALL

WORDS = ["the", "of", "and", "to", "alpha", "beta", "gamma", "alpha-beta", "be_ta", "Gamma", "x", "7", "chapter", "alphabet", "is"]
COLUMNS = ["anchor", "item_count", "best_score", *(r.replace("-", "_") for r in review.RELATIONS), "exactish", "zero_overlap", "high_score", "low_specificity"]


def records(spark, more=()):
    rows = []
    for i in range(160):
        label = " ".join(WORDS[(i * 7 + k * (1 + i % 5)) % len(WORDS)] for k in range(1 + i % 5))
        rows += [(f"c{c}", f"c{c}:entity-{i % 90}-{i // 90}", label, ["concept", "thread", None][(i + c) % 3]) for c in range(i % 4)]
    return spark.createDataFrame([*rows, *more], "corpus_id string, member_id string, label string, entity_type string")


def same(left, right, columns):
    assert sorted(map(tuple, left.select(*columns).collect())) == sorted(map(tuple, right.select(*columns).collect()))


@pytest.mark.parametrize("more", [(), [("c1", "c1:entity-odd", "alpha <> beta", "thread"), ("c2", "c2:entity-odd", "alpha beta", "thread")]])
def test_entries_are_summed_as_if_they_were_written(spark, monkeypatch, more):
    monkeypatch.setattr(labelpairs, "MEETINGS", 500)
    monkeypatch.setattr(labelpairs, "BLOCK", 100)
    monkeypatch.setattr(labelpairs, "GROUP", 2)
    rows = records(spark, more).where(F.expr("label rlike '[a-z]{2}'")).cache()
    for threshold in (0.2,):
        entries = review.entries(canon.suggestions(rows, "entity-alias", threshold=threshold)).cache()
        assert entries.count() > 500
        same(labelpairs.anchors(rows, threshold), review.anchors(entries), COLUMNS)
        same(labelpairs.anchors(rows, threshold, ["disjoint"]), review.anchors(entries.where("relation = 'disjoint'")), COLUMNS)
        same(labelpairs.examples(rows, threshold), review.examples(entries), ["anchor", "place", "review_id", "score", "relation"])


@pytest.mark.parametrize("query", ["campaign_scenarios", "assist_examples", "assist_batches", "assist_groups"])
def test_no_pair_of_members_is_formed(spark, monkeypatch, query):
    def formed(*_, **__):
        raise AssertionError("pairs of members are formed")

    monkeypatch.setattr(canon, "suggestions", formed)
    assert not __spark_entry__.queries()[query](spark, SMALL).isEmpty()
