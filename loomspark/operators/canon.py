"""Cross-collection canon: pair suggestions, decisions, groups and their materialised tables.

Records: (corpus_id, member_id, label) and what a similarity needs. A similarity that reaches a positive threshold implies
a least Jaccard index of the labels' tokens, so candidates come from a set-similarity join of the distinct token sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as T
from loomspark.operators.components import connected_components
from loomspark.operators.setjoin import partitions, similar_members, similar_sets
from loomspark.plans.shared import written

#: Least similarity by review type.
THRESHOLDS = {"entity-alias": 0.7, "family-merge": 0.65, "action-merge": 0.78, "unresolved-merge": 0.78, "contradiction": 0.55}
#: Lists of texts that records may have; a list's tokens as a set are the column with _set behind its name.
LISTS = ("themes", "key_entities", "actions")
SIMILARITIES: dict[str, Callable[[str, str], Column]] = {}


def register_similarity(name: str, of: Callable[[str, str], Column]) -> None:
    """Add a similarity: from the prefixes of the left and right columns to a column in 0..1."""
    SIMILARITIES[name] = of


def _label(a: str, b: str) -> Column:
    same = T.normalize_label(F.col(f"{a}.label")) == T.normalize_label(F.col(f"{b}.label"))
    return F.round(F.greatest(same.cast("double"), T.jaccard(F.col(f"{a}.tokens"), F.col(f"{b}.tokens"))), 4)


def _family(a: str, b: str) -> Column:
    # The weights of title, themes, entities and actions.
    same = T.normalize_label(F.col(f"{a}.label")) == T.normalize_label(F.col(f"{b}.label"))
    title = F.when(same, F.lit(1.0)).otherwise(T.jaccard(F.col(f"{a}.tokens"), F.col(f"{b}.tokens")))
    theme, entity, action = (T.jaccard(F.col(f"{a}.{c}_set"), F.col(f"{b}.{c}_set")) for c in LISTS)
    return F.round(F.greatest(title, 0.6 * title + 0.2 * theme + 0.1 * entity + 0.1 * action), 4)


def _contradiction(a: str, b: str) -> Column:
    title = T.jaccard(F.col(f"{a}.tokens"), F.col(f"{b}.tokens"))
    theme = T.jaccard(F.col(f"{a}.themes_set"), F.col(f"{b}.themes_set"))
    return F.when((title >= 0.6) & (theme <= 0.15), F.round(title - theme, 4)).otherwise(F.lit(0.0))


for _name, _of in (("entity-alias", _label), ("family-merge", _family), ("action-merge", _label), ("unresolved-merge", _label), ("contradiction", _contradiction)):
    register_similarity(_name, _of)


def suggestions(records: DataFrame, kind: str, decided: DataFrame | None = None, threshold: float | None = None, least_title: float | None = None) -> DataFrame:
    """(review_id, review_type, status, priority, title, left_id, right_id, subject, score) of pairs of different collections.

    Records may have themes, key_entities and actions (arrays), which count in family merges, and entity_type.
    least_title: Jaccard of the title tokens that the similarity implies; by default what the kind's formula implies.
    decided: pairs (left_id, right_id) that aren't suggested again. Records with the same tokens are compared once. Pairs that
    are scored by their labels alone are made where these meet; others come from a join by the tokens.
    """
    threshold = THRESHOLDS[kind] if threshold is None else threshold
    # A family similarity of s needs a title similarity of (s - 0.4) / 0.6 at least; a contradiction one of 0.6.
    least = least_title if least_title is not None else {"family-merge": (threshold - 0.4) / 0.6, "contradiction": max(0.6, threshold)}.get(kind, threshold)
    none = F.expr("cast(array() as array<string>)")
    rows = records.withColumn("tokens", F.sort_array(T.token_set(F.col("label")))).where(F.size("tokens") > 0).withColumn("set_id", F.array_join("tokens", " "))
    least = max(least - 1e-4, 0.01)
    if SIMILARITIES[kind] is _label and "entity_type" in rows.columns:
        # The score needs the sets alone, so a pair is made where they meet; equal labels have equal sets.
        member = F.struct("member_id", "corpus_id", "label", "entity_type", F.size("tokens").alias("n"))
        rows = written(rows.select("set_id", F.col("tokens").alias("items"), F.col("corpus_id").alias("part"), member.alias("member")), "records")
        met = similar_members(rows, least)
        first = F.col("x.member_id") < F.col("y.member_id")
        met = met.where("x.member_id <> y.member_id").select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("l"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("r"), F.round("jaccard", 4).alias("score"))
        same = (F.col("l.n") == 1) & (F.col("score") == 1)
    else:
        rows = written(rows.withColumns({f"{c}_set": T.token_set(F.array_join(F.coalesce(c, none), " ")) if c in rows.columns else none for c in LISTS}), "records")
        sets = rows.select("set_id", F.col("tokens").alias("items")).distinct()
        near = similar_sets(sets, least).select("left_set", "right_set")
        near = near.unionByName(near.select(F.col("right_set").alias("left_set"), F.col("left_set").alias("right_set"))).unionByName(sets.select(F.col("set_id").alias("left_set"), F.col("set_id").alias("right_set")))
        left, right = rows.alias("l"), rows.alias("r")
        met = near.join(left, F.col("left_set") == F.col("l.set_id")).repartition(partitions(rows), "right_set").join(right, (F.col("right_set") == F.col("r.set_id")) & (F.col("l.member_id") < F.col("r.member_id")) & (F.col("l.corpus_id") != F.col("r.corpus_id")))
        met = met.withColumn("score", SIMILARITIES[kind]("l", "r"))
        same = (F.size("l.tokens") == 1) & (F.col("l.tokens") == F.col("r.tokens"))
    met = met.withColumns({"left_id": F.col("l.member_id"), "right_id": F.col("r.member_id")})
    if kind == "entity-alias":
        # Two concepts with the same single token say too little.
        met = met.where(~(same & (F.col("l.entity_type") == "concept") & (F.col("r.entity_type") == "concept")))
    rated = met.where(F.col("score") >= threshold)
    if decided is not None:
        rated = rated.join(decided.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")
    ids = F.array("left_id", "right_id")
    return rated.select(
        T.review_id(kind, ids).alias("review_id"), F.lit(kind).alias("review_type"), F.lit("open").alias("status"),
        F.when(F.col("score") >= max(0.8, threshold + 0.15), "high").otherwise("medium").alias("priority"),
        F.concat_ws(" <> ", "l.label", "r.label").alias("title"), "left_id", "right_id", T.slugify("l.label", 72).alias("subject"), "score",
    )


def stable_ids(suggested: DataFrame) -> DataFrame:
    """Suggestions whose ids are unique: an id that several have gets each one's fingerprint."""
    n = suggested.groupBy("review_id").agg(F.count(F.lit(1)).alias("_n"))
    own = F.concat_ws("-", "review_id", T.fingerprint(F.array("left_id", "right_id")))
    return suggested.join(n, "review_id").withColumn("review_id", F.when(F.col("_n") > 1, own).otherwise(F.col("review_id"))).drop("_n")


def in_order(suggested: DataFrame) -> DataFrame:
    """Suggestions in the order of a queue: high priority first, then by score and id."""
    return suggested.orderBy(F.col("priority") != "high", F.desc("score"), "review_id")


def components(nodes: DataFrame, edges: DataFrame, node: str = "member_id", left: str = "left_id", right: str = "right_id") -> DataFrame:
    """(node, root): root is the smallest name reachable; a node without an edge is its own."""
    found = connected_components(edges.select(F.col(left).alias("a"), F.col(right).alias("b")))
    rows = nodes.select(F.col(node).alias("node")).distinct().join(found, "node", "left")
    return rows.select(F.col("node").alias(node), F.coalesce("root", "node").alias("root"))


def linked_groups(records: DataFrame, threshold: float | None = None) -> DataFrame:
    """(member_id, root) of the components that the entity aliases among records make, without forming their pairs.

    A label's score depends on its tokens alone, so records with the same tokens are one node: they all hang together if
    they lie in two collections or more, or if a near node has a record of another collection. Single
    tokens that concepts have, which don't link two concepts, are nodes by collection and type instead; over a threshold of
    0.5, which it must be, nothing else is near these.
    """
    threshold = THRESHOLDS["entity-alias"] if threshold is None else threshold
    if threshold <= 0.5:
        raise ValueError("a single token may have near sets at this threshold, and its concepts nodes of several kinds")
    concept = F.coalesce(F.col("entity_type") == "concept", F.lit(True))
    tokens = F.sort_array(T.token_set(F.col("label")))
    rows = records.select("member_id", "corpus_id", tokens.alias("items"), concept.alias("concept")).where("size(items) > 0 and corpus_id is not null")
    rows = written(rows.select("member_id", "corpus_id", "items", "concept", F.array_join("items", " ").alias("set_id")), "records")
    sets = written(rows.groupBy("set_id").agg(F.first("items").alias("items"), F.min("member_id").alias("first"), F.min("corpus_id").alias("a"), F.max("corpus_id").alias("z"), F.max("concept").alias("concept")), "nodes")
    near = similar_sets(sets.select("set_id", "items"), max(threshold - 1e-4, 0.01)).where(F.round("jaccard", 4) >= threshold).select("left_set", "right_set")
    ends = [sets.select(F.col("set_id").alias(f"{s}_set"), *(F.col(c).alias(f"{s}_{c}") for c in ("first", "a", "z"))) for s in ("left", "right")]
    met = written(near.join(ends[0], "left_set").join(ends[1], "right_set").where("left_a <> right_z or left_z <> right_a"), "near")
    touched = met.select(F.col("left_set").alias("set_id")).unionByName(met.select(F.col("right_set").alias("set_id"))).distinct()
    doubtful = (F.size("items") == 1) & F.col("concept")
    whole = sets.where(~doubtful & (F.col("a") != F.col("z"))).select("set_id").unionByName(touched).distinct()
    own = rows.join(whole, "set_id", "left_semi").join(sets.select("set_id", "first"), "set_id").select(F.col("first").alias("left_id"), F.col("member_id").alias("right_id"))
    # Of single tokens that concepts have: cells by collection and type, each cell linked to those of other collections.
    cells = written(rows.join(sets.where(doubtful).join(touched, "set_id", "left_anti").select("set_id"), "set_id", "left_semi").groupBy("set_id", "corpus_id", "concept").agg(F.min("member_id").alias("first")), "cells")
    x, y = cells.alias("x"), cells.alias("y")
    crossed = written(x.join(y, "set_id").where("x.corpus_id <> y.corpus_id and not (x.concept and y.concept)").select("set_id", F.col("x.corpus_id").alias("corpus_id"), F.col("x.concept").alias("concept"), F.col("x.first").alias("first"), F.col("y.first").alias("other")), "crossed")
    linked = crossed.select("set_id", "corpus_id", "concept", "first").distinct()
    inner = rows.join(linked, ["set_id", "corpus_id", "concept"]).select(F.col("first").alias("left_id"), F.col("member_id").alias("right_id"))
    edges = met.select(F.col("left_first").alias("left_id"), F.col("right_first").alias("right_id")).unionByName(crossed.select(F.col("first").alias("left_id"), F.col("other").alias("right_id")))
    # Members of a node hang on its first: components of the firsts, then one join.
    found = written(connected_components(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))), "roots")
    members = written(own.unionByName(inner).distinct(), "members")
    of = members.join(found.select(F.col("node").alias("left_id"), "root"), "left_id", "left").select(F.col("right_id").alias("member_id"), F.coalesce("root", "left_id").alias("root"))
    return records.select("member_id").distinct().join(of, "member_id", "left").select("member_id", F.coalesce("root", "member_id").alias("root"))


def canonical_entities(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group: shortest label (then by lower case), most common type, numbers of members and collections."""
    rows = records.join(groups, "member_id")
    kinds = rows.groupBy("root", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("member_id").alias("first"))
    mode = kinds.groupBy("root").agg(F.max_by("entity_type", F.struct("n", F.negative(F.length("first")), F.lit(0))).alias("entity_type"))
    found = rows.groupBy("root").agg(F.min_by("label", F.struct(F.length("label"), F.lower("label"), "label")).alias("label"), F.count(F.lit(1)).alias("members"), F.count_distinct("corpus_id").alias("corpora"), F.count_distinct(F.lower("label")).alias("aliases"))
    return found.join(mode, "root")


def canon_search(queries: DataFrame, docs: DataFrame, limit: int = 6) -> DataFrame:
    """Ranking of canon documents (doc_id, kind, title, text, vector_terms): coverage, vector, phrase and kind bonus."""
    from loomspark.operators.search import features, fixed, ranked

    # Weights, least coverage, bonus by kind.
    bonus = {"federated_family_brief": 0.7, "federated_project_dossier": 0.35, "federated_entity_dossier": 0.15, "federated_action_cluster": 0.25, "federated_unresolved_cluster": 0.2}
    extra = F.lit(0.0)
    for kind, value in bonus.items():
        extra = F.when(F.col("kind") == kind, value).otherwise(extra)
    rows = features(queries.withColumn("tokens", F.filter("tokens", lambda t: F.length(t) > 2)), docs)
    score = 1.8 * F.col("coverage") + 0.7 * F.col("vector_score") + F.when(F.col("phrase") == 1, 0.75).otherwise(0.0) + extra
    scored = rows.where((F.col("coverage") >= 0.25) | (F.col("vector_score") > 0)).withColumn("score", fixed(score))
    return ranked(scored, limit)
