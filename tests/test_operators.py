"""Operators on small fixtures: text, sources, corpus, search, canon, review, evaluation, lifecycle, streams."""

from __future__ import annotations

import datetime
import difflib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import canon, cascade, contracts, corpus, evaluate, federation, lifecycle, neardup, review, search, terms
from loomspark.operators.components import connected_components
from loomspark.sources import exports, markdown, sinks
from loomspark.streaming import ingest


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def texts(spark, column, values):
    return [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string").select("i", column.alias("y")).orderBy("i").collect()]


def test_text_functions(spark):
    assert texts(spark, T.normalize_space("x"), ["  a  b　c\x1c", None, " "]) == ["a b c", "", ""]
    assert texts(spark, T.slugify("x", 8), ["Hello, World!", "---", "abcdefg hij", None]) == ["hello-wo", "query", "abcdefg", "query"]
    assert texts(spark, T.shorten("x", 10), ["short", "a bit longer text"]) == ["short", "a bit l..."]
    assert one(spark, T.tokenize("x"), "The re_use of A b2-b, é x") == ["the", "re_use", "of", "b2-b"]
    assert one(spark, T.split_sentences("x"), "One. Two?\nThree\r\n\nv3.14!") == ["One.", "Two?", "Three", "v3.", "14!"]
    assert one(spark, T.title_case("x"), "v2beta a_b cd") == "V2Beta A_B Cd"
    assert one(spark, T.distinct_ignoring_case(F.array(F.lit("A  b"), F.lit("a b"), F.lit(""), F.lit("c")))) == ["A b", "c"]
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == 0.3333
    assert one(spark, T.trigrams("x"), "about alpha alp") == ["alp", "lph", "pha"]
    assert one(spark, T.strip_uuid_suffix(F.col("x")), "topic-deadbeef") == "topic"
    assert one(spark, T.strip_html("x"), "<p>a &lt;b&gt;c</p><script>x</script><div>d&amp;e</div>") == "a c\nd&e"
    assert one(spark, T.snippet(F.col("x"), F.array(F.lit("needle"))), "w " * 300 + "needle " + "v " * 300).count("needle") == 1
    ids = F.array(F.lit("b:2"), F.lit("a:1"))
    assert one(spark, T.subject_key(ids)) == "a:1::b:2"
    assert one(spark, T.review_id("entity-alias", ids)).startswith("federated-entity-alias-b-2-a-1-")


def test_ledger_sentences(spark):
    said = "We need to build the parser soon. Maybe the index is wrong here? Short one. We NEED to build the parser soon. " + "x" * 300 + " should."
    row = spark.createDataFrame([(1, said)], "id long, text string")
    got = {(r.kind, r.position): r["item"] for r in corpus.ledgers(row, "id", "text").collect()}
    assert got == {("action", 0): "We need to build the parser soon.", ("unresolved", 0): "Maybe the index is wrong here?"}


def test_terms(spark):
    rows = spark.createDataFrame([(1, "beta alpha beta the gamma alpha beta"), (2, ""), (3, None)], "id long, text string")
    got = [(r.token, r.n, r["rank"], r.weight) for r in terms.ranked_terms(rows, "id", "text", 2, T.CHAT_STOP_WORDS).orderBy("rank").collect()]
    assert got == [("beta", 3, 1, 1.0), ("alpha", 2, 2, 0.6667)]
    assert terms.term_maps(rows, "id", "text").count() == 1


def test_pairs(spark):
    rows = [(1, 0, "system", "hidden"), (1, 1, "assistant", "hi"), (1, 2, "user", " q1 "), (1, 3, "assistant", "a1"), (1, 4, "tool", "t"), (1, 5, "assistant", "a2"), (1, 6, "user", ""), (1, 7, "user", "q2"), (2, 0, "assistant", None)]
    said = corpus.retained(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [(r.pair_id, r.prompt, r.response, r.title) for r in corpus.pairs(said).orderBy("pair_index").collect()]
    assert got == [("1-pair-001", "[assistant-led]", "hi", "Assistant-Led Turn"), ("1-pair-002", "q1", "a1 a2", "q1"), ("1-pair-003", "q2", "", "q2")]
    assert corpus.pairs(said, any_responder=True).where("prompt = 'q1'").first().response == "a1 t a2"
    audit = {r.thread: r for r in corpus.audit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (audit[1].message_count, audit[1].retained_count, audit[1].skipped_count, audit[1].quality_flags) == (8, 6, 1, "")
    assert audit[2].retention_ratio == 0.0


def test_near_duplicates(spark):
    a = "please build the alpha parser for the registry today"
    rows = [(1, a), (2, a + "!"), (3, "something else entirely about gardens and rivers"), (4, "short"), (5, "short")]
    got = [(r.left_key, r.right_key, r.similarity) for r in neardup.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()]
    assert got == [(1, 2, round(difflib.SequenceMatcher(None, a, a + "!").ratio(), 4))]


def test_trigram_join_is_whole(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.left("text", F.lit(200)).alias("t")).where("doc_id < 120")
    sets = {r.doc_id: set(r.g) for r in rows.select("doc_id", T.trigrams("t").alias("g")).collect() if r.g}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.35}
    assert {(r.left_key, r.right_key) for r in neardup.trigram_pairs(rows, "doc_id", "t").collect()} == want


def documents(spark):
    rows = [
        ("family:f1", "family_brief", "family", "Alpha registry", "alpha registry notes", {"alpha": 1.0}, "f1", "t1", True),
        ("family:f2", "family_brief", "family", "Beta stream", "beta stream notes", {"beta": 1.0}, "f2", "t2", True),
        ("thread:t1", "thread", "thread", "Alpha registry", "how the alpha registry works", {}, "f1", "t1", True),
        ("thread:t2", "thread", "thread", "Beta stream", "beta and alpha", {}, "f2", "t2", True),
        ("pair:p1", "pair", "pair", "alpha?", "alpha registry action answer", {"alpha": 0.5}, "f1", "t1", False),
        ("action:a1", "action", "ledger", "Build the alpha registry", "Build the alpha registry", {}, "f1", "t1", False),
    ]
    return spark.createDataFrame(rows, "doc_id string, kind string, grp string, title string, text string, vector_terms map<string,double>, family_id string, thread string, canonical boolean")


def test_cascade(spark):
    queries = spark.createDataFrame([(1, "Alpha registry"), (2, "nothing known"), (3, "alpha")], "query_id long, query string")
    found = cascade.cascade(queries, documents(spark))
    best = {r.query_id: r.doc_id for r in found.hits.where("rank = 1").collect()}
    assert set(best) == {1, 3} and all(x.endswith("1") for x in best.values())
    assert {r.query_id: r.doc_id for r in found.family.where("rank = 1").collect()} == {1: "family:f1", 3: "family:f1"}
    states = {r.query_id: (r.state, r.confidence) for r in cascade.answer_states(found, queries).collect()}
    assert states[1][0] == "grounded" and states[1][1] > 0.8 and states[2] == ("abstain", 0.2)
    # An exact title: 1.9 * (1.6 + 0.9 + 0.35 + 0.6 + 0.8 + 0.25) with half the vector, then matched, title and support bonuses.
    first = found.family.where("query_id = 1 and rank = 1").first()
    base = round(round(1.6 + 0.9 + 0.35 + 0.6 * 1.0 + 0.8 + 0.25, 4) * 1.9, 4)
    assert first.score == pytest.approx(round(base + max(max(2.5, 0.6 * base) + 0.8, base + 2.0) + 0.45, 4))
    cited = {r.query_id: r.citations for r in cascade.citations(cascade.primary_evidence(found), cascade.answer_states(found, queries)).collect()}
    assert cited[2] == [] and cited[1][:2] == ["family:f1", "thread:t1"] and len(cited[1]) <= 4
    ledger = cascade.cascade(queries, documents(spark), mode="action").hits.collect()
    assert {r.kind for r in ledger} == {"action"}
    assert cascade.cascade(queries.where("false"), documents(spark)).hits.count() == 0


def test_select_corpus(spark):
    a, b = documents(spark).withColumn("corpus_id", F.lit("a")), documents(spark).where("family_id = 'f2'").withColumn("corpus_id", F.lit("b"))
    queries = spark.createDataFrame([(1, "Alpha registry"), (2, "Beta stream")], "query_id long, query string")
    found = cascade.cascade(queries, a.unionByName(b), by=["query_id", "corpus_id"])
    corpora = spark.createDataFrame([("a", False, "pass"), ("b", True, "pass")], "corpus_id string, is_default boolean, gate_state string")
    got = {r.query_id: r.corpus_id for r in cascade.select_corpus(found, corpora).where("place = 1").collect()}
    assert got == {1: "a", 2: "b"}


def test_expand_and_support(spark):
    assert one(spark, search.expand_tokens(search.query_tokens(F.col("x"))), "The duplicate alias") == ["duplicate", "alias", "same", "merge"]
    found = search.substring_pairs(spark.createDataFrame([("al",), ("lph",), ("x",), ("",), ("alphabet",)], "p string"), spark.createDataFrame([("alpha",), ("max",), ("alphabets",)], "x string"))
    assert sorted(map(tuple, found.collect())) == [("al", "alpha"), ("al", "alphabets"), ("alphabet", "alphabets"), ("lph", "alpha"), ("lph", "alphabets"), ("x", "max")]


def records(spark):
    rows = [("a", "a:1", "Alpha registry tool", "concept"), ("b", "b:1", "alpha Registry tool", "concept"), ("b", "b:2", "Alpha", "concept"), ("c", "c:1", "Alpha", "concept"), ("c", "c:2", "registry tool for alpha", "concept"), ("a", "a:2", "other thing", "concept")]
    return spark.createDataFrame(rows, "corpus_id string, member_id string, label string, entity_type string")


def test_suggestions_and_groups(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "c")]
    assert sorted((r.node, r.root) for r in connected_components(spark.createDataFrame([*pairs, ("b", "d"), (None, "x")], "a string, b string")).collect()) == [("a", "a"), ("b", "a"), ("d", "a")]
    got = {(r.left_id, r.right_id): (r.score, r.priority) for r in canon.suggestions(records(spark), "entity-alias").collect()}
    assert got == {("a:1", "b:1"): (1.0, "high"), ("a:1", "c:2"): (0.75, "medium"), ("b:1", "c:2"): (0.75, "medium")}
    decided = spark.createDataFrame([("a:1", "b:1")], "left_id string, right_id string")
    assert canon.suggestions(records(spark), "entity-alias", decided).count() == 2
    accepted = spark.createDataFrame([(1, ["a:1", "b:1"], "alpha-tool"), (2, ["b:2", "c:1"], ""), (3, ["gone:1", "a:2"], "x")], "decision_id long, subject_ids array<string>, canonical_subject string")
    groups = federation.decision_groups(records(spark), accepted, "entity")
    ids = {r.member_id: r.group_id for r in groups.collect()}
    assert ids["a:1"] == ids["b:1"] == "alpha-tool" and ids["b:2"] == ids["c:1"] == "entity-b-2-c-1" and ids["a:2"] == "entity-a-2"
    families = federation.canonical_families(records(spark).withColumn("themes", F.split("label", " ")), groups)
    assert {r.group_id: r.member_count for r in families.collect()}["alpha-tool"] == 2
    report = federation.conflict_report(canon.suggestions(records(spark).withColumn("themes", F.array(F.col("corpus_id"))), "contradiction"), families).first()
    assert (report.potential_conflicts, report.shared_families) == (4, 2)


def test_review_state(spark):
    queue = spark.createDataFrame([("r1", "open", "a:1", "b:1", "s"), ("r2", "accepted", "a:2", "b:2", "t")], "review_id string, status string, left_id string, right_id string, subject string")
    said = spark.createDataFrame([("r1", "deferred", "", "1"), ("r1", "rejected", "", "2"), ("r2", "rejected", "", "3")], "review_id string, decision string, note string, at string")
    done, decisions = federation.resolve(queue, said)
    assert {r.review_id: r.status for r in done.collect()} == {"r1": "rejected", "r2": "accepted"}
    assert [(r.review_id, r.verdict) for r in decisions.collect()] == [("r1", "rejected")]
    again = federation.carry_over(queue.where("review_id = 'r1'").drop("status"), done)
    assert {r.review_id: r.status for r in again.collect()} == {"r1": "rejected", "r2": "accepted"}


def test_triage_and_packets(spark):
    rows = [
        ("entity-alias", "x <> y", "a:same", "b:same", "exact-cross-corpus"), ("family-merge", "x <> y", "a:family-one-0123abcd", "b:family-one-89abcdef", "slug-match"),
        ("entity-alias", "big red house <> red big home", "a:entity-1", "b:entity-2x", "entity-title-overlap"), ("family-merge", "big red house <> red big home", "a:f1", "b:f2", "manual"),
        ("family-merge", "big red house <> red big", "a:f1", "b:f2", "family-title-overlap"), ("action-merge", "write new docs <> new docs write", "a:1", "b:2", "action-title-overlap"),
        ("unresolved-merge", "what new docs <> new docs", "a:1", "b:2", "unresolved-title-overlap"), ("entity-alias", "abc <> def", "a:entity-alpha", "b:entity-alpha-tool", "prefix-entity-alias"),
        ("entity-alias", "abc <> def", "a:entity-null", "b:entity-x1y2", "noise-entity"), ("entity-alias", "abc <> def", "a:entity-ab", "b:entity-x1y2", "short-entity"),
        ("entity-alias", "house <> old red house", "a:entity-one", "b:entity-two", "generic-singleton-entity"), ("contradiction", "x <> y", "a:1", "b:2", "contradiction-defer"),
        ("entity-alias", "abcd <> wxyz", "a:entity-abcd", "b:entity-wxyz", "manual"), ("entity-alias", "big red house <> red big home", "a:entity-111", "a:entity-222", "manual"),
    ]
    items = spark.createDataFrame([(f"r{i:02}", *r[:4], "open", 0.5, "sub") for i, r in enumerate(rows)], "review_id string, review_type string, title string, left_id string, right_id string, status string, score double, subject string")
    plan = review.triage(items)
    assert [r.policy for r in plan.orderBy("review_id").collect()] == [r[4] for r in rows]
    done, decisions, skipped = review.apply_triage(items.unionByName(items.where("review_id = 'r00'")), plan.unionByName(plan.where("review_id = 'r00'").withColumn("review_id", F.lit("gone"))), "now")
    assert done.where("status = 'open'").count() == 3 and done.where("status = 'accepted'").count() == 8
    assert decisions.count() == 10 and [r.review_id for r in skipped.collect()] == ["gone"]
    said = ["Rejected - no", "reject: why", "False positive", "needs context", "deferred for now", "", None, "nothing to add", "no", "skip", "keeper"]
    assert texts(spark, review.outcome(F.col("x")), said) == ["reject", "reject", "keep", "needs-context", "needs-context", "", "", "nothing to add", "no", "pending", "keeper"]
    groups = spark.createDataFrame([("a", 20), ("b", 10), ("c", 10), ("d", 30)], "anchor string, item_count long")
    assert {r.anchor: r.batch for r in review.batches(groups).collect()} == {"d": 1, "a": 2, "b": 3, "c": 3}
    sizes = [((i * 37) % 11) + 1 for i in range(60)] + [26, 40]
    groups = spark.createDataFrame([(f"g{i:02}", n) for i, n in enumerate(sizes)], "anchor string, item_count long")
    want, batch, used = {}, 1, 0
    for n, anchor in sorted(((-n, f"g{i:02}") for i, n in enumerate(sizes))):
        if used and used - n > 25:
            batch, used = batch + 1, 0
        want[anchor], used = batch, used - n
    assert {r.anchor: r.batch for r in review.batches(groups).collect()} == want
    with pytest.raises(ValueError, match="no batch"):
        review.one_batch(review.batches(groups), 999)
    assert texts(spark, F.array_join(review.label_signals(F.col("x")), ","), ["Overview", "misc", "a1", "12345678", "ab", "plain words", ""]) == ["heading-like-label", "placeholder-like-label", "numeric-or-code-label", "numeric-or-code-label", "short-fragment-label", "", ""]
    assert texts(spark, review.humanized(F.col("x")), ["entity-big-red", "plain"]) == ["big red", "plain"]


def test_evaluation(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    r = evaluate.precision_recall(a, b, "k").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 1, 0.5, 0.5)
    assert evaluate.precision_recall(a.where("false"), b.where("false"), "k").first().precision is None
    fixtures = spark.createDataFrame([("x", "seeded", 3, False), ("x", "manual", 0, True), ("y", "legacy", 2, False), ("y", "manual", 0, False)], "kind string, source string, rows long, reviewed_none boolean")
    assert {r.kind: r.source for r in evaluate.preferred(fixtures).collect()} == {"x": "manual", "y": "legacy"}
    metrics = spark.createDataFrame([("family_stability.exact_member_match_rate", 1.0), ("retrieval_metrics.pair_hit_at_3", 0.3), ("answer_metrics.forbidden_citation_violation_rate", 0.1), ("retrieval_metrics.family_hit_at_1", 0.7)], "metric string, value double")
    states = evaluate.gates(metrics)
    assert {r.metric.split(".")[1]: r.state for r in states.where("state <> 'skip'").collect()} == {"exact_member_match_rate": "pass", "pair_hit_at_3": "warn", "forbidden_citation_violation_rate": "warn", "family_hit_at_1": "fail"}
    assert states.count() == 8 and evaluate.overall(states).first().overall == "fail"
    sources = spark.createDataFrame([(k, "manual") for k in evaluate.FIXTURES], "kind string, source string")
    good = evaluate.gates(metrics.limit(1))
    assert [evaluate.overall(good, sources=x).first().overall for x in (sources, sources.limit(3))] == ["pass", "warn"]
    corpora = spark.createDataFrame([("a", "pass", "fresh", True), ("b", "warn", None, True)], "corpus_id string, evaluation_state string, freshness string, valid_contract boolean")
    summary = evaluate.replay_summary(evaluate.replay_cases(corpora))
    assert {r.threshold: r.state for r in evaluate.policy_gates(summary, evaluate.normalized_policy(spark, {"max_warn_corpora": 1})).collect()} == {"max_fail_corpora": "pass", "max_warn_corpora": "pass", "max_stale_corpora": "fail", "max_missing_contract_corpora": "pass", "min_manual_pass_rate": "fail", "min_registered_active_corpora": "pass"}
    with pytest.raises(ValueError, match="unknown"):
        evaluate.normalized_policy(spark, {"max_other": 1})
    live, new = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string"), spark.createDataFrame([("b", "z"), ("c", "w")], "k string, v string")
    delta = evaluate.keyed_delta(live, new, "k", "v")
    d = delta.first()
    assert (d.shared, d.added, d.removed, d.relabelled, d.first_added, d.first_removed) == (1, 1, 1, 1, "c", "a")
    gate = evaluate.overall(spark.createDataFrame([("pass",), ("skip",)], "state string"))
    assert evaluate.verdict(delta, gate).first().recommendation == "review"


def test_registry(spark):
    schema = "corpus_id string, status string, is_default boolean"
    registry = spark.createDataFrame([("a", "active", True), ("b", None, False), ("c", "retired", True)], schema)
    got = {r.corpus_id: r.is_default for r in federation.register(registry, spark.createDataFrame([("d", "active", True)], schema)).collect()}
    assert got == {"a": False, "b": False, "c": False, "d": True}
    ledger = spark.createDataFrame([("a", None, "Alpha"), (None, ["a", "b"], "beta"), ("b", None, "alpha")], "corpus_id string, corpus_ids array<string>, title string")
    assert federation.query_index(ledger, "ALPHA", "a").count() == 1
    assert federation.query_index(ledger, None, "a").count() == 2
    assert federation.query_index(ledger, limit=1).count() == 1


def test_lifecycle(spark):
    listed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "id string, stamp string")
    prior = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "id string, stamp string")
    assert {r.id: r.action for r in lifecycle.delta(listed, prior, "id", "stamp").collect()} == {"a": "reuse", "b": "fetch", "c": "fetch"}
    assert lifecycle.scope_check(listed.limit(1), prior, "id").first().allowed is False
    assert one(spark, lifecycle.transition(F.lit("staged"), F.lit("promoted"))) is False
    assert one(spark, lifecycle.transition(F.lit("approved"), F.lit("promoted"))) is True
    old = spark.createDataFrame([("p", "queued", "n1"), ("q", "done", "n2")], "id string, state string, name string")
    merged = lifecycle.merge_registry(old, spark.createDataFrame([("p", "new name"), ("r", "n3")], "id string, name string"), "id", ["state"])
    assert {tuple(r) for r in merged.collect()} == {("p", "queued", "new name"), ("q", "done", "n2"), ("r", None, "n3")}
    items = spark.createDataFrame([("old-1", "x"), ("y", "y")], "rid string, v string")
    fresh, mapping = lifecycle.migrate_ids(items, "rid", F.col("v"))
    assert mapping.count() == 1 and lifecycle.migrate_ids(fresh, "rid", F.col("v"))[1].count() == 0


def test_chat_exports(spark, tmp_path):
    node = lambda i, role, t, kind="text", parts=None, **more: {"id": i, "parent": None, "children": [], "message": {"id": i, "author": {"role": role}, "create_time": t, "content": {"content_type": kind, "parts": parts, **more}}}
    nodes = [node("s", "system", 0.0, parts=["hidden"]), node("u", "user", 1.0, parts=["Hello  there"]), node("c", "assistant", 2.0, "code", text="x = 1", language="py"), node("i", "user", 3.0, "multimodal_text", parts=["see", json.dumps({"content_type": "image_asset_pointer", "width": 4, "height": 5})]), node("t", "tool", 4.0, "execution_output", text="ok"), node("h", "assistant", 5.0, "thoughts", parts=["no"])]
    conv = {"title": None, "conversation_id": "c1", "mapping": {n["id"]: n for n in nodes} | {"e": {"id": "e", "parent": None, "children": [], "message": None}}}
    (tmp_path / "a.json").write_text(json.dumps([conv]))
    got = [(r.turn, r.role, r.text) for r in exports.mapping_messages(exports.json_table(spark, str(tmp_path / "a.json"), exports.MAPPING)).orderBy("turn").collect()]
    assert got == [(0, "user", "Hello there"), (1, "assistant", "```py x = 1 ```"), (2, "user", "see [Image: 4x5]"), (3, "tool", "[Execution output: ok]"), (4, "assistant", "")]
    assert exports.json_table(spark, str(tmp_path / "none.json"), exports.MAPPING).count() == 0
    listed = {"uuid": "u1", "name": "n", "chat_messages": [{"sender": "human", "created_at": "2024-01-02", "text": "q", "content": [{"type": "text", "text": "q"}], "attachments": [{"file_name": "f.txt"}]}, {"sender": "assistant", "created_at": "2024-01-01", "text": "", "content": [{"type": "tool_result", "content": "OK"}, {"type": "code", "text": "y", "language": "js"}]}]}
    (tmp_path / "b.json").write_text(json.dumps([listed]))
    got = [(r.turn, r.role, r.text) for r in exports.list_messages(exports.json_table(spark, str(tmp_path / "b.json"), exports.MESSAGES)).orderBy("turn").collect()]
    assert got == [(0, "assistant", "[tool_result:tool] ```js y ```"), (1, "user", "q [attachment:f.txt]")]
    doc = {"metadata": {"title": "t", "link": "https://x/c/0123abcd-ef", "dates": {"created": "1/3/2026 7:53:47", "updated": ""}}, "messages": [{"role": "You", "say": "hi"}, {"role": "ai", "say": " "}, {"role": "AI", "say": "yes"}]}
    (tmp_path / "c.json").write_text(json.dumps([doc]))
    got = [(r.conversation_id, r.role, r.text, r.create_time) for r in exports.exporter_messages(exports.json_table(spark, str(tmp_path / "c.json"), exports.EXPORTER), F.lit("f")).orderBy("turn").collect()]
    base = datetime.datetime(2026, 1, 3, 7, 53, 47, tzinfo=datetime.UTC).timestamp()
    assert got == [("0123abcd-ef", "user", "hi", base), ("0123abcd-ef", "assistant", "yes", base + 2)]
    parts = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "id string, part long")
    assert sorted(r.part for r in exports.keep_first(parts, "id", ["part"]).collect()) == [1, 3, 4]


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.md": "# Master Plan\ntext", "b.html": "<p>one</p><p>two</p>", "c.json": '{"title": "T", "x": {"y": [1, "", null]}}', "sub/d.csv": "a, b\n,c\n", "e.txt": "  ", ".hidden.md": "no", "f.bin": "no"}.items():
        (tmp_path / name).write_text(body)
    got = {r.path.rsplit("/", 1)[1]: (r.title, r.text) for r in exports.documents(exports.files(spark, str(tmp_path))).collect()}
    assert got == {"a.md": ("Master Plan", "# Master Plan\ntext"), "b.html": ("B", "one\ntwo"), "c.json": ("T", "title: T\nx.y[0]: 1"), "d.csv": ("D", "a | b\nc")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("../evil.md", "x")
    with pytest.raises(ValueError, match="outside"):
        exports.unpack(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    spark.udtf.register("flatten_json", exports.FlattenJson)
    assert [r.line for r in spark.sql("""SELECT line FROM flatten_json('{"a": [true, {"b": 2}]}')""").collect()] == ["a[0]: True", "a[1].b: 2"]


def test_markdown(spark):
    text = "Q: what\n| a | b | c |\n=====\n# Title\nWe should write [the docs](http://x) this week.\n> quoted **bold** line"
    assert one(spark, markdown.clean(F.col("x")), text) == "Title\nWe should write the docs this week.\nquoted bold line"
    assert one(spark, markdown.candidates(F.col("x")), "Short. We should write the documentation now! See http://example.com for the whole story.") == ["We should write the documentation now!"]


def test_contracts(spark):
    assert list(contracts.issues({"version": True, "mode": "x"}, contracts.SCHEMAS["promotion-policy"])) == [("$.thresholds", "is missing"), ("$.version", "is not of type integer")]
    assert list(contracts.issues([{"a": 1}, 2], {"items": {"type": "object", "properties": {"a": {"enum": [2]}}}})) == [("$[0].a", "is none of [2]"), ("$[1]", "is not of type object")]
    registry = spark.createDataFrame([("a", "active", True)], "corpus_id string, status string, is_default boolean")
    payload = contracts.manifest(spark, registry, "2024-01-01")
    assert contracts.schema_issues(payload, "surface-manifest").count() == 0
    assert contracts.schema_issues(spark.createDataFrame([("x", "{")], "id string, payload string"), "surface-manifest").first().message == "is not JSON"
    policy = spark.createDataFrame([("chatgpt", "manual", "p1", "f1"), ("claude", None, "p2", "f2")], "provider string, decision string, primary_corpus_id string, fallback_corpus_id string")
    got = {r.provider: (r.corpus_id, r.role) for r in contracts.targets(contracts.providers(spark), policy, registry).collect()}
    assert got["chatgpt"] == ("p1", "primary") and got["claude"] == ("f2", "fallback") and got["grok"] == (None, "primary")


def test_streams_and_sinks(spark, tmp_path, small):
    rows = spark.read.parquet(f"{small}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.keep_state(ingest.events(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp"), "user_id", "ts", "event_id").awaitTermination()
    want = sorted(map(tuple, evaluate.latest(rows, "user_id", "ts", "event_id").select("user_id", "event_id").collect()))
    assert sorted((r.user_id, r.event_id) for r in sinks.read_table(spark, str(tmp_path / "state")).collect()) == want
    stream = ingest.windowed(ingest.events(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == rows.count()
    sinks.append_history(rows.limit(2), str(tmp_path / "history"))
    sinks.append_history(rows.limit(1), str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 3
    assert sinks.read_table(spark, str(tmp_path / "table")) is None
    for n in (3, 1, 2):
        sinks.replace_table(rows.limit(n), str(tmp_path / "table"))
        assert sinks.read_table(spark, str(tmp_path / "table")).count() == n
    assert len(list((tmp_path / "table").glob("v-*"))) == 2
    sinks.write_text(spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string"), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a", "b"]
    assert json.loads(sinks.payload(rows.limit(1)).first().payload)["event_id"] is not None


def test_trees(spark, tmp_path):
    nodes = [("r", None, ["a", "b"]), ("b", "r", ["c"]), ("a", "r", None), ("c", "b", ["gone"]), ("s", None, [])]
    assert exports.depth_first(nodes) == ["r", "a", "b", "c", "s"]
    told = {i: {"id": i, "parent": p, "children": c or [], "message": {"id": i, "author": {"role": "user"}, "create_time": 1.0, "content": {"content_type": "text", "parts": [i]}}} for i, p, c in nodes}
    (tmp_path / "a.json").write_text(json.dumps([{"conversation_id": "x", "mapping": told}]))
    rows = exports.json_table(spark, str(tmp_path / "a.json"), exports.MAPPING)
    assert [r.text for r in exports.mapping_messages(rows).orderBy("turn").collect()] == ["r", "a", "b", "c", "s"]
    assert texts(spark, exports.iso_time(F.col("x").cast("double"), F.lit("now")), ["0", "1700000000.5", None]) == ["1970-01-01T00:00:00+00:00", "2023-11-14T22:13:20.500000+00:00", "now"]


def test_canon_orchestration(spark):
    told = records(spark).withColumns({"themes": F.split(F.lower("label"), " "), "text": F.col("label"), "status": F.lit(None).cast("string"), "why": F.lit("")})
    accepted = spark.createDataFrame([("family-merge", ["b:1", "a:1"], "alpha"), ("entity-alias", ["a:1", "b:1"], "")], "review_type string, subject_ids array<string>, canonical_subject string")
    rejected = spark.createDataFrame([(["a:1", "c:2"],)], "subject_ids array<string>")
    prior = spark.createDataFrame([("gone", "family-merge", "rejected")], "review_id string, review_type string, status string")
    built = federation.build_canon({k: told for k in ("entity", "family", "action", "unresolved")}, accepted, rejected, prior)
    queue = {(r.review_type, r.left_id, r.right_id) for r in built["queue"].where("status = 'open'").collect()}
    assert not {x[1:] for x in queue} & {("a:1", "b:1"), ("a:1", "c:2")} and ("family-merge", "b:1", "c:2") in queue
    assert built["queue"].where("review_id = 'gone'").count() == 1
    brief = built["briefs"].where("group_id = 'alpha'").first().brief_text
    assert brief.endswith("spans 2 corpora and 2 family members. Stable themes: alpha, registry, tool. Corpora: a, b.")
    assert built["actions"].first().status == "open" and built["entities"].where("members = 2").count() == 1
    aliases = federation.canonical_aliases(told, built["entity_groups"], built["entities"])
    assert aliases.count() == 1
    docs = spark.createDataFrame([("d", "federated_action_cluster"), ("e", "federated_entity_dossier")], "doc_id string, kind string")
    assert [r.doc_id for r in federation.of_mode(docs, "action").collect()] == ["d"] and federation.of_mode(docs, None).count() == 2
    assert one(spark, federation.corpora_of({"corpus_ids": F.array(F.lit("a"), F.lit("")), "source_corpora": F.array(F.lit("b"), F.lit("a"))})) == ["a", "b"]
    families = spark.createDataFrame([("a", "f1", "Alpha", "t1"), ("a", "f2", "Beta", None)], "corpus_id string, family_id string, title string, thread string")
    dossiers = spark.createDataFrame([("a", "f1", ["x"], ["E"], ["do it"], [])], "corpus_id string, family_id string, themes array<string>, entities array<string>, actions array<string>, unresolved array<string>")
    got = {r.member_id: (r.text, r.actions) for r in federation.family_records(families, dossiers, families.select("corpus_id", "family_id", F.lit("brief").alias("text")).limit(1)).collect()}
    assert got["a:f1"][1] == ["do it"] and got["a:f2"][1] == [] and got["a:f1"][0].startswith("Alpha x E")


def test_registry_choice(spark):
    registry = spark.createDataFrame([("a", "active", False, "/a"), ("b", "active", True, "/b"), ("c", "retired", False, "/c")], "corpus_id string, status string, is_default boolean, root string")
    assert [federation.live_entry(registry, *x).first().corpus_id for x in ((), ("a",), (None, [None, "c", "a", "b"]))] == ["b", "a", "a"]
    for bad in (("c",), (None, ["zz"])):
        with pytest.raises(ValueError, match="no active"):
            federation.live_entry(registry, *bad)
    s = federation.snapshot(registry).first()
    assert (s.corpora, s.active, s.default_corpus) == (3, 2, "b")
    targets = spark.createDataFrame([("a", "/a"), ("new", "/b"), ("zz", "/z")], "corpus_id string, root string")
    got = {r.corpus_id: (r.registered, r.is_default, r.has_contract) for r in federation.inspected(targets, registry, targets.where("corpus_id = 'a'")).collect()}
    assert got == {"a": (True, False, True), "new": (True, True, False), "zz": (False, False, False)}


def test_small_values(spark):
    assert texts(spark, evaluate.metric(F.col("x"), "a.b"), ['{"a": {"b": 0.5}}', '{"a": {"b": "x"}}', '{"a": 1}', "{}"]) == [0.5, None, None, None]
    assert one(spark, evaluate.normalized_pair(F.array(F.lit("B"), F.lit(""), F.lit("a"), F.lit("b")), labels=True)) == ["a", "b"]
    assert one(spark, evaluate.normalized_pair(F.array(F.lit("a"), F.lit("a")))) is None
    counts = spark.createDataFrame([("x", 1), ("y", 2)], "key string, n long")
    assert sorted(map(tuple, evaluate.merged_counts(counts, counts.limit(1)).collect())) == [("x", 2), ("y", 2)]
    live = evaluate.normalized_policy(spark)
    diff = evaluate.policy_diff(live, spark.createDataFrame([("max_warn_corpora", 2.0), ("new", 1.0)], "threshold string, bound double"))
    assert {r.threshold: (r["from"], r.to, r.delta) for r in diff.collect()} == {"max_warn_corpora": (0.0, 2.0, 2.0), "new": (None, 1.0, None)}
    listing = spark.createDataFrame([("a.md",), ("s/b.md",), ("s/Attachments/c.png",), ("Cookies",), ("x.json",), ("a.md",)], "path string")
    found = {a: sorted(r.path for r in lifecycle.source_files(listing, a).collect()) for a in ("markdown-document", "markdown-transcript", "claude-local-session", "claude-export", "other")}
    assert found == {"markdown-document": ["a.md", "s/b.md"], "markdown-transcript": ["a.md", "s/Attachments/c.png", "s/b.md"], "claude-local-session": ["Cookies"], "claude-export": ["x.json"], "other": []}
    assert [r.path for r in lifecycle.source_files(listing, "markdown-document", top_level=True).collect()] == ["a.md"]
    assert [r.root for r in lifecycle.attachment_roots(listing).collect()] == ["s/Attachments"]
    policies = lifecycle.source_policy(spark.createDataFrame([("a/b", "/c"), (None, "")], "primary_root string, fallback_root string"), "/w/")
    assert [tuple(r) for r in policies.collect()] == [("/w/a/b", "/c"), (None, "")]
    candidates = spark.createDataFrame([("c1", "staged"), ("c2", "rejected")], "candidate_id string, status string")
    assert {r.candidate_id: r.status for r in lifecycle.candidate_transition(candidates, "c1", "approved", "now").collect()} == {"c1": "approved", "c2": "rejected"}
    for bad in (("c2", "approved"), ("c1", "promoted"), ("zz", "approved")):
        with pytest.raises(ValueError):
            lifecycle.candidate_transition(candidates, *bad, "now")
    tagged = texts(spark, F.array_join(markdown.tags(F.col("x"), F.lit("A branch"), F.array(F.lit("plan"))), ","), ["## Q: x\n## A: y", "```x"])
    assert tagged == ["markdown-import,markdown-document,q-and-a,planning,branch-export", "markdown-import,markdown-document,code-heavy,planning,branch-export"]
    assert one(spark, markdown.ledger(F.col("x")), "We should write the documentation now! Minimize the number of open tabs. Nothing to see in this one here.") == ["We should write the documentation now!", "Minimize the number of open tabs."]
    assert one(spark, markdown.ledger(F.col("x"), unresolved=True), "Is this the question that stays? The decision remains with the board of owners.") == ["Is this the question that stays?", "The decision remains with the board of owners."]


def test_cli(capsys, tmp_path):
    from loomspark import cli

    assert cli.main(["queries"]) == 0 and "pair_search_topk" in capsys.readouterr().out
    (tmp_path / "p.json").write_text("{}")
    assert cli.main(["validate", "promotion-policy", str(tmp_path / "p.json")]) == 1
