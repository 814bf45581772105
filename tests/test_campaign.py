"""Gold, campaigns and corpus folders on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomspark.operators import campaign, cascade, gold, review
from loomspark.sources import corpora


def test_gold(spark):
    families = spark.createDataFrame([("f1", "Alpha registry", "t1", ["alpha", "registry", "x"])], "family_id string, title string, thread string, themes array<string>")
    pairs = spark.createDataFrame([("p2", "t1", "later words"), ("p1", "t1", "how does the alpha registry store entries")], "pair_id string, thread string, search_text string")
    entities = spark.createDataFrame([("f1", 1, "Store"), ("f1", 0, "Alpha"), ("f1", 2, "No")], "family_id string, position int, label string")
    got = {r.scenario: r["query"] for r in gold.seed_retrieval(families, pairs, entities).collect()}
    assert got == {"canonical-title": "Alpha registry", "stable-themes": "alpha registry", "pair-evidence": "alpha registry store entries", "entity-focus": "Alpha Store", "abstention": gold.ABSTENTION}
    actions = spark.createDataFrame([("f1", "build")], "family_id string, item_key string")
    answers = gold.seed_answers(families, actions).collect()
    assert answers[0].required == ["family:f1", "thread:t1", "action:build"] and answers[0].least == 3 and answers[1].expected_state == "abstain"
    docs = spark.createDataFrame([("family:f1", "family_brief", "family", "Alpha registry", "notes", {"alpha": 1.0}, "f1", "t1", True), ("thread:t1", "thread", "thread", "Alpha registry", "alpha registry", {}, "f1", "t1", True), ("pair:p1", "pair", "pair", "alpha", "alpha registry store", {}, "f1", "t1", False)], "doc_id string, kind string, grp string, title string, text string, vector_terms map<string,double>, family_id string, thread string, canonical boolean")
    fixtures = gold.seed_retrieval(families, pairs, entities).withColumn("query_id", F.monotonically_increasing_id())
    fixtures = spark.createDataFrame(fixtures.collect(), fixtures.schema)
    found = cascade.cascade(fixtures.select("query_id", "query"), docs)
    metrics = {r.metric: r.value for r in gold.retrieval_metrics(fixtures, found).collect()}
    assert metrics == {f"{s}_hit_at_{n}": 1.0 for s in ("family", "thread", "pair") for n in (1, 3)}
    wanted = gold.seed_answers(families, actions.where("false")).withColumn("query_id", F.when(F.col("expected_state") == "abstain", 2).otherwise(1))
    wanted = spark.createDataFrame(wanted.collect(), wanted.schema)
    found = cascade.cascade(wanted.select("query_id", "query"), docs)
    evidence = cascade.primary_evidence(found)
    rates = gold.answer_metrics(wanted, cascade.citations(evidence, cascade.answer_states(found, wanted)), evidence).first()
    assert (rates.fixture_count, rates.state_match_rate, rates.required_citation_coverage_avg, rates.forbidden_citation_violation_rate, rates.evidence_minimum_pass_rate, rates.abstention_match_rate) == (2, 1.0, 1.0, 0.0, 1.0, 1.0)
    titles = spark.createDataFrame([("a", 0, "One"), ("a", 1, "Two"), ("b", 0, "One")], "source string, pos int, title string")
    assert [r["query"] for r in gold.representative_queries(titles, titles, 2).collect()] == ["One", "Two"]
    a = spark.createDataFrame([("f", ["t1", "t2"])], "family_id string, thread_uids array<string>")
    assert gold.jaccard_families(a, spark.createDataFrame([("f", ["t1", "t2"]), ("g", ["t3"])], a.schema)).first().mean_jaccard == 0.5


def test_campaign(spark):
    groups = spark.createDataFrame([("a", 2, 2, 0, 0, 0, 0), ("b", 1, 0, 1, 1, 1, 0), ("c", 1, 0, 1, 1, 0, 1), ("d", 2, 1, 0, 0, 0, 0)], "anchor string, item_count int, exactish int, disjoint int, zero_overlap int, high_score int, low_specificity int")
    guided = campaign.guidance(groups)
    assert {r.anchor: r.bucket for r in guided.collect()} == {"a": "alias-check", "b": "needs-context", "c": "likely-reject", "d": "mixed-review"}
    proposed = {r.anchor: (r.assistant_outcome, r.assistant_confidence) for r in campaign.propose(guided).collect()}
    assert proposed == {"a": ("keep", "medium"), "b": ("needs-context", "medium"), "c": ("reject", "high"), "d": ("needs-context", "low")}
    items = [(f"r{i}", "entity-alias", "open", f"left{i} <> right{i}", f"a:entity-left{i}", f"b:entity-right{i}", f"left{i}", 0.8 if i % 2 else 0.95, "high") for i in range(130)]
    queue = spark.createDataFrame(items, "review_id string, review_type string, status string, title string, left_id string, right_id string, subject string, score double, priority string")
    got = campaign.scenarios(queue, size=5).groupBy("scenario").agg(F.count("*").alias("n"), F.min("batch").alias("lo"), F.max("batch").alias("hi")).collect()
    assert {r.scenario: (r.n, r.lo, r.hi) for r in got} == {"likely_front": (12, 1, 5), "likely_mid": (12, 6, 10), "likely_late": (12, 11, 15), "needs_context": (8, 1, 8)}
    assert [texts.packet for texts in spark.createDataFrame([("x/review-assist-sample-p1-likely_mid.md",), ("review-assist-sample-latest.md",), ("review-assist-sample-summary-1.md",)], "path string").select(campaign.packet_of(F.col("path")).alias("packet")).collect()] == ["p1-likely_mid", None, None]
    with pytest.raises(ValueError, match="unknown"):
        campaign.scenarios(guided, ["none"])
    schema = "packet string, sample int, anchor string, bucket string, review_ids array<string>, proposed string, manual string"
    samples = spark.createDataFrame([("p", 1, "x", "b", ["r1", "r2"], "reject", "reject"), ("p", 2, "", "", ["r1"], "maybe", "pending"), ("p", 3, "y", "b", [], "", "other"), ("p", 4, "y", "b", [], "keep", "keep")], schema)
    assert sorted((r.sample, r.type) for r in campaign.packet_issues(samples).collect()) == [(2, "duplicate-review-id"), (2, "invalid-proposed-outcome"), (2, "missing-anchor"), (2, "missing-bucket"), (3, "invalid-manual-outcome"), (3, "missing-review-ids"), (4, "duplicate-packet-key"), (4, "missing-review-ids")]
    assert campaign.packet_status(samples).first().status == "partial"
    proposals = campaign.propose(samples.where("sample < 2").withColumns({"bucket": F.lit("likely-reject"), "flags": F.array(F.lit("all-zero-overlap"))}))
    total = campaign.rollup(campaign.compared(samples.where("sample in (1, 4)"), proposals)).first()
    assert (total.matched, total.sample_only, total.adjudicated, total.agreed, total.reject_precision) == (1, 1, 1, 1, 1.0)
    staged = campaign.reject_stage(samples, spark.createDataFrame([("pass",)], "gate string"))
    assert {r.review_id: r.ready for r in staged.collect()} == {"r1": True, "r2": True}
    assert not any(r.enabled for r in campaign.apply_plan(staged).collect())
    packets = spark.createDataFrame([("p", "complete", "likely_mid", ["c1"]), ("q", "pending", "needs_context", ["c2"])], "packet string, status string, scenario string, campaign_ids array<string>")
    assert [r.packet for r in campaign.selected(packets, ["complete", "pending"], ["needs_context"]).collect()] == ["q"]
    assert [r.packet for r in campaign.selected(packets, campaigns=["c1"]).collect()] == ["p"]
    counts = spark.createDataFrame([("p-likely_mid", 3, 0, True), ("q", 2, 2, True), ("r", 4, 1, False)], "packet string, total int, adjudicated int, valid boolean")
    one = spark.createDataFrame([("p-likely_mid",)], "packet string")
    listed = campaign.index(counts, one, one.where("false"), spark.createDataFrame([("c2", "p-likely_mid"), ("c1", "p-likely_mid")], "campaign_id string, packet string"))
    assert {(r.packet, r.status, r.scenario, tuple(r.campaign_ids)) for r in listed.collect()} == {("p-likely_mid", "pending", "likely_mid", ("c1", "c2")), ("q", "complete", "", ()), ("r", "partial", "", ())}
    scored = review.scoreboard(listed.withColumns({"campaign": F.size("campaign_ids") > 0, "scenario": F.col("scenario") != ""}), listed.agg(F.sum("adjudicated").alias("adjudicated")))
    assert {(r.packet, r.priority, r.bucket, r.remaining) for r in scored.collect()} == {("p-likely_mid", 80, "precision-ready", 14), ("r", -20, "legacy-backfill", 14)}


def test_corpora(spark, tmp_path):
    listing = spark.createDataFrame([("a", p) for p in corpora.REQUIRED] + [("b", corpora.REQUIRED[0])], "corpus_id string, relative_path string")
    assert corpora.missing_files(listing).count() == 4 and [r.corpus_id for r in corpora.valid_corpora(listing).collect()] == ["a"]
    counts = spark.createDataFrame([("a", "new", 3), ("b", "B", 1)], "corpus_id string, name string, rows long")
    known = spark.createDataFrame([("a", "old", ""), ("b", "", "x")], "corpus_id string, name string, adapter_type string")
    assert {(r.corpus_id, r.name, r.adapter_type) for r in corpora.contracts(counts, known, "md", "now").collect()} == {("a", "old", "md"), ("b", "B", "x")}
    box = tmp_path / "box"
    box.mkdir()
    (box / ".hidden.md").write_text("x")
    with pytest.raises(ValueError, match="holds 0"):
        corpora.inbox_entry(str(box))
    (box / "x.md").write_text("x")
    assert corpora.inbox_entry(str(box)).name == "x.md"
    for part, other in (("p1", "user.json"), ("p2", "users.json")):
        (tmp_path / "multi" / part).mkdir(parents=True)
        (tmp_path / "multi" / part / "conversations.json").write_text("[]")
        (tmp_path / "multi" / part / other).write_text("{}")
    assert [p.name for p in corpora.bundles(str(tmp_path / "multi"))] == ["p1", "p2"]
    assert [corpora.chat_format(str(tmp_path / "multi" / p)) for p in ("p1", "p2")] == ["mapping", "message-list"]
    with pytest.raises(FileNotFoundError):
        corpora.bundles(str(box))
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.yaml").write_text("id: E-1\n")
    (tmp_path / "y" / "b.yaml").write_text("id: E-1\n")
    assert corpora.records_by_id(spark, str(tmp_path / "y"), r"id:\s*(E-\d+)").first().path.endswith("b.yaml")
    files = spark.createDataFrame([("m1", "f.txt"), ("m2", "f.txt")], "message_id string, name string")
    said = spark.createDataFrame([("m1", "one"), ("m2", "two")], "message_id string, text string")
    assert {(r.name, r.text) for r in corpora.project_files(files, said).collect()} == {("f.txt", "one"), ("f.txt-1", "two")}
