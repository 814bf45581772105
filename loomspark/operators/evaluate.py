"""Evaluation against gold, regression gates, keyed diffs, replay and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def precision_recall(current: DataFrame, gold: DataFrame, key: str | list[str]) -> DataFrame:
    """One row (tp, fp, fn, precision, recall) of two sets of keys; a ratio without a denominator is null."""
    keys = [key] if isinstance(key, str) else key
    both = current.select(*keys).distinct().withColumn("c", F.lit(True)).join(gold.select(*keys).distinct().withColumn("g", F.lit(True)), keys, "full_outer")
    c, g = F.col("c").isNotNull(), F.col("g").isNotNull()
    sums = both.agg(F.count_if(c & g).alias("tp"), F.count_if(c & ~g).alias("fp"), F.count_if(~c & g).alias("fn"))
    return sums.withColumns({"precision": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4), "recall": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4)})


def hit_rates(hits: DataFrame, expected: DataFrame, at: tuple[int, ...] = (1, 3)) -> DataFrame:
    """hit_at_k over queries: hits (query_id, doc_id, rank), expected (query_id, doc_id); a query counts once."""
    found = expected.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return found.agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 4).alias(f"hit_at_{k}") for k in at))


# The gates of an evaluation: which way a metric counts, and from where it passes or only warns.
GATES = {
    "family_stability.exact_member_match_rate": ("min", 1.0, 0.9),
    "retrieval_metrics.family_hit_at_1": ("min", 0.9, 0.75),
    "retrieval_metrics.thread_hit_at_1": ("min", 0.5, 0.3),
    "retrieval_metrics.pair_hit_at_3": ("min", 0.5, 0.25),
    "answer_metrics.state_match_rate": ("min", 0.9, 0.75),
    "answer_metrics.required_citation_coverage_avg": ("min", 0.9, 0.75),
    "answer_metrics.forbidden_citation_violation_rate": ("max", 0.0, 0.1),
    "answer_metrics.abstention_match_rate": ("min", 0.9, 0.75),
}
#: Kinds of fixtures that make a result reliable only if people wrote them.
FIXTURES = ["retrieval", "answers", "detectors", "families"]
# The promotion policy's thresholds: the metric that each is for, which way it counts, its default.
POLICY = {
    "max_fail_corpora": ("fail_corpus_count", "max", 0.0),
    "max_warn_corpora": ("warn_corpus_count", "max", 0.0),
    "max_stale_corpora": ("stale_corpus_count", "max", 0.0),
    "max_missing_contract_corpora": ("missing_contract_corpus_count", "max", 0.0),
    "min_manual_pass_rate": ("manual_pass_rate", "min", 1.0),
    "min_registered_active_corpora": ("active_corpus_count", "min", 1.0),
}


def within(value: Column, bound: Column, direction: Column) -> Column:
    """Whether a metric keeps to a bound that it must reach (min) or not exceed (max)."""
    return F.when(direction == "min", value >= bound).otherwise(value <= bound)


def gates(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., metric, value, direction, pass, warn, state) of every gate, from (by..., metric, value).

    skip without a value; pass or warn where the gate's own bounds are kept, else fail.
    """
    by = by or []
    table = metrics.sparkSession.createDataFrame([(k, *v) for k, v in GATES.items()], "metric string, direction string, pass double, warn double")
    wanted = metrics.select(*by).distinct().join(F.broadcast(table)) if by else table
    rows = wanted.join(metrics, [*by, "metric"], "left")
    value, way = F.col("value"), F.col("direction")
    state = F.when(value.isNull(), "skip").when(within(value, F.col("pass"), way), "pass").when(within(value, F.col("warn"), way), "warn").otherwise("fail")
    return rows.select(*by, "metric", "value", "direction", "pass", "warn", state.alias("state"))


def overall(states: DataFrame, by: list[str] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(by..., overall, reliability, n_pass, n_warn, n_fail, n_skip): the worst state of the gates.

    sources (by..., kind, source): a kind of FIXTURES whose source isn't manual, or that is missing, makes reliability
    warn, and so a pass too. Without sources reliability is null.
    """
    by = by or []
    severity = F.when(F.col("state") == "fail", 3).when(F.col("state") == "warn", 2).otherwise(1)
    sums = states.groupBy(*by).agg(F.max(severity).alias("_worst"), *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail", "skip")))
    if sources is None:
        sums = sums.withColumn("reliability", F.lit(None).cast("string"))
    else:
        sure = sources.where(F.col("kind").isin(FIXTURES) & (F.col("source") == "manual")).groupBy(*by).agg(F.count_distinct("kind").alias("_sure"))
        sums = (sums.join(sure, by, "left") if by else sums.join(F.broadcast(sure))).withColumn("reliability", F.when(F.col("_sure") == len(FIXTURES), "pass").otherwise("warn"))
    state = F.when(F.col("_worst") == 3, "fail").when((F.col("_worst") == 2) | (F.col("reliability") == "warn"), "warn").otherwise("pass")
    return sums.select(*by, state.alias("overall"), "reliability", "n_pass", "n_warn", "n_fail", "n_skip")


def preferred(fixtures: DataFrame) -> DataFrame:
    """Of each kind the fixture (kind, source, rows, reviewed_none) that counts: manual, then seeded, then legacy.

    An empty manual fixture counts if it is marked as reviewed with nothing to expect.
    """
    priority = F.when(F.col("source") == "manual", 0).when(F.col("source") == "seeded", 1).otherwise(2)
    eligible = fixtures.where((F.col("rows") > 0) | F.col("reviewed_none")).withColumn("p", priority)
    return eligible.groupBy("kind").agg(F.min_by(F.struct("source", "rows"), "p").alias("x")).select("kind", "x.source", "x.rows")


def keyed_delta(live: DataFrame, candidate: DataFrame, key: str, label: str, shown: int = 10, order: str | None = None) -> DataFrame:
    """One row: numbers shared, added, removed and relabelled, and the first ``shown`` added and removed keys.

    Of rows that share a key the last label by ``order`` counts, without one the largest; a row without a key goes by its
    label. The keys shown come from two bounded top-k sorts.
    """
    named = live.schema[key].dataType.simpleString() == "string"
    own = F.coalesce(F.nullif(F.col(key), F.lit("")), F.col(label)) if named else F.col(key)
    last = F.max_by(label, order) if order else F.max(label)
    a = live.groupBy(own.alias("k")).agg(last.alias("a"))
    b = candidate.groupBy(own.alias("k")).agg(last.alias("b"))
    rows = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "k", "full_outer")
    old, new = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    sums = rows.agg(F.count_if(old & new).alias("shared"), F.count_if(~old).alias("added"), F.count_if(~new).alias("removed"), F.count_if(old & new & (F.col("a") != F.col("b"))).alias("relabelled"))

    def first(which: Column, name: str) -> DataFrame:
        return rows.where(which).orderBy("k").limit(shown).agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias(name))

    return sums.join(F.broadcast(first(~old, "first_added"))).join(F.broadcast(first(~new, "first_removed")))


def verdict(delta: DataFrame, gate: DataFrame) -> DataFrame:
    """fail with a failed gate, review if anything went or was renamed or a gate warned, else ready."""
    return delta.join(F.broadcast(gate)).withColumn("recommendation", F.when(F.col("overall") == "fail", "fail").when((F.col("removed") > 0) | (F.col("relabelled") > 0) | (F.col("overall") == "warn"), "review").otherwise("ready"))


def replay(live: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per query, whether the top answer of two corpora changed: from (query_id, state, top_id) on both sides."""
    a, b = (x.select("query_id", F.col("state").alias(f"{s}_state"), F.col("top_id").alias(f"{s}_top")) for s, x in (("live", live), ("candidate", candidate)))
    rows = a.join(b, "query_id", "full_outer")
    return rows.withColumn("change", F.when(F.col("candidate_state").isNull() | F.col("live_state").isNull(), "missing").when(F.col("live_state") != F.col("candidate_state"), "state").when(~F.col("live_top").eqNullSafe(F.col("candidate_top")), "evidence").otherwise("same"))


def normalized_policy(spark: SparkSession, overrides: dict[str, float] | None = None) -> DataFrame:
    """(threshold, metric, direction, bound): every threshold, with the default where nothing else is said.

    A threshold that isn't in the policy raises.
    """
    overrides = overrides or {}
    unknown = set(overrides) - set(POLICY)
    if unknown:
        raise ValueError(f"unknown thresholds: {', '.join(sorted(unknown))}")
    rows = [(k, metric, way, float(overrides.get(k, bound))) for k, (metric, way, bound) in POLICY.items()]
    return spark.createDataFrame(rows, "threshold string, metric string, direction string, bound double")


def replay_cases(corpora: DataFrame) -> DataFrame:
    """Flags of active corpora (corpus_id, evaluation_state, freshness, valid_contract) under a policy.

    A corpus is stale unless fresh or not_applicable, null included; only an evaluation that passed counts as a pass.
    """
    state, stale = F.col("evaluation_state"), ~F.coalesce(F.col("freshness").isin("fresh", "not_applicable"), F.lit(False))
    flags = {
        "gate_fail": F.coalesce(state == "fail", F.lit(False)), "gate_warn": F.coalesce(state == "warn", F.lit(False)), "stale_source": stale,
        "missing_contract": ~F.coalesce("valid_contract", F.lit(False)), "manual_pass": F.coalesce(state == "pass", F.lit(False)),
    }
    rows = corpora.withColumns(flags)
    return rows.withColumn("review_required", F.col("gate_fail") | F.col("gate_warn") | F.col("stale_source") | F.col("missing_contract"))


def replay_summary(cases: DataFrame) -> DataFrame:
    """One row of counts over replay_cases; the pass rate is null without any corpus."""
    counts = {"fail_corpus_count": "gate_fail", "warn_corpus_count": "gate_warn", "stale_corpus_count": "stale_source", "missing_contract_corpus_count": "missing_contract", "manual_pass_count": "manual_pass", "review_required_count": "review_required"}
    sums = cases.agg(F.count(F.lit(1)).alias("active_corpus_count"), *(F.count_if(F.col(c)).alias(n) for n, c in counts.items()))
    return sums.withColumn("manual_pass_rate", F.round(F.try_divide("manual_pass_count", "active_corpus_count"), 4))


def policy_gates(summary: DataFrame, policy: DataFrame) -> DataFrame:
    """(threshold, metric, direction, bound, value, state) of a policy: pass, fail, or skip without a value."""
    names = [metric for metric, _, _ in POLICY.values()]
    values = summary.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("m.*")
    rows = policy.join(values, "metric", "left")
    state = F.when(F.col("value").isNull(), "skip").when(within(F.col("value"), F.col("bound"), F.col("direction")), "pass").otherwise("fail")
    return rows.select("threshold", "metric", "direction", "bound", "value", state.alias("state"))


def calibration(states: DataFrame) -> DataFrame:
    """What a replay's worst state says of the policy: ready, observe or blocked."""
    now = F.col("overall")
    return overall(states).select(F.when(now == "pass", "ready").when(now == "warn", "observe").otherwise("blocked").alias("calibration"), now.alias("reason"))


def readiness(targets: DataFrame) -> DataFrame:
    """Adds readiness and next_step to targets (present, has_contract, has_guide, evaluation_state, registered,
    registry_status, upload_state): the first rung of the ladder that a target hasn't passed.
    """
    state, upload = F.col("evaluation_state"), F.coalesce(F.col("upload_state") == "ready", F.lit(False))
    federated = F.coalesce(F.col("registered") & (F.col("registry_status") == "active"), F.lit(False))
    # The states' names.
    rungs = [
        (~F.col("present"), "missing", F.when(upload, "import").otherwise("place-export")),
        (~F.col("has_contract"), "missing-contract", F.lit("create-contract")),
        (~F.col("has_guide"), "imported-needs-bootstrap", F.lit("bootstrap-eval")),
        (F.coalesce(state, F.lit("")) == "", "manual-eval-unrun", F.lit("run-evaluation")),
        (state != "pass", "manual-eval-pending", F.lit("run-evaluation")),
        (federated, "healthy-federation", F.when(upload, "refresh").otherwise("ready")),
    ]
    name, step = F.lit("calibration-pass"), F.lit("register")
    for when, rung, then in reversed(rungs):
        name, step = F.when(when, rung).otherwise(name), F.when(when, then).otherwise(step)
    return targets.withColumns({"readiness": name, "next_step": step})


def latest(rows: DataFrame, key: str | list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key by (at, tie); an aggregate with partial maxima, not a window over the history."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("x")).select(*keys, "x.*")


def upsert(decisions: DataFrame, more: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """Decisions with new ones added; the last writer of a key wins, in whichever verdict it was before."""
    return latest(decisions.unionByName(more), key, at, tie)


def one_default(registry: DataFrame, name: str = "corpus_id") -> DataFrame:
    """A registry with exactly one active default: the first active one that says so, else the first active one."""
    active = registry.where(F.coalesce("status", F.lit("active")) == "active")
    chosen = active.agg(F.min_by(name, F.struct((~F.coalesce("is_default", F.lit(False))).cast("int"), name)).alias("chosen"))
    return registry.join(F.broadcast(chosen)).withColumn("is_default", F.col(name).eqNullSafe(F.col("chosen"))).drop("chosen")


def uniqueness(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Marks all but the first row of a key."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)


def metric(scorecard: Column, path: str) -> Column:
    """The number at a dotted path of a JSON scorecard; null where there is none or something else."""
    found = F.get_json_object(scorecard, "$." + path)
    return F.when(found.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), found.cast("double"))


def fixture_counts(fixtures: DataFrame) -> DataFrame:
    """(kind, fixtures): rows of each kind of fixture."""
    return fixtures.groupBy("kind").agg(F.count(F.lit(1)).alias("fixtures"))


def merged_counts(*maps: DataFrame) -> DataFrame:
    """(key, n): the sums of several count tables."""
    out = maps[0]
    for more in maps[1:]:
        out = out.unionByName(more)
    return out.groupBy("key").agg(F.sum("n").alias("n"))


def normalized_pair(values: Column, labels: bool = False) -> Column:
    """The first two different values in order, in lower case if they are labels; null without two."""
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    unique = F.sort_array(F.array_distinct(F.transform(kept, F.lower) if labels else kept))
    return F.when(F.size(unique) >= 2, F.slice(unique, 1, 2))


def policy_diff(live: DataFrame, overrides: DataFrame) -> DataFrame:
    """(threshold, from, to, delta) of each override (threshold, bound) of a live policy; delta is null for a new one."""
    old = live.select("threshold", F.col("bound").alias("from"))
    return overrides.select("threshold", F.col("bound").alias("to")).join(old, "threshold", "left").select("threshold", "from", "to", F.round(F.col("to") - F.col("from"), 4).alias("delta"))


def query_summary(states: DataFrame, hits: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a replay compares of each query: state, confidence, the best hit, six citations, the number of evidence."""
    top = hits.where("rank = 1").select("query_id", F.col("kind").alias("top_hit_kind"), F.col("title").alias("top_hit_title"), F.round("score", 4).alias("top_score"))
    counted = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    rows = states.select("query_id", F.col("state").alias("answer_state"), "confidence").join(top, "query_id", "left").join(counted, "query_id", "left")
    rows = rows.join(citations.select("query_id", F.slice("citations", 1, 6).alias("citations")), "query_id", "left")
    return rows.withColumns({"top_score": F.coalesce("top_score", F.lit(0.0)), "evidence_count": F.when(F.col("answer_state") == "abstain", 0).otherwise(F.coalesce("evidence_count", F.lit(0)))})
