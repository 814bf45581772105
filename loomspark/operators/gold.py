"""Gold fixtures from a corpus's own tables, and its evaluation: every fixture of a corpus in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import cascade

ABSTENTION = "nonexistent corpus signal for abstention"


def seed_retrieval(families: DataFrame, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(query, family_id, thread, pair_id, scenario) from families (family_id, title, thread, themes), pairs (pair_id,
    thread, search_text) and entities (family_id, position, label): titles, two themes, long words of the first pair, two
    entities, and one query that should find nothing.
    """
    first = pairs.groupBy("thread").agg(F.min_by(F.struct("pair_id", "search_text"), "pair_id").alias("p"))
    words = F.slice(F.filter(F.split("p.search_text", r"\s+"), lambda t: F.length(t) > 4), 1, 5)
    none = F.lit(None).cast("string")
    base = families.select("family_id", "thread", "title", "themes")
    titles = base.select(F.col("title").alias("query"), "family_id", "thread", none.alias("pair_id"), F.lit("canonical-title").alias("scenario"))
    themes = base.where(F.size("themes") > 0).select(F.array_join(F.slice("themes", 1, 2), " "), "family_id", "thread", none, F.lit("stable-themes"))
    told = base.join(first, "thread").where(F.size(words) > 0).select(F.array_join(words, " "), "family_id", "thread", F.col("p.pair_id"), F.lit("pair-evidence"))
    two = entities.where("position < 2").groupBy("family_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]), " ").alias("q"))
    named = base.join(two, "family_id").select("q", "family_id", "thread", none, F.lit("entity-focus"))
    nothing = families.sparkSession.createDataFrame([(ABSTENTION, None, None, None, "abstention")], "query string, family_id string, thread string, pair_id string, scenario string")
    return titles.union(themes).union(told).union(named).union(nothing)


def seed_answers(families: DataFrame, actions: DataFrame) -> DataFrame:
    """(query, expected_state, required, forbidden, least): a title should be answered from its family, thread and action."""
    first = actions.groupBy("family_id").agg(F.min("item_key").alias("action"))
    rows = families.join(first, "family_id", "left")
    cites = F.array_compact(F.array(F.concat(F.lit("family:"), "family_id"), F.concat(F.lit("thread:"), "thread"), F.concat(F.lit("action:"), "action")))
    told = rows.select(F.col("title").alias("query"), F.lit("grounded").alias("expected_state"), cites.alias("required"), F.expr("cast(array() as array<string>)").alias("forbidden"), F.when(F.col("action").isNull(), 2).otherwise(3).alias("least"))
    nothing = families.sparkSession.createDataFrame([(ABSTENTION, "abstain", [], [], 0)], "query string, expected_state string, required array<string>, forbidden array<string>, least int")
    return told.unionByName(nothing)


def retrieval_metrics(fixtures: DataFrame, found: cascade.Found) -> DataFrame:
    """(metric, value): hit at 1 and 3 for families, threads and pairs; fixtures (query_id, family_id, thread, pair_id)."""
    out = None
    for stage, rows, key in (("family", found.family, "family_id"), ("thread", found.thread, "thread"), ("pair", found.pair, "pair_id")):
        expected = fixtures.where(F.col(key).isNotNull()).select("query_id", F.col(key).alias("k"))
        of = F.regexp_replace("doc_id", "^[a-z_]+:", "") if stage == "pair" else F.col(key)
        best = rows.select("query_id", of.alias("k"), "rank").groupBy("query_id", "k").agg(F.min("rank").alias("rank"))
        hit = expected.join(best, ["query_id", "k"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
        for n in (1, 3):
            one = hit.agg(F.round(F.avg(F.coalesce(F.col("rank") <= n, F.lit(False)).cast("double")), 4).alias("value")).select(F.lit(f"{stage}_hit_at_{n}").alias("metric"), "value")
            out = one if out is None else out.unionByName(one)
    return out


def answer_metrics(fixtures: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of rates from fixtures (query_id, expected_state, required, forbidden, least) and answers (query_id, state, citations)."""
    counted = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    none = F.expr("cast(array() as array<string>)")
    rows = fixtures.join(answers, "query_id", "left").join(counted, "query_id", "left")
    rows = rows.withColumns({"citations": F.coalesce("citations", none), "n": F.when(F.col("state") == "abstain", 0).otherwise(F.coalesce("n", F.lit(0)))})
    coverage = F.when(F.size("required") > 0, F.size(F.array_intersect("required", "citations")) / F.size("required"))
    abstains = F.col("expected_state") == "abstain"

    def rate(test: Column) -> Column:
        return F.round(F.avg(F.coalesce(test, F.lit(False)).cast("double")), 4)

    return rows.agg(
        F.count(F.lit(1)).alias("fixture_count"), rate(F.col("state") == F.col("expected_state")).alias("state_match_rate"), F.round(F.avg(coverage), 4).alias("required_citation_coverage_avg"),
        rate(F.size(F.array_intersect("forbidden", "citations")) > 0).alias("forbidden_citation_violation_rate"), rate(F.col("n") >= F.col("least")).alias("evidence_minimum_pass_rate"),
        F.round(F.try_divide(F.count_if(abstains & (F.col("state") == "abstain")), F.count_if(abstains)), 4).alias("abstention_match_rate"),
    )


def jaccard_families(current: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (families, exact, mean_jaccard) over gold families (family_id, thread_uids) and what the corpus has."""
    rows = gold.join(current.select("family_id", F.col("thread_uids").alias("_now")), "family_id", "left")
    now = F.coalesce("_now", F.expr("cast(array() as array<string>)"))
    score = T.jaccard(F.array_distinct("thread_uids"), F.array_distinct(now))
    return rows.agg(F.count(F.lit(1)).alias("families"), F.count_if(score == 1.0).alias("exact"), F.round(F.avg(score), 4).alias("mean_jaccard"))


def representative_queries(candidate: DataFrame, live: DataFrame, limit: int = 8) -> DataFrame:
    """The first distinct titles (source, pos, title) of two corpora, the candidate's first: queries to replay on both."""
    rows = candidate.select(F.lit(0).alias("side"), "source", "pos", "title").unionByName(live.select(F.lit(1).alias("side"), "source", "pos", "title"))
    cut = rows.withColumn("query", T.shorten("title", 120)).where("query <> ''")
    return cut.groupBy("query").agg(F.min(F.struct("side", "source", "pos")).alias("at")).orderBy("at", "query").limit(limit).select("query")
