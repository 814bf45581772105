"""Queries of review, evaluation, governance and lifecycle over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as T
from loomspark.operators import campaign, canon, contracts, evaluate, federation, labelpairs, lifecycle, review, search
from loomspark.plans import sqltext as S
from loomspark.plans.search_queries import CONTRADICTION_SQL, FAMILY_SQL, entity_records, entity_sql, family_records
from loomspark.plans.search_queries import SQL as SEARCH
from loomspark.plans.shared import table, written
from loomspark.sources import exports
from loomspark.streaming import ingest

QUERIES = {}
SQL = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queue(spark: SparkSession, d: str) -> DataFrame:
    """A review queue: entities with a lower threshold than that of production, family merges and contradictions."""
    families = written(family_records(spark, d), "families")
    parts = [canon.suggestions(entity_records(spark, d), "entity-alias", threshold=0.3), canon.suggestions(families, "family-merge"), canon.suggestions(families, "contradiction")]
    return written(parts[0].unionByName(parts[1]).unionByName(parts[2]), "queue")


_QUEUE = f"SELECT * FROM ({entity_sql(0.3)}) UNION ALL SELECT * FROM ({FAMILY_SQL}) UNION ALL SELECT * FROM ({CONTRADICTION_SQL})"


def _local(c: str) -> str:
    return f"substr({c}, instr({c}, ':') + 1)"


def _bare(c: str) -> str:
    return f"CASE WHEN length({_local(c)}) >= 10 THEN regexp_replace({_local(c)}, '-[0-9a-fA-F]{{8}}$', '') ELSE {_local(c)} END"


def _plain(x: str) -> str:
    return S.label(f"replace(replace({x}, '-', ' '), '_', ' ')")


_STOP = "['a','an','and','are','as','at','be','by','for','from','how','if','in','into','is','it','of','on','or','should','that','the','this','to','what','when','where','which','why','with']"


def _words(x: str) -> str:
    return f"list_filter({S.tokens(x)}, lambda t: NOT list_contains({_STOP}, t))"


def _sides(rows: str) -> str:
    """CTE x: items with both labels, their words, and how these overlap."""
    return f"""
s0 AS (SELECT *, trim(string_split(title, ' <> ')[1]) AS left_label, trim(array_to_string(string_split(title, ' <> ')[2:], ' <> ')) AS right_label FROM ({rows})),
s1 AS (SELECT *, {_words('left_label')} AS lw, {_words('right_label')} AS rw FROM s0),
s2 AS (SELECT *, list_distinct(lw) AS la, list_distinct(rw) AS ra FROM s1),
x AS (SELECT *, len(list_intersect(la, ra)) AS shared, {S.jaccard('la', 'ra')} AS alike, CASE WHEN len(la) = 0 OR len(ra) = 0 THEN 0.0 ELSE round(len(list_intersect(la, ra)) / least(len(la), len(ra)), 4) END AS subset FROM s2)"""


def _titled(kind: str, least: float, policy: str) -> str:
    return f"WHEN apart AND review_type = '{kind}' AND left_label <> '' AND right_label <> '' AND least(len(lw), len(rw)) >= 2 AND shared >= 2 AND (alike >= {least} OR subset >= 1.0 OR lower(left_label) = lower(right_label)) THEN '{policy}'"


_NOISE = "('entity-0-1','entity-1-0','entity-0','entity-1','entity-2','entity-3','entity-none','entity-null','entity-true','entity-false')"
_TRIAGE = f"""
WITH q AS ({_QUEUE}), {_sides('SELECT * FROM q')},
y AS (SELECT *, split_part(left_id, ':', 1) <> split_part(right_id, ':', 1) AS apart, {_local('left_id')} AS l, {_local('right_id')} AS r FROM x),
z AS (SELECT *, CASE WHEN length(r) < length(l) THEN r ELSE l END AS lo, CASE WHEN length(r) < length(l) THEN l ELSE r END AS hi,
  CASE WHEN len(rw) < len(lw) THEN ra ELSE la END AS fewer, CASE WHEN len(rw) < len(lw) THEN la ELSE ra END AS more FROM y),
t AS (SELECT *, CASE WHEN apart AND l = r THEN 'exact-cross-corpus'
  WHEN apart AND review_type IN ('family-merge', 'action-merge', 'unresolved-merge') AND {_bare('left_id')} = {_bare('right_id')} AND {_bare('left_id')} <> '' THEN 'slug-match'
  {_titled('entity-alias', 0.5, 'entity-title-overlap')} {_titled('family-merge', 0.6, 'family-title-overlap')} {_titled('action-merge', 0.6, 'action-title-overlap')} {_titled('unresolved-merge', 0.6, 'unresolved-title-overlap')}
  WHEN apart AND review_type = 'entity-alias' AND starts_with(hi, lo) AND length(lo) >= 10 THEN 'prefix-entity-alias'
  WHEN review_type = 'entity-alias' AND (l IN {_NOISE} OR r IN {_NOISE}) THEN 'noise-entity'
  WHEN review_type = 'entity-alias' AND least(length(replace(l, 'entity-', '')), length(replace(r, 'entity-', ''))) < 3 THEN 'short-entity'
  WHEN review_type = 'entity-alias' AND least(len(lw), len(rw)) = 1 AND greatest(len(lw), len(rw)) >= 3 AND len(list_filter(fewer, lambda v: NOT list_contains(more, v))) = 0 THEN 'generic-singleton-entity'
  WHEN review_type = 'contradiction' THEN 'contradiction-defer' ELSE 'manual' END AS policy FROM z),
v AS (SELECT *, CASE WHEN policy IN ('noise-entity', 'short-entity', 'generic-singleton-entity') THEN 'rejected' WHEN policy = 'contradiction-defer' THEN 'deferred' WHEN policy = 'manual' THEN 'manual' ELSE 'accepted' END AS decision FROM t)"""


@query(f"{_TRIAGE} SELECT review_id, score, policy, decision, CASE WHEN decision = 'accepted' THEN subject ELSE '' END AS canonical_subject FROM v")
def triage_classify(spark: SparkSession, d: str) -> DataFrame:
    return review.triage(queue(spark, d)).select("review_id", "score", "policy", "decision", "canonical_subject")


@query(f"{_TRIAGE} SELECT policy, decision, count(*) AS items FROM v GROUP BY ALL")
def triage_plan(spark: SparkSession, d: str) -> DataFrame:
    return review.triage_summary(review.triage(queue(spark, d)))


@query(f"{_TRIAGE} SELECT review_id, CASE WHEN decision = 'manual' THEN 'open' ELSE decision END AS status, CASE WHEN decision <> 'manual' THEN policy END AS triage_policy, CASE WHEN decision <> 'manual' THEN subject END AS canonical_subject FROM v")
def triage_apply(spark: SparkSession, d: str) -> DataFrame:
    items = queue(spark, d)
    return review.apply_triage(items, review.triage(items), "2024-01-01")[0].select("review_id", "status", "triage_policy", "canonical_subject")


_SIGNALS = "CASE WHEN {0} IN ('both','default','general','missing','misc','none','other','primary','remaining','supplement','unknown') OR {0} IN ('appendix','appendices','chapter','chapters','checklist','conclusion','extension','introduction','overview','section','sections','summary') OR regexp_matches(replace({0}, ' ', ''), '^[0-9]+$') OR (regexp_matches(replace({0}, ' ', ''), '^[a-z0-9]+$') AND regexp_matches(replace({0}, ' ', ''), '[0-9]') AND length(replace({0}, ' ', '')) <= 6) OR (len({1}) <= 1 AND regexp_matches(replace({0}, ' ', ''), '^[a-z]{{1,3}}$')) THEN 1 ELSE 0 END"
_ENTRIES = f"""
q AS ({entity_sql(0.3)}), {_sides('SELECT * FROM q')},
n0 AS (SELECT *, {_plain('left_label')} AS l, {_plain('right_label')} AS r, {_plain('subject')} AS anchor FROM x),
n1 AS (SELECT *, list_distinct({_words('l')}) AS nl, list_distinct({_words('r')}) AS nr FROM n0),
n2 AS (SELECT *, len(list_intersect(nl, nr)) AS nb, {S.jaccard('nl', 'nr')} AS nj FROM n1),
n AS (SELECT *, CASE WHEN l = '' OR r = '' THEN 'unlabeled' WHEN l = r THEN 'exact-match' WHEN contains(l, r) OR contains(r, l) THEN 'substring'
  WHEN nb >= 2 AND (nj >= 0.5 OR nb = least(len(nl), len(nr))) THEN 'high-overlap' WHEN nb >= 1 THEN 'partial-overlap' ELSE 'disjoint' END AS relation,
  {_SIGNALS.format('l', 'lw')} + {_SIGNALS.format('r', 'rw')} > 0 AS vague FROM n2)"""


def _anchors(where: str = "true") -> str:
    return f"""
a AS (SELECT anchor, count(*) AS item_count, max(score) AS best_score, count(*) FILTER (relation = 'exact-match') AS exact_match, count(*) FILTER (relation = 'substring') AS substring,
  count(*) FILTER (relation = 'high-overlap') AS high_overlap, count(*) FILTER (relation = 'partial-overlap') AS partial_overlap, count(*) FILTER (relation = 'disjoint') AS disjoint, count(*) FILTER (relation = 'unlabeled') AS unlabeled,
  count(*) FILTER (relation IN ('exact-match', 'substring', 'high-overlap')) AS exactish, count(*) FILTER (shared = 0) AS zero_overlap, count(*) FILTER (score >= 0.9) AS high_score, count(*) FILTER (vague) AS low_specificity
  FROM n WHERE {where} GROUP BY 1)"""


_BUCKET = "CASE WHEN exactish = item_count THEN 'alias-check' WHEN disjoint = item_count AND zero_overlap = item_count AND high_score > 0 THEN 'needs-context' WHEN disjoint = item_count AND zero_overlap = item_count THEN 'likely-reject' ELSE 'mixed-review' END"
_FLAGS = "concat_ws(',', CASE WHEN low_specificity > 0 THEN 'has-low-specificity-labels' END, CASE WHEN high_score > 0 AND disjoint > 0 THEN 'has-high-score-disjoint-pairs' END, CASE WHEN zero_overlap = item_count THEN 'all-zero-overlap' END)"
_PACKED = """
o AS (SELECT *, row_number() OVER (ORDER BY item_count DESC, anchor) AS i FROM a),
w AS (SELECT anchor, item_count, i, item_count AS used, 1 AS batch FROM o WHERE i = 1
      UNION ALL SELECT o.anchor, o.item_count, o.i, CASE WHEN w.used + o.item_count > 25 THEN o.item_count ELSE w.used + o.item_count END,
        CASE WHEN w.used + o.item_count > 25 THEN w.batch + 1 ELSE w.batch END FROM w JOIN o ON o.i = w.i + 1)"""


def _assist(spark: SparkSession, d: str) -> DataFrame:
    return review.entries(canon.suggestions(entity_records(spark, d), "entity-alias", threshold=0.3))


def _assist_anchors(spark: SparkSession, d: str) -> DataFrame:
    return labelpairs.anchors(written(entity_records(spark, d), "records"), 0.3)


@query(f"WITH {_ENTRIES}, {_anchors()} SELECT *, {_BUCKET} AS bucket, {_FLAGS} AS flags FROM a")
def assist_groups(spark: SparkSession, d: str) -> DataFrame:
    return campaign.guidance(_assist_anchors(spark, d)).withColumn("flags", F.array_join("flags", ","))


@query(f"""WITH {_ENTRIES} SELECT 'relation' AS field, relation AS value, count(*) AS items FROM n GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM n GROUP BY 2
UNION ALL SELECT 'source_pair', array_to_string(list_sort([split_part(left_id, ':', 1), split_part(right_id, ':', 1)]), ' <> '), count(*) FROM n GROUP BY 2""")
def assist_counts(spark: SparkSession, d: str) -> DataFrame:
    fields = ["relation", "priority", "source_pair"]
    # One pass over the entries; what is written has as many rows as there are combinations.
    found = written(_assist(spark, d).groupBy(*fields).agg(F.count(F.lit(1)).alias("n")), "counts")
    out = None
    for field in fields:
        one = found.groupBy(F.lit(field).alias("field"), F.coalesce(field, F.lit("unknown")).alias("value")).agg(F.sum("n").alias("items"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_ENTRIES} SELECT anchor, place, review_id, score, relation FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, relation, title, review_id) AS place FROM n) WHERE place <= 3""")
def assist_examples(spark: SparkSession, d: str) -> DataFrame:
    return labelpairs.examples(written(entity_records(spark, d), "records"), 0.3).select("anchor", F.col("place").cast("long").alias("place"), "review_id", "score", "relation")


@query(f"WITH RECURSIVE {_ENTRIES.strip()}, {_anchors()}, {_PACKED} SELECT anchor, item_count, batch::BIGINT AS batch FROM w")
def assist_batches(spark: SparkSession, d: str) -> DataFrame:
    packed = review.batches(_assist_anchors(spark, d))
    return packed.select("anchor", "item_count", F.col("batch").cast("long").alias("batch"))


def _scenario(name: str, bucket: str, groups: int, take: int, offset: int) -> str:
    return f"""SELECT * FROM (SELECT '{name}' AS scenario, anchor, batch::BIGINT AS batch, row_number() OVER (PARTITION BY batch ORDER BY i) AS turn
  FROM (SELECT *, dense_rank() OVER (ORDER BY batch) AS k FROM (SELECT w.batch, w.i, a.* FROM w JOIN a USING (anchor)) WHERE {_BUCKET} = '{bucket}') WHERE k > {offset} AND k <= {offset + take} ORDER BY turn, batch LIMIT {groups})"""


@query(f"""WITH RECURSIVE {_ENTRIES.replace(entity_sql(0.3), entity_sql(0.12)).strip()}, {_anchors("relation = 'disjoint'")}, {_PACKED}
{_scenario('likely_front', 'likely-reject', 12, 5, 0)} UNION ALL {_scenario('likely_mid', 'likely-reject', 12, 5, 5)} UNION ALL {_scenario('likely_late', 'likely-reject', 12, 5, 10)} UNION ALL {_scenario('needs_context', 'needs-context', 8, 10, 0)}""")
def campaign_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """What a campaign samples; with a threshold so low that labels which share stop words alone are in the queue."""
    records = written(entity_records(spark, d), "records")
    return campaign.scenarios(None, groups_of=lambda kind: labelpairs.anchors(records, 0.12, [kind])).select("scenario", "anchor", F.col("batch").cast("long").alias("batch"), F.col("turn").cast("long").alias("turn"))


@query("""
SELECT source, doc_id, turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents)
ORDER BY turn, source LIMIT 50""")
def sample_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: fifty documents, taken from the sources in turn, the longest first."""
    rows = table(spark, d, "documents").withColumn("shorter", -F.col("n_chars"))
    return review.round_robin(rows, "source", ["shorter", "doc_id"], 50).select("source", "doc_id", F.col("turn").cast("long").alias("turn"))


#: What reviewers write, by doc_id modulo their number; the tables hold no reviews.
_SAID = ["Rejected: not the same", "keep", "False positive", "needs context first", "nothing to add", "", "Skip", "reject"]
_WINDOWS = ["likely_front", "likely_mid", "likely_late", "needs_context", "byhand"]


def packet_lines(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as samples of review packets, one packet a source, as the lines of its text."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    packet = F.concat_ws("-", "source", F.get(F.array(*(F.lit(w) for w in _WINDOWS)), number % len(_WINDOWS)))
    said = F.get(F.array(*(F.lit(x) for x in _SAID)), (F.col("doc_id") % len(_SAID)).cast("int"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    lines = F.array(F.format_string("## Sample %d: d%d", "place", "doc_id"), F.concat(F.lit("- Bucket: "), F.when(F.col("toxic") == 1, "needs-context").otherwise("likely-reject")), F.concat(F.lit("- Proposed outcome: "), F.when(F.col("toxic") == 1, "needs-context").otherwise("reject")), F.concat(F.lit("- Manual outcome: "), "said"), F.lit(""))
    rows = rows.select(packet.alias("packet"), "doc_id", "toxic", said.alias("said"), place.alias("place"), "source").select("packet", "place", F.posexplode(lines).alias("p", "line"))
    return rows.select("packet", (F.col("place") * 5 + F.col("p")).alias("line_no"), "line")


_LINES = f"""(WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, source || '-' || {S.quoted(_WINDOWS)}[regexp_extract(source, '([0-9]+)$', 1)::INT % {len(_WINDOWS)} + 1] AS packet FROM documents JOIN labels USING (doc_id)),
e AS (SELECT packet, place, unnest([format('## Sample {{}}: d{{}}', place, doc_id), '- Bucket: ' || CASE toxic WHEN 1 THEN 'needs-context' ELSE 'likely-reject' END, '- Proposed outcome: ' || CASE toxic WHEN 1 THEN 'needs-context' ELSE 'reject' END,
  '- Manual outcome: ' || {S.quoted(_SAID)}[doc_id % {len(_SAID)} + 1], '']) AS line, generate_subscripts([1, 2, 3, 4, 5], 1) - 1 AS p FROM d)
SELECT packet, place * 5 + p AS line_no, line FROM e)"""
_PARSED = f"""
WITH l AS {_LINES}, s AS (SELECT *, sum(CASE WHEN starts_with(line, '## Sample ') THEN 1 ELSE 0 END) OVER (PARTITION BY packet ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sample FROM l),
a AS (SELECT *, max(CASE WHEN starts_with(line, '## Sample ') THEN regexp_extract(line, '^## Sample \\d+: (.*)$', 1) END) OVER (PARTITION BY packet, sample) AS anchor FROM s)
SELECT packet, sample::BIGINT AS sample, coalesce(anchor, '') AS anchor, regexp_extract(line, '^- ([^:]+):\\s*(.*)$', 1) AS key,
  regexp_extract(line, '^- ([^:]+):\\s*(.*)$', 2) AS value FROM a WHERE regexp_matches(line, '^- [^:]+:')"""


@query(_PARSED)
def packet_parse(spark: SparkSession, d: str) -> DataFrame:
    return review.parse_packets(packet_lines(spark, d)).withColumn("sample", F.col("sample").cast("long"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return review.samples(review.parse_packets(packet_lines(spark, d)))


_JUDGED = f"""
f AS ({_PARSED}), s AS (SELECT packet, sample, max(CASE WHEN key = 'Manual outcome' THEN lower({S.space('value')}) END) AS said, max(CASE WHEN key = 'Proposed outcome' THEN value END) AS proposed FROM f WHERE sample > 0 GROUP BY ALL),
m AS (SELECT *, CASE WHEN regexp_matches(said, '^(rejected|reject)( |:|$)') THEN 'reject' WHEN regexp_matches(said, '^(accepted|accept|keep|false-positive|false positive)( |:|$)') THEN 'keep'
  WHEN regexp_matches(said, '^(needs-context|needs context|defer|deferred)( |:|$)') THEN 'needs-context' WHEN regexp_matches(said, '^(pending|skip)( |:|$)') THEN 'pending' ELSE said END AS manual FROM s)"""


@query(f"""WITH {_JUDGED},
c AS (SELECT count(*) AS total, count(*) FILTER (manual IN ('reject', 'keep', 'needs-context')) AS adjudicated, count(*) FILTER (manual IN ('reject', 'keep', 'needs-context') AND manual = proposed) AS agreed,
  count(*) FILTER (manual IN ('reject', 'keep', 'needs-context') AND proposed = 'reject') AS reject_proposed, count(*) FILTER (manual = 'reject' AND proposed = 'reject') AS reject_confirmed FROM m),
g AS (SELECT *, round(reject_confirmed / reject_proposed, 4) AS reject_precision, round(agreed / adjudicated, 4) AS agreement FROM c)
SELECT *, CASE WHEN adjudicated < 20 THEN 'insufficient' WHEN reject_precision >= 0.95 THEN 'pass' ELSE 'fail' END AS gate FROM g""")
def reject_stage_gate(spark: SparkSession, d: str) -> DataFrame:
    return review.reject_gate(review.agreement(_samples(spark, d)))


@query(f"WITH {_JUDGED} SELECT packet, sample, said, manual FROM m")
def packet_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("packet", F.col("sample").cast("long").alias("sample"), F.lower(T.normalize_space("said")).alias("said"), "manual")


_INDEX = f"""{_JUDGED},
c AS (SELECT packet, count(*) AS total, count(*) FILTER (manual IN ('reject', 'keep', 'needs-context')) AS adjudicated, count(DISTINCT manual) FILTER (manual NOT IN ('', 'reject', 'keep', 'needs-context', 'pending')) = 0 AS valid FROM m GROUP BY packet),
h AS (SELECT packet, max(proposed = 'needs-context') AS proposed, max(manual = 'keep' AND proposed = 'needs-context') AS compared, max(proposed = 'needs-context' AND manual = 'reject') AS campaign FROM m GROUP BY packet),
i AS (SELECT c.*, h.proposed, h.compared, campaign, total - adjudicated AS pending, CASE WHEN total <= 0 THEN 'empty' WHEN adjudicated <= 0 THEN 'pending' WHEN adjudicated >= total THEN 'complete' ELSE 'partial' END AS status,
  regexp_extract(packet, '-(likely_front|likely_mid|likely_late|needs_context)$', 1) AS scenario FROM c JOIN h USING (packet))"""


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The packets' index: those with a proposed context have a proposal, some of them a comparison and a campaign."""
    samples = written(_samples(spark, d), "samples")
    judged = F.col("manual").isin(review.ADJUDICATED)
    packets = samples.groupBy("packet").agg(F.count(F.lit(1)).alias("total"), F.count_if(judged).alias("adjudicated"), (F.count_if(~F.col("manual").isin(campaign.MANUAL)) == 0).alias("valid"))
    context = samples.where("proposed = 'needs-context'")
    campaigns = context.where("manual = 'reject'").select("packet").distinct().withColumn("campaign_id", F.lit("c1"))
    return campaign.index(packets, context, context.where("manual = 'keep'"), campaigns), samples


@query(f"WITH {_INDEX} SELECT packet, total, adjudicated, valid, proposed, compared, status, pending, scenario, CASE WHEN campaign THEN 'c1' ELSE '' END AS campaign_ids FROM i")
def campaign_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[0].withColumn("campaign_ids", F.array_join("campaign_ids", ","))


@query(f"""WITH {_INDEX}, t AS (SELECT greatest(0, 250 - sum(adjudicated)) AS lacks FROM c)
SELECT packet, pending, pending * 10 + CASE WHEN proposed THEN 30 ELSE 0 END + CASE WHEN compared THEN 15 ELSE 0 END + CASE WHEN campaign THEN 10 ELSE 0 END + CASE WHEN scenario <> '' THEN 10 ELSE 0 END - CASE WHEN valid THEN 0 ELSE 50 END AS priority,
  CASE WHEN lacks > 0 AND pending >= lacks THEN 'unlock-threshold-now' WHEN proposed OR compared THEN 'precision-ready' WHEN campaign THEN 'campaign-backlog' ELSE 'legacy-backfill' END AS bucket,
  greatest(0, lacks - pending)::BIGINT AS remaining FROM i, t WHERE status <> 'complete'""")
def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    """The packets by priority; least is as much as the tables' reviews nearly reach."""
    packets, _ = _index(spark, d)
    packets = packets.withColumns({"campaign": F.size("campaign_ids") > 0, "scenario": F.col("scenario") != ""})
    return review.scoreboard(packets, packets.agg(F.sum("adjudicated").alias("adjudicated")), 250).select("packet", "pending", "priority", "bucket", "remaining")


@query("""
WITH c AS (SELECT doc_id FROM documents WHERE n_chars >= 1000), g AS (SELECT doc_id FROM labels WHERE quality = 1),
b AS (SELECT c.doc_id AS c, g.doc_id AS g FROM c FULL JOIN g USING (doc_id)),
s AS (SELECT count(*) FILTER (c IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (c IS NULL) AS fn FROM b)
SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM s""")
def precision_recall_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.precision_recall(table(spark, d, "documents").where("n_chars >= 1000"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query(f"""
WITH h AS ({SEARCH['canon_search']}), e AS (SELECT item_id AS query_id, printf('canon:%06d', min(doc_id)) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
r AS (SELECT query_id, min(h.rank) AS rank FROM e LEFT JOIN h USING (query_id, doc_id) GROUP BY query_id)
SELECT count(*) AS queries, round(avg(coalesce(rank <= 1, false)::INT), 4) AS hit_at_1, round(avg(coalesce(rank <= 3, false)::INT), 4) AS hit_at_3 FROM r""")
def hit_at_k_benchmark(spark: SparkSession, d: str) -> DataFrame:
    from loomspark.plans.search_queries import canon_search

    patterns = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    expected = search.holding(patterns, table(spark, d, "documents")).groupBy("query_id").agg(F.format_string("canon:%06d", F.min("doc_id")).alias("doc_id"))
    return evaluate.hit_rates(canon_search(spark, d), expected)


_SCORES = {
    "family_stability.exact_member_match_rate": "avg((n_chars >= 100)::INT)", "retrieval_metrics.family_hit_at_1": "avg((n_chars >= 400)::INT)", "retrieval_metrics.thread_hit_at_1": "avg((n_chars >= 1500)::INT)",
    "retrieval_metrics.pair_hit_at_3": "avg((n_chars >= 2500)::INT)", "answer_metrics.state_match_rate": "avg(quality)", "answer_metrics.required_citation_coverage_avg": "avg((lang = 'en')::INT)",
    "answer_metrics.forbidden_citation_violation_rate": "avg(toxic)", "answer_metrics.abstention_match_rate": "avg(CASE WHEN toxic = 1 THEN quality END)",
}


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Scorecards of the sources as corpora: shares of their labelled documents stand for the metrics."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    sums = rows.groupBy(F.col("source").alias("corpus_id")).agg(*(F.round(F.expr(e.replace("::INT", "").replace("avg((", "avg(if((").replace("))", "), 1, 0))") if "::INT" in e else e), 4).alias(f"m{i}") for i, e in enumerate(_SCORES.values())))
    return sums.select("corpus_id", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(_SCORES)))).alias("m")).select("corpus_id", "m.*")


_METRICS = "m AS (" + " UNION ALL ".join(f"SELECT source AS corpus_id, '{n}' AS metric, round({e}, 4) AS value FROM documents JOIN labels USING (doc_id) GROUP BY source" for n, e in _SCORES.items()) + ")"
_BOUNDS = """b AS (SELECT * FROM (VALUES ('family_stability.exact_member_match_rate', 'min', 1.0, 0.9), ('retrieval_metrics.family_hit_at_1', 'min', 0.9, 0.75), ('retrieval_metrics.thread_hit_at_1', 'min', 0.5, 0.3),
  ('retrieval_metrics.pair_hit_at_3', 'min', 0.5, 0.25), ('answer_metrics.state_match_rate', 'min', 0.9, 0.75), ('answer_metrics.required_citation_coverage_avg', 'min', 0.9, 0.75),
  ('answer_metrics.forbidden_citation_violation_rate', 'max', 0.0, 0.1), ('answer_metrics.abstention_match_rate', 'min', 0.9, 0.75)) v(metric, direction, pass, warn))"""
_GATES = f"""
{_METRICS}, {_BOUNDS}, g AS (SELECT corpus_id, metric, value, direction, pass::DOUBLE AS pass, warn::DOUBLE AS warn, CASE WHEN value IS NULL THEN 'skip'
  WHEN (direction = 'min' AND value >= pass) OR (direction = 'max' AND value <= pass) THEN 'pass' WHEN (direction = 'min' AND value >= warn) OR (direction = 'max' AND value <= warn) THEN 'warn' ELSE 'fail' END AS state FROM m JOIN b USING (metric)),
fixtures AS (SELECT source AS corpus_id, count(DISTINCT lang) = 4 AS manual FROM documents GROUP BY source),
o AS (SELECT corpus_id, CASE WHEN max(manual) THEN 'pass' ELSE 'warn' END AS reliability, CASE WHEN bool_or(state = 'fail') THEN 'fail' WHEN bool_or(state = 'warn') OR NOT max(manual) THEN 'warn' ELSE 'pass' END AS overall,
  count(*) FILTER (state = 'pass') AS n_pass, count(*) FILTER (state = 'warn') AS n_warn, count(*) FILTER (state = 'fail') AS n_fail, count(*) FILTER (state = 'skip') AS n_skip FROM g JOIN fixtures USING (corpus_id) GROUP BY corpus_id)"""


@query(f"WITH {_GATES} SELECT * FROM g")
def regression_gates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.gates(_metrics(spark, d), ["corpus_id"])


def _overall(spark: SparkSession, d: str) -> DataFrame:
    """States of the sources; a source with documents in four languages stands for one whose fixtures people wrote."""
    kinds = F.explode(F.array(*(F.lit(k) for k in evaluate.FIXTURES))).alias("kind")
    sources = table(spark, d, "documents").groupBy(F.col("source").alias("corpus_id")).agg((F.count_distinct("lang") == 4).alias("m")).select("corpus_id", kinds, F.when(F.col("m"), "manual").otherwise("seeded").alias("source"))
    return evaluate.overall(evaluate.gates(_metrics(spark, d), ["corpus_id"]), ["corpus_id"], sources)


@query(f"WITH {_GATES} SELECT * FROM o")
def evaluation_overall(spark: SparkSession, d: str) -> DataFrame:
    return _overall(spark, d)


def _corpora(spark: SparkSession, d: str) -> DataFrame:
    """Sources as active corpora: their gates' state, freshness by their number of documents, a contract if all are labelled enough."""
    docs = table(spark, d, "documents").groupBy(F.col("source").alias("corpus_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    state = F.when(F.col("n") % 4 == 0, "stale").when(F.col("n") % 4 == 1, "not_applicable").when(F.col("n") % 4 == 2, "fresh").otherwise(F.lit(None))
    return docs.join(_overall(spark, d).select("corpus_id", F.col("overall").alias("evaluation_state")), "corpus_id", "left").select("corpus_id", "evaluation_state", state.alias("freshness"), (F.col("chars") % 3 > 0).alias("valid_contract"))


_CASES = f"""{_GATES}, d0 AS (SELECT source AS corpus_id, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source),
cases AS (SELECT corpus_id, coalesce(overall = 'fail', false) AS gate_fail, coalesce(overall = 'warn', false) AS gate_warn, n % 4 IN (0, 3) AS stale_source, chars % 3 = 0 AS missing_contract, coalesce(overall = 'pass', false) AS manual_pass FROM d0 LEFT JOIN o USING (corpus_id)),
sums AS (SELECT count(*) AS active, count(*) FILTER (gate_fail) AS fails, count(*) FILTER (gate_warn) AS warns, count(*) FILTER (stale_source) AS stales, count(*) FILTER (missing_contract) AS missing,
  round(count(*) FILTER (manual_pass) / count(*), 4) AS rate FROM cases),
pg AS (SELECT 'max_fail_corpora' AS threshold, 'fail_corpus_count' AS metric, 'max' AS direction, 0.0::DOUBLE AS bound, fails::DOUBLE AS value FROM sums UNION ALL SELECT 'max_warn_corpora', 'warn_corpus_count', 'max', 0.0, warns FROM sums
  UNION ALL SELECT 'max_stale_corpora', 'stale_corpus_count', 'max', 0.0, stales FROM sums UNION ALL SELECT 'max_missing_contract_corpora', 'missing_contract_corpus_count', 'max', 0.0, missing FROM sums
  UNION ALL SELECT 'min_manual_pass_rate', 'manual_pass_rate', 'min', 1.0, rate FROM sums UNION ALL SELECT 'min_registered_active_corpora', 'active_corpus_count', 'min', 1.0, active FROM sums),
ps AS (SELECT *, CASE WHEN value IS NULL THEN 'skip' WHEN (direction = 'max' AND value <= bound) OR (direction = 'min' AND value >= bound) THEN 'pass' ELSE 'fail' END AS state FROM pg)"""


@query(f"WITH {_CASES} SELECT *, gate_fail OR gate_warn OR stale_source OR missing_contract AS review_required FROM cases")
def replay_cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.replay_cases(_corpora(spark, d)).drop("evaluation_state", "freshness", "valid_contract")


@query(f"WITH {_CASES} SELECT * FROM ps")
def policy_replay(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.policy_gates(evaluate.replay_summary(evaluate.replay_cases(_corpora(spark, d))), evaluate.normalized_policy(spark))


@query(f"WITH {_CASES} SELECT CASE WHEN bool_or(state = 'fail') THEN 'blocked' ELSE 'ready' END AS calibration, CASE WHEN bool_or(state = 'fail') THEN 'fail' ELSE 'pass' END AS reason FROM ps")
def policy_calibration(spark: SparkSession, d: str) -> DataFrame:
    summary = evaluate.replay_summary(evaluate.replay_cases(_corpora(spark, d)))
    return evaluate.calibration(evaluate.policy_gates(summary, evaluate.normalized_policy(spark)))


@query("""
WITH a AS (SELECT c_custkey AS k, max(c_name) AS v FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1),
b AS (SELECT c_custkey AS k, max(CASE WHEN c_custkey % 5 = 0 THEN c_name || '*' ELSE c_name END) AS v FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS old, b.k IS NOT NULL AS new, a.v AS v, b.v AS w FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (old AND new) AS shared, count(*) FILTER (NOT old) AS added, count(*) FILTER (NOT new) AS removed, count(*) FILTER (old AND new AND v <> w) AS relabelled,
 (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM j WHERE NOT old ORDER BY k LIMIT 10)) AS first_added,
 (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM j WHERE NOT new ORDER BY k LIMIT 10)) AS first_removed FROM j""")
def collection_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a keyed table: a carrier, in which rules on the key stand for what two builds would hold."""
    rows = table(spark, d, "customer")
    live = rows.where("c_custkey % 7 <> 0")
    candidate = rows.where("c_custkey % 11 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    return evaluate.keyed_delta(live, candidate, "c_custkey", "c_name")


@query("""
WITH a AS (SELECT o_custkey AS query_id, max_by(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS top_id FROM orders WHERE o_orderdate < '1996-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS query_id, max_by(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS top_id FROM orders GROUP BY 1)
SELECT CASE WHEN a.state IS NULL OR b.state IS NULL THEN 'missing' WHEN a.state <> b.state THEN 'state' WHEN a.top_id IS DISTINCT FROM b.top_id THEN 'evidence' ELSE 'same' END AS change,
 count(*) AS queries FROM a FULL JOIN b USING (query_id) GROUP BY 1""")
def query_replay_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")

    def answers(which: DataFrame) -> DataFrame:
        return which.groupBy(F.col("o_custkey").alias("query_id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"), F.max("o_orderkey").alias("top_id"))

    return evaluate.replay(answers(rows.where("o_orderdate < '1996-01-01'")), answers(rows)).groupBy("change").agg(F.count(F.lit(1)).alias("queries"))


@query("""
WITH t AS (SELECT s_suppkey AS target, s_suppkey % 13 <> 0 AS present, s_suppkey % 11 <> 0 AS contract, s_suppkey % 7 <> 0 AS guide, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_acctbal < 0 THEN 'warn' ELSE 'pass' END AS state,
  s_nationkey <> 3 AND s_suppkey % 3 <> 0 AS active, s_suppkey % 2 = 0 AS ready FROM supplier)
SELECT target, CASE WHEN NOT present THEN 'missing' WHEN NOT contract THEN 'missing-contract' WHEN NOT guide THEN 'imported-needs-bootstrap' WHEN state IS NULL THEN 'manual-eval-unrun' WHEN state <> 'pass' THEN 'manual-eval-pending'
  WHEN active THEN 'healthy-federation' ELSE 'calibration-pass' END AS readiness,
 CASE WHEN NOT present THEN CASE WHEN ready THEN 'import' ELSE 'place-export' END WHEN NOT contract THEN 'create-contract' WHEN NOT guide THEN 'bootstrap-eval' WHEN state IS NULL OR state <> 'pass' THEN 'run-evaluation'
  WHEN active THEN CASE WHEN ready THEN 'refresh' ELSE 'ready' END ELSE 'register' END AS next_step FROM t""")
def readiness_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as targets of providers: rules on the key stand for what is on disk and in the registry."""
    key = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        key.alias("target"), (key % 13 != 0).alias("present"), (key % 11 != 0).alias("has_contract"), (key % 7 != 0).alias("has_guide"),
        F.when(key % 5 == 0, F.lit(None)).when(F.col("s_acctbal") < 0, "warn").otherwise("pass").alias("evaluation_state"), (F.col("s_nationkey") != 3).alias("registered"),
        F.when(key % 3 != 0, "active").otherwise("retired").alias("registry_status"), F.when(key % 2 == 0, "ready").otherwise("empty").alias("upload_state"),
    )
    return evaluate.readiness(rows).select("target", "readiness", "next_step")


@query("""
WITH u AS (SELECT user_id, event_type, event_id % 50 AS subject, ts, event_id FROM events)
SELECT user_id, subject, arg_max(event_type, (ts, event_id)) AS verdict, max(event_id) FILTER (true) IS NOT NULL AS known FROM u GROUP BY ALL""")
def decision_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events as decisions on a subject by a user: the last one counts, whichever came before."""
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 50).alias("subject"), F.col("event_type").alias("verdict"), "ts", "event_id")
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return evaluate.upsert(old, new, ["user_id", "subject"], "ts", "event_id").select("user_id", "subject", "verdict", F.lit(True).alias("known"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_history_event(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


_FILES = "(SELECT source, printf('%06d.txt', doc_id) AS path, n_chars AS size, doc_id AS modified FROM documents)"
_PRINTS = f"(SELECT source, count(*) AS file_count, sum(size)::BIGINT AS total_size, left(sha256(string_agg(path || ':' || size || ':' || modified, '||' ORDER BY path || ':' || size || ':' || modified)), 24) AS fingerprint FROM {_FILES} GROUP BY source)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", F.format_string("%06d.txt", "doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"))


@query(f"SELECT * FROM {_PRINTS}")
def source_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.source_fingerprint(_files(spark, d), "source", "path", "size", "modified")


@query(f"""
WITH f AS (SELECT source AS corpus_id, fingerprint FROM {_PRINTS}),
c AS (SELECT corpus_id, corpus_id <> 'src1' AS tracked, CASE WHEN corpus_id = 'src2' THEN NULL WHEN corpus_id = 'src3' THEN 'old' ELSE fingerprint END AS snapshot FROM f UNION ALL SELECT 'gone', true, 'x')
SELECT corpus_id, CASE WHEN NOT tracked THEN 'not_applicable' WHEN fingerprint IS NULL THEN 'missing_source' WHEN snapshot IS NULL THEN 'missing_snapshot' WHEN snapshot = fingerprint THEN 'fresh' ELSE 'stale' END AS freshness
FROM c LEFT JOIN f USING (corpus_id)""")
def freshness_states(spark: SparkSession, d: str) -> DataFrame:
    now = lifecycle.source_fingerprint(_files(spark, d), "source", "path", "size", "modified").select(F.col("source").alias("corpus_id"), "fingerprint")
    cid = F.col("corpus_id")
    known = now.select(cid, (cid != "src1").alias("tracked"), F.when(cid == "src2", F.lit(None)).when(cid == "src3", "old").otherwise(F.col("fingerprint")).alias("snapshot"))
    gone = spark.createDataFrame([("gone", True, "x")], "corpus_id string, tracked boolean, snapshot string")
    return lifecycle.freshness(known.unionByName(gone), now).select("corpus_id", "freshness")


@query("""
WITH l AS (SELECT user_id AS id, max(ts) AS stamp FROM events GROUP BY 1), p AS (SELECT user_id AS id, max(ts) AS stamp FROM events WHERE event_id % 3 <> 0 GROUP BY 1)
SELECT l.id, CASE WHEN l.stamp = p.stamp THEN 'reuse' ELSE 'fetch' END AS action FROM l LEFT JOIN p USING (id)""")
def delta_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumnRenamed("user_id", "id")
    last = F.max("ts").alias("stamp")
    return lifecycle.delta(rows.groupBy("id").agg(last), rows.where("event_id % 3 <> 0").groupBy("id").agg(last), "id", "stamp").select("id", "action")


@query("""
WITH a AS (SELECT count(DISTINCT user_id) AS c FROM events WHERE event_type = 'error'), b AS (SELECT count(DISTINCT user_id) AS p FROM events)
SELECT c AS current, p AS prior, p = 0 OR c >= 0.5 * p AS allowed FROM a, b""")
def scope_preflight(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return lifecycle.scope_check(rows.where("event_type = 'error'"), rows, "user_id")


@query("SELECT date_trunc('hour', ts) AS since, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed(table(spark, d, "events"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(table(spark, d, "events"))


@query("""
SELECT n_nationkey AS corpus_id, n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey <> 0 AND n_nationkey % 4 = 2) AS is_default FROM nation""")
def registry_default(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("corpus_id"), F.when(F.col("n_regionkey") == 0, "retired").otherwise("active").alias("status"), (F.col("n_nationkey") % 4 == 2).alias("is_default"))
    return evaluate.one_default(rows).select("corpus_id", "is_default")


@query(f"""WITH {_JUDGED},
c AS (SELECT packet, count(*) AS total, count(*) FILTER (manual IN ('reject', 'keep', 'needs-context')) AS adjudicated FROM m GROUP BY packet)
SELECT *, CASE WHEN total = 0 THEN 'empty' WHEN adjudicated = 0 THEN 'pending' WHEN adjudicated = total THEN 'complete' ELSE 'partial' END AS status FROM c""")
def packet_summary(spark: SparkSession, d: str) -> DataFrame:
    return campaign.packet_status(_samples(spark, d))


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as samples: quality is the reviewer's outcome, length and toxicity stand for bucket and flags."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    bucket = F.when(F.col("n_chars") < 1000, "likely-reject").when(F.col("n_chars") > 5000, "alias-check").otherwise("mixed-review")
    flags = F.array_compact(F.array(F.when(F.col("toxic") == 1, "has-high-score-disjoint-pairs"), F.when(F.col("n_chars") < 500, "all-zero-overlap")))
    return rows.select(F.col("source").alias("packet"), F.col("doc_id").alias("sample"), F.lit("").alias("anchor"), F.array(F.col("doc_id").cast("string")).alias("review_ids"), bucket.alias("bucket"), flags.alias("flags"), F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("manual"))


_COMPARISON = """
r AS (SELECT source AS packet, doc_id, CASE quality WHEN 1 THEN 'keep' ELSE 'reject' END AS manual,
  CASE WHEN n_chars < 1000 AND toxic = 0 THEN 'reject' WHEN n_chars > 5000 THEN 'keep' ELSE 'needs-context' END AS outcome,
  CASE WHEN n_chars < 500 AND toxic = 0 THEN 'high' WHEN n_chars < 1000 OR n_chars > 5000 THEN 'medium' ELSE 'low' END AS confidence
  FROM documents JOIN labels USING (doc_id))"""


@query(f"""WITH {_COMPARISON}
SELECT packet, doc_id::VARCHAR AS key, manual, outcome AS assistant_outcome, confidence AS assistant_confidence, 'matched' AS side, manual = outcome AS agrees FROM r""")
def proposal_compare(spark: SparkSession, d: str) -> DataFrame:
    samples = _reviewed(spark, d)
    return campaign.compared(samples, campaign.propose(samples))


@query(f"""WITH {_COMPARISON},
s AS (SELECT confidence AS assistant_confidence, count(*) AS matched, 0 AS sample_only, 0 AS proposal_only, count(*) AS adjudicated, count(*) FILTER (manual = outcome) AS agreed,
  count(*) FILTER (outcome = 'reject') AS reject_proposed, count(*) FILTER (outcome = 'reject' AND manual = 'reject') AS reject_confirmed FROM r GROUP BY 1)
SELECT *, round(agreed / adjudicated, 4) AS agreement, CASE WHEN reject_proposed > 0 THEN round(reject_confirmed / reject_proposed, 4) END AS reject_precision FROM s""")
def rollup_confidence(spark: SparkSession, d: str) -> DataFrame:
    samples = _reviewed(spark, d)
    return campaign.rollup(campaign.compared(samples, campaign.propose(samples)), ["assistant_confidence"])


@query("""
SELECT n_nationkey::VARCHAR AS corpus_id, n_name AS title FROM nation WHERE contains(lower(concat_ws(' ', n_nationkey::VARCHAR, n_name)), '1')""")
def federation_index(spark: SparkSession, d: str) -> DataFrame:
    """A ledger filtered by a text in any of its values."""
    ledger = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("corpus_id"), F.col("n_name").alias("title"))
    return federation.query_index(ledger, "1", limit=1000)


@query()
def surface_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest for outside readers, of the sources as registered corpora, with what it lacks of its schema."""
    registry = table(spark, d, "documents").select(F.col("source").alias("corpus_id"), F.lit("active").alias("status"), (F.col("source") == "src0").alias("is_default")).distinct()
    payload = contracts.manifest(spark, registry, "2024-01-01")
    issues = contracts.schema_issues(payload, "surface-manifest").groupBy("id").agg(F.count(F.lit(1)).alias("issues"))
    return payload.join(issues, "id", "left").select("id", "payload", F.coalesce("issues", F.lit(0)).alias("issues"))


_FOLDER = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'notes/' ELSE 'notes/Attachments/' END || printf('%06d', doc_id) || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.json' WHEN 2 THEN '.png' ELSE '.txt' END"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a folder, with names by their ids."""
    folder = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "notes/").otherwise("notes/Attachments/")
    ext = F.when(F.col("doc_id") % 4 == 0, ".md").when(F.col("doc_id") % 4 == 1, ".json").when(F.col("doc_id") % 4 == 2, ".png").otherwise(".txt")
    return table(spark, d, "documents").select("doc_id", F.concat(folder, F.format_string("%06d", "doc_id"), ext).alias("path"), F.col("text").alias("content"))


@query(f"""WITH l AS (SELECT doc_id, {_FOLDER} AS path FROM documents)
SELECT 'markdown-document' AS adapter, path FROM l WHERE ends_with(path, '.md') UNION ALL SELECT 'markdown-transcript', path FROM l WHERE ends_with(path, '.md') OR contains(path, 'Attachments/')
UNION ALL SELECT 'chatgpt-export', path FROM l WHERE ends_with(path, '.json') UNION ALL SELECT 'grok-export', path FROM l WHERE NOT ends_with(path, '.png')""")
def source_files(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for adapter in ("markdown-document", "markdown-transcript", "chatgpt-export", "grok-export"):
        one = lifecycle.source_files(_listing(spark, d).select("path"), adapter).select(F.lit(adapter).alias("adapter"), "path")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT DISTINCT 'notes/Attachments' AS root FROM (SELECT {_FOLDER} AS path FROM documents) WHERE contains(path, 'Attachments/')")
def attachment_roots(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.attachment_roots(_listing(spark, d))


@query(f"SELECT doc_id, {_FOLDER} AS path, sha256(text) AS sha256 FROM documents")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.hashed(_listing(spark, d))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS at,
 json_extract(props, '$.k')::DOUBLE AS k FROM events""")
def event_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as text, and the number at a path of each event's properties."""
    rows = table(spark, d, "events")
    return rows.select("event_id", exports.iso_time(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), evaluate.metric(F.col("props"), "k").alias("k"))


@query("""SELECT n AS left_label, m AS right_label, count(*) AS documents FROM (SELECT least(lower(lang), lower(source)) AS n, greatest(lower(lang), lower(source)) AS m FROM documents
 WHERE lang <> '' AND source <> '' AND lower(lang) <> lower(source)) GROUP BY ALL""")
def normalized_pairs(spark: SparkSession, d: str) -> DataFrame:
    pair = evaluate.normalized_pair(F.array("lang", "source"), labels=True)
    return table(spark, d, "documents").select(pair.alias("p")).where("p is not null").groupBy(F.col("p")[0].alias("left_label"), F.col("p")[1].alias("right_label")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT key, sum(n)::BIGINT AS n FROM (SELECT lang AS key, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, count(*) FROM documents GROUP BY 1 UNION ALL SELECT lang, count(*) FROM documents JOIN labels USING (doc_id) GROUP BY 1) GROUP BY key")
def merged_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    parts = [rows.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")) for rows, c in ((docs, "lang"), (docs, "source"), (docs.join(table(spark, d, "labels"), "doc_id"), "lang"))]
    return evaluate.merged_counts(*parts)


_REGISTRY = "r AS (SELECT printf('s%d', s_suppkey) AS corpus_id, CASE WHEN s_acctbal < 0 THEN 'retired' ELSE 'active' END AS status, s_suppkey % 9 = 4 AS is_default, printf('/data/%d', s_nationkey) AS root FROM supplier)"


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as registered corpora, in a folder by nation."""
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.format_string("s%d", key).alias("corpus_id"), F.when(F.col("s_acctbal") < 0, "retired").otherwise("active").alias("status"), (key % 9 == 4).alias("is_default"), F.format_string("/data/%d", "s_nationkey").alias("root"))


@query(f"WITH {_REGISTRY} SELECT count(*) AS corpora, count(*) FILTER (status = 'active') AS active, min(corpus_id) FILTER (status = 'active' AND is_default) AS default_corpus FROM r")
def registry_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return federation.snapshot(_registry(spark, d))


@query(f"""WITH {_REGISTRY}, t AS (SELECT printf('s%d', c_custkey) AS corpus_id, printf('/data/%d', c_nationkey) AS root FROM customer),
b AS (SELECT root, arg_max(status, corpus_id) AS status, arg_max(is_default, corpus_id) AS is_default FROM r GROUP BY root), k AS (SELECT DISTINCT printf('/data/%d', n_nationkey) AS root FROM nation WHERE n_nationkey % 2 = 0)
SELECT t.corpus_id, t.root, r.status IS NOT NULL OR b.status IS NOT NULL AS registered, coalesce(r.status, b.status) AS registry_status, coalesce(r.is_default, b.is_default, false) AS is_default, k.root IS NOT NULL AS has_contract
FROM t LEFT JOIN r ON r.corpus_id = t.corpus_id LEFT JOIN b ON b.root = t.root LEFT JOIN k ON k.root = t.root""")
def inspected_targets(spark: SparkSession, d: str) -> DataFrame:
    """Customers as targets, registered by their number or else by their nation's folder."""
    targets = table(spark, d, "customer").select(F.format_string("s%d", "c_custkey").alias("corpus_id"), F.format_string("/data/%d", "c_nationkey").alias("root"))
    contracts = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.format_string("/data/%d", "n_nationkey").alias("root"))
    return federation.inspected(targets, _registry(spark, d), contracts)
