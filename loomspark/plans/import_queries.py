"""Queries over the tables that an import of the conversations makes, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import importing
from loomspark.plans import sqltext as S
from loomspark.plans.shared import table, written
from loomspark.plans.text_queries import PAIRS_SQL

QUERIES = {}
SQL = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The conversations as an export without titles: (conversations, messages, raw)."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("cid"), F.col("conv_id").alias("at"), "turn", F.lower(F.coalesce("role", F.lit(""))).alias("role"), T.normalize_space("text").alias("text"))
    none = F.lit(None).cast("string")
    own = rows.select("cid", "at").distinct().select("cid", "at", none.alias("title"), none.alias("stamp"))
    return own, rows.where("role <> 'system'").select("cid", "turn", "role", "text", F.lit(False).alias("hidden")), rows.select("cid", "role", F.lit("text").alias("kind"), F.lit(True).alias("entry"))


def _base(spark: SparkSession, d: str) -> DataFrame:
    own, messages, _ = _sources(spark, d)
    return importing.threads(own, messages, "mapping")


_TITLE = f"coalesce(nullif({S.shorten('prompt', 120)}, ''), printf('ChatGPT Conversation %04d', \"at\"))"
_SLUG = S.slug("title || '-' || left(cid, 8)", 96)
_WORDS = f"list_transform(coalesce(keywords, [])[1:3], lambda k: {S.title_case(chr(34) + 'replace' + chr(34) + '(k, chr(45), chr(32))')})"
THREADS_SQL = f"""
m AS (SELECT conv_id::VARCHAR AS cid, conv_id AS "at", turn, lower(coalesce(role, '')) AS role, {S.space('text')} AS text FROM conversations),
k AS (SELECT * FROM m WHERE text <> '' AND role <> 'system'),
t AS (SELECT cid, min("at") AS "at", string_agg(text, chr(10) ORDER BY turn) AS combined, arg_min(text, CASE WHEN role = 'user' THEN turn END) AS prompt FROM k GROUP BY cid),
h AS (SELECT *, {_TITLE} AS title FROM t),
u AS (SELECT *, {_SLUG} AS slug, {S.sentences('combined')} AS s FROM h),
w AS (SELECT cid, unnest(x) AS token, generate_subscripts(x, 1) AS pos FROM (SELECT cid, {S.content('combined', T.CHAT_STOP_WORDS)} AS x FROM t)),
c AS (SELECT cid, token, count(*) AS n, min(pos) AS first FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n DESC, first) AS rank FROM c),
kw AS (SELECT cid, list(token ORDER BY rank) AS keywords FROM r WHERE rank <= 12 GROUP BY cid),
b AS (SELECT u.*, coalesce(kw.keywords, []) AS keywords FROM u LEFT JOIN kw USING (cid)),
e AS (SELECT *, list_concat([title], {_WORDS}) AS named FROM b),
base AS (SELECT * EXCLUDE (named), {S.distinct_ignoring_case('named')} AS entities, {S.shorten("coalesce(nullif(array_to_string(s[1:3], ' '), ''), combined)", 320)} AS summary FROM e)"""


@query(f"""WITH {THREADS_SQL} SELECT cid AS conversation_id, 'thread-' || slug AS thread_uid, 'family-' || slug AS family_id, title, summary, array_to_string(keywords, ',') AS keywords,
 array_to_string(entities, '|') AS entities, md5(title || ' ' || combined) AS search_md5 FROM base""")
def imported_threads(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select(F.col("cid").alias("conversation_id"), "thread_uid", "family_id", "title", "summary", F.array_join("keywords", ",").alias("keywords"), F.array_join("entities", "|").alias("entities"), F.md5(F.concat_ws(" ", "title", "combined")).alias("search_md5"))


def _made(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    own, messages, raw = _sources(spark, d)
    return importing.tables(written(own, "conversations"), written(messages, "messages"), raw, "mapping")


@query(f"""WITH {THREADS_SQL}, p AS ({PAIRS_SQL}) SELECT 'thread-' || slug || printf('-pair-%03d', p.pair_index) AS pair_id, p.title, p.summary, md5('thread-' || slug || printf('-pair-%03d', p.pair_index) || ' ' || p.prompt || ' ' || p.response) AS search_md5,
 array_to_string(entities, '|') AS entities FROM p JOIN base ON base.cid = p.thread::VARCHAR""")
def imported_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d)["pairs-index"].select("pair_id", "title", "summary", F.md5("search_text").alias("search_md5"), F.array_join("entities", "|").alias("entities"))


@query(f"""WITH {THREADS_SQL} SELECT 'family-' || slug AS family_id, 'thread-' || slug AS canonical_thread_uid, array_to_string(keywords[1:8], ',') AS stable_themes,
 title || ' currently centers on ' || array_to_string(keywords[1:4], ', ') || '. Imported from ChatGPT export source.' AS brief_text, md5(title || ' ' || array_to_string(keywords[1:10], ' ') || ' ' || combined) AS search_md5 FROM base""")
def imported_briefs(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d)["doctrine-briefs"].select("family_id", "canonical_thread_uid", F.array_join("stable_themes", ",").alias("stable_themes"), "brief_text", F.md5("search_text").alias("search_md5"))


@query(f"""WITH {THREADS_SQL}, x AS (SELECT "at", unnest(entities) AS label, generate_subscripts(entities, 1) AS pos FROM base)
SELECT 'entity-' || {S.slug('canonical_label', 64)} AS canonical_entity_id, canonical_label, entity_type FROM
 (SELECT arg_min(label, "at" * 10 + pos) AS canonical_label, CASE WHEN arg_min(pos, "at" * 10 + pos) = 1 THEN 'conversation' ELSE 'concept' END AS entity_type FROM x GROUP BY lower(label))""")
def imported_entities(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d)["canonical-entities"].drop("entity_key")


@query(f"""WITH {THREADS_SQL}, x AS (SELECT "at", title, unnest(entities) AS label, generate_subscripts(entities, 1) AS pos FROM base),
 n AS (SELECT lower(label) AS k, arg_min(label, "at" * 10 + pos) AS canonical_label FROM x GROUP BY 1), a AS (SELECT lower(label) AS k, lower(title) AS t, arg_min(title, "at" * 10 + pos) AS label, min("at") AS "at" FROM x GROUP BY 1, 2)
SELECT canonical_label, label, "at" FROM a JOIN n USING (k)""")
def imported_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d)["entity-aliases"]


@query(f"""WITH {THREADS_SQL}, q AS (SELECT cid, count(*) AS mapping_node_count, count(*) FILTER (role <> 'system') AS path_node_count, count(*) FILTER (role <> 'system' AND text <> '') AS retained_count,
 count(*) FILTER (role <> 'system' AND text = '') AS skipped_count, count(*) FILTER (role = 'system') AS system_count, count(*) FILTER (role = 'user') AS user_count FROM m GROUP BY cid)
SELECT 'thread-' || slug AS thread_uid, q.* EXCLUDE (cid), round(retained_count / path_node_count, 4) AS retention_ratio,
 concat_ws(',', CASE WHEN round(retained_count / path_node_count, 4) < 0.65 AND path_node_count > 4 THEN 'low_retention' END, CASE WHEN skipped_count > 5 THEN 'high_empty_render' END) AS quality_flags FROM q JOIN base USING (cid)""")
def import_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d)["import-audit"]
    of = [F.coalesce(F.try_element_at("raw_role_counts", F.lit(r)), F.lit(0)).alias(f"{r}_count") for r in ("system", "user")]
    return rows.select("thread_uid", "mapping_node_count", "path_node_count", "retained_count", "skipped_count", *of, "retention_ratio", F.array_join("quality_flags", ",").alias("quality_flags"))


@query(f"""WITH {THREADS_SQL}, p AS (SELECT thread::VARCHAR AS cid, count(*) AS pair_count FROM ({PAIRS_SQL}) GROUP BY 1)
SELECT cid AS conversation_uuid, 'thread-' || slug AS thread_uid, 'family-' || slug AS family_id, coalesce(pair_count, 0) AS pair_count, title, "at" FROM base LEFT JOIN p USING (cid)""")
def import_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d)["import-manifest"]
