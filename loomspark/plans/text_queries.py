"""Queries over documents, pages and conversations, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import corpus, neardup, terms
from loomspark.plans import sqltext as S
from loomspark.plans.shared import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"SELECT doc_id, {S.slug('left(text, 80)')} AS slug FROM documents")
def slugify_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.slugify(F.left("text", F.lit(80))).alias("slug"))


@query(f"SELECT doc_id, {S.shorten('text', 220)} AS summary FROM documents")
def shorten_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.shorten("text", 220).alias("summary"))


@query(f"SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)")
def sentence_split_terminal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.split_sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def _terms_sql(limit: int) -> str:
    return f"""
WITH t AS (SELECT doc_id, unnest(x) AS token, generate_subscripts(x, 1) AS pos
           FROM (SELECT doc_id, {S.content('text', T.CHAT_STOP_WORDS)} AS x FROM documents)),
     c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM t GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank, max(n) OVER (PARTITION BY doc_id) AS top FROM c)
SELECT doc_id, token, n, rank, round(n / top, 4) AS weight FROM r WHERE rank <= {limit}"""


@query(f"SELECT doc_id, token, n, rank FROM ({_terms_sql(12)})")
def top_keywords_documents(spark: SparkSession, d: str) -> DataFrame:
    found = terms.ranked_terms(table(spark, d, "documents"), "doc_id", "text", 12, T.CHAT_STOP_WORDS)
    return found.select("doc_id", "token", "n", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT doc_id, token, weight FROM ({_terms_sql(18)})")
def vector_terms_documents(spark: SparkSession, d: str) -> DataFrame:
    return terms.ranked_terms(table(spark, d, "documents"), "doc_id", "text", 18, T.CHAT_STOP_WORDS).select("doc_id", "token", "weight")


#: Markers of actions and of open questions that the tables' invented prose has; it holds none of the operator's own.
ACTIONS, QUESTIONS = ["tion", "ung "], ["ing ", "eau"]
_LEDGER = f"""
WITH s AS (SELECT doc_id, {S.sentences('text')} AS s FROM documents),
     a AS (SELECT doc_id, {S.marked('s', ACTIONS, False)} AS x, {S.marked('s', QUESTIONS, True)} AS y FROM s),
     u AS (SELECT doc_id, {S.distinct_ignoring_case('x')}[1:6] AS x, {S.distinct_ignoring_case('y')}[1:5] AS y FROM a),
     r AS (SELECT doc_id, 'action' AS kind, unnest(x) AS item, generate_subscripts(x, 1) - 1 AS position FROM u
           UNION ALL SELECT doc_id, 'unresolved', unnest(y), generate_subscripts(y, 1) - 1 FROM u)
SELECT doc_id, position::BIGINT AS position, item, {S.slug('item')} AS item_key FROM r WHERE kind = '@'"""


@query(_LEDGER.replace("@", "action"))
def extract_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.ledgers(table(spark, d, "documents"), "doc_id", "text", ACTIONS, QUESTIONS).where("kind = 'action'")
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), "item", "item_key")


@query(_LEDGER.replace("@", "unresolved"))
def extract_unresolved(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.ledgers(table(spark, d, "documents"), "doc_id", "text", ACTIONS, QUESTIONS).where("kind = 'unresolved'")
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), "item", "item_key")


ENTITIES_SQL = f"""
WITH k AS ({_terms_sql(3)}),
     e AS (SELECT doc_id, 0 AS position, {S.space('left(text, 60)')} AS label, 'conversation' AS entity_type FROM documents
           UNION ALL SELECT doc_id, rank, {S.title_case("replace(token, '-', ' ')")}, 'concept' FROM k),
     f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(label) ORDER BY position) AS n FROM e WHERE label <> '')
SELECT doc_id, label, entity_type, position::BIGINT AS position FROM f WHERE n = 1"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("title", F.left("text", F.lit(60)))
    return corpus.entities(docs, "doc_id", "title", "text")


@query(ENTITIES_SQL)
def keyword_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).withColumn("position", F.col("position").cast("long"))


@query(f"""
WITH e AS ({ENTITIES_SQL}), t AS (SELECT doc_id, left(text, 60) AS title FROM documents)
SELECT lower(label) AS entity_key, arg_min(label, (doc_id, position)) AS label, arg_min(entity_type, (doc_id, position)) AS entity_type,
       count(DISTINCT doc_id) AS documents, min(title) AS first_alias
FROM e JOIN t USING (doc_id) GROUP BY 1""")
def entity_alias_accumulate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("title", F.left("text", F.lit(60)))
    return corpus.entity_aliases(entities(spark, d), docs, "doc_id", "title")


@query(f"SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {S.strip_html('html')} AS t FROM pages)")
def strip_html_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", T.strip_html("html").alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


_MESSAGES = f"SELECT conv_id AS thread, turn, lower(coalesce(role, '')) AS role, {S.space('text')} AS text FROM conversations"
_KEPT = f"SELECT * FROM ({_MESSAGES}) WHERE text <> '' AND role <> 'system'"
PAIRS_SQL = f"""
WITH m AS ({_KEPT}),
     g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM m WHERE role IN ('user', 'assistant')),
     f AS (SELECT thread, g, max(CASE WHEN role = 'user' THEN text END) AS asked, coalesce(string_agg(CASE WHEN role <> 'user' THEN text END, ' ' ORDER BY turn), '') AS response FROM g GROUP BY ALL),
     p AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY g) AS pair_index, coalesce(asked, '[assistant-led]') AS prompt FROM f)
SELECT thread, pair_index, printf('%s-pair-%03d', thread::VARCHAR, pair_index) AS pair_id, prompt, response,
       CASE WHEN asked IS NULL THEN 'Assistant-Led Turn' ELSE {S.shorten('prompt', 80)} END AS title,
       {S.shorten("'User: ' || prompt || ' Assistant: ' || response", 240)} AS summary,
       printf('%s-pair-%03d', thread::VARCHAR, pair_index) || ' ' || prompt || ' ' || response AS search_text
FROM p"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.retained(table(spark, d, "conversations"))


@query(f"SELECT thread, pair_index::BIGINT AS pair_index, pair_id, title, summary, md5(search_text) AS search_md5 FROM ({PAIRS_SQL})")
def pairs_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.pairs(messages(spark, d))
    return rows.select("thread", F.col("pair_index").cast("long").alias("pair_index"), "pair_id", "title", "summary", F.md5("search_text").alias("search_md5"))


@query(f"""
SELECT thread, {S.shorten("coalesce(arg_min(text, CASE WHEN role = 'user' THEN turn END), arg_min(text, turn))", 120)} AS title,
       md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, count(*) AS message_count FROM ({_KEPT}) GROUP BY thread""")
def thread_summary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.threads(messages(spark, d)).select("thread", "title", F.md5("thread_text").alias("text_md5"), "message_count")


@query(f"""
WITH m AS (SELECT thread, CASE WHEN role = '' THEN 'none' ELSE role END AS role, text = '' AS blank, role <> 'system' AS path FROM ({_MESSAGES})),
     a AS (SELECT thread, count(*) AS message_count, count(*) FILTER (path) AS path_count, count(*) FILTER (path AND NOT blank) AS retained_count,
                  count(*) FILTER (path AND blank) AS skipped_count, count(*) FILTER (role = 'user') AS user_count,
                  count(*) FILTER (role = 'assistant') AS assistant_count FROM m GROUP BY thread),
     r AS (SELECT *, CASE WHEN path_count = 0 THEN 0.0 ELSE round(retained_count / path_count, 4) END AS retention_ratio FROM a)
SELECT *, concat_ws(',', CASE WHEN retention_ratio < 0.65 AND path_count > 4 THEN 'low_retention' END, CASE WHEN skipped_count > 5 THEN 'high_empty_render' END) AS quality_flags FROM r""")
def thread_audit(spark: SparkSession, d: str) -> DataFrame:
    return corpus.audit(table(spark, d, "conversations"))


@query(f"SELECT thread, arg_min(text, turn) AS prompt FROM ({_KEPT}) WHERE role = 'user' GROUP BY thread")
def first_user_prompt(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_prompts(messages(spark, d))


@query(f"""
WITH p AS (SELECT arg_min(text, turn) AS t, thread AS k FROM ({_KEPT}) WHERE role = 'user' GROUP BY thread),
     s AS (SELECT k, {S.trigrams('t')} AS g FROM p),
     j AS (SELECT a.k AS left_key, b.k AS right_key, len(list_intersect(a.g, b.g)) AS i, len(a.g) AS n, len(b.g) AS m
           FROM s a JOIN s b ON a.k < b.k AND list_has_any(a.g, b.g) WHERE len(a.g) > 0 AND len(b.g) > 0)
SELECT left_key, right_key, round(i / (n + m - i), 4) AS jaccard FROM j WHERE i / (n + m - i) >= 0.2""")
def trigram_jaccard_candidates(spark: SparkSession, d: str) -> DataFrame:
    """First prompts that share trigrams; the tables have none as alike as the operator's own threshold asks, so a lower one."""
    return neardup.trigram_pairs(corpus.first_prompts(messages(spark, d)), "thread", "prompt", 0.2)


@query()
def near_duplicate_threads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as threads of one prompt each, as an import of documents makes them."""
    docs = table(spark, d, "documents").withColumn("title", T.shorten("text", 60))
    return neardup.near_duplicates(docs, "doc_id", "text", "title")
