"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, edit_counts, exact_dedup, katz, langid, passages, pieces, pii, simhash, url_lists
from loomspark.llm._common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("fingerprint")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on days of 2024 by page_id; list entries come from the hosts by their MD5.

    A third of the hosts and domains is listed on some day and taken off 90 days later; half of those come back.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched_at"))
    host = url_lists.host_of(F.col("url"))
    value = F.explode(F.array(F.col("h"), F.regexp_replace("h", r"^(www|m|blog)\.", "")))
    names = pages.select(host.alias("h")).where("h is not null").distinct().select(value.alias("value")).distinct()
    rows = names.withColumn("x", F.conv(F.substring(F.md5("value"), 1, 4), 16, 10).cast("int")).where("x % 3 = 0")
    rows = rows.withColumns({"list": F.when(F.col("x") % 2 == 0, "adult").otherwise("malware"), "since": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("x") % 200).cast("int"))})

    def entry(days: int, action: str) -> DataFrame:
        return rows.select("list", "value", F.date_add("since", days).alias("at"), F.lit(action).alias("action"), "x")

    entries = entry(0, "add").unionByName(entry(90, "remove")).unionByName(entry(150, "add").where("x % 4 < 2")).drop("x")
    return url_lists.active_entries(pages, entries)


def op9_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of each document: a replacement a third in, an insertion half way, a deletion at the start."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")

    def edit(seq, start, stop, new):  # noqa: ANN001, ANN202
        return F.struct(F.lit(seq).cast("long").alias("seq"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), new.alias("new"))

    third, half = F.floor(n / 3), F.floor(n / 2)
    edits = F.array(edit(0, third, third + 12, F.lit(" amended")), edit(1, half, half, F.substring("text", 1, 24)), edit(2, F.lit(0), F.lit(5), F.lit("")))
    return edit_counts.counts_with_edits(docs.withColumn("edits", edits))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_passages": op2_passages,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_personal_data": op5_personal_data,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pieces": op7_pieces,
    "op8_url_lists": op8_url_lists,
    "op9_edited_counts": op9_edited_counts,
    "op10_katz": op10_katz,
}

_EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_HOST = r"nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '')"
_LISTS = f"""
WITH c AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS fetched_at, {_HOST} AS host FROM pages),
v AS (SELECT host AS value FROM c WHERE host IS NOT NULL UNION SELECT regexp_replace(host, '^(www|m|blog)\\.', '') FROM c WHERE host IS NOT NULL),
x AS (SELECT value, ('0x' || substr(md5(value), 1, 4))::INT AS x FROM v),
l AS (SELECT *, CASE WHEN x % 2 = 0 THEN 'adult' ELSE 'malware' END AS list, DATE '2024-01-01' + x % 200 AS since FROM x WHERE x % 3 = 0),
i AS (SELECT list, value, since, since + 90 AS until FROM l UNION ALL SELECT list, value, since + 150, NULL FROM l WHERE x % 4 < 2),
h AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT value, ',' ORDER BY value) AS vals
      FROM c JOIN i ON (host = value OR ends_with(host, '.' || value)) AND since <= fetched_at AND (until IS NULL OR fetched_at < until) GROUP BY page_id)
SELECT page_id, host, fetched_at, coalesce(n, 0) AS n_active, n IS NOT NULL AS blocked, coalesce(lists, '') AS lists, coalesce(vals, '') AS values FROM c LEFT JOIN h USING (page_id)
"""


def _personal_sql() -> str:
    """Each kind's matches with their places, checked; then the sums, spans and scores of each document."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?",
        "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    twice = f"(2 * substr({digits}, i, 1)::INT)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN CASE WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END ELSE substr({digits}, i, 1)::INT END)) % 10 = 0"
    flat = "replace(v, ' ', '')"
    turned = f"(substr({flat}, 5) || left({flat}, 4))"
    number = f"array_to_string(list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN substr({turned}, i, 1) >= 'A' THEN (ascii(substr({turned}, i, 1)) - 55)::VARCHAR ELSE substr({turned}, i, 1) END), '')"
    rest = f"list_reduce(list_transform(string_split({number}, ''), lambda d: d::INT), lambda a, d: (a * 10 + d) % 97) = 1"
    valid = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(right(p, 4) AS INT), 999) <= 255))",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({flat}) BETWEEN 15 AND 34 AND {rest}",
        "ssn": "true",
    }
    parts, found = [], []
    for n, (kind, pattern) in enumerate(plain.items()):
        least, more = pii.SCORES[kind]
        parts.append(f"{kind}0 AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}'))")
        parts.append(f"{kind}1 AS (SELECT doc_id, t, m[i] AS v, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM {kind}0, unnest(range(1, len(m) + 1)) u(i))")
        near = f"lower(substr(t, greatest(s - {pii.BEFORE}, 0)::INT + 1, (s - greatest(s - {pii.BEFORE}, 0))::INT) || ' ' || substr(t, (s + length(v))::INT + 1, {pii.AFTER}))"
        score = f"{least} + CASE WHEN regexp_matches({near}, '{pii.CONTEXT[kind]}') THEN {more} ELSE 0 END"
        also = "" if kind in pii.BASE else f" AND {score} >= {pii.LEAST}"
        found.append(f"SELECT doc_id, {n} AS k, '{kind}' AS kind, s::BIGINT AS s, (s + length(v))::BIGINT AS e, {score} AS score FROM {kind}1 WHERE {valid[kind]}{also}")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    span = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(parts)}, f AS ({" UNION ALL ".join(found)}),
g AS (SELECT doc_id, {counts}, coalesce(string_agg({span}, ',' ORDER BY k, s) FILTER (k < 4), '') AS base, string_agg({span}, ',' ORDER BY k, s) AS spans,
      string_agg({span} || ':' || score, ',' ORDER BY k, s) AS scores FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL = {"op5_personal_data": _personal_sql(), "op6_exact_dedup": _EXACT, "op8_url_lists": _LISTS}
