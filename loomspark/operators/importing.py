"""Conversations to all the tables of a corpus: threads, pairs, briefs, dossiers, ledgers, entities, audits, manifest.

Input is a frame of conversations (cid, at, title, stamp), ``at`` being their order, and one of messages (cid, turn, role,
text, hidden). ``hidden`` marks a message that has nothing to show by its kind. Conversations without any text are left
out. What a table gathers in one row comes from one conversation; what comes from many (the aliases of an entity) is rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import corpus, neardup, terms
from loomspark.operators.contracts import CONTRACT, VERSION
from loomspark.plans.shared import written

# How each kind of export is named in ids, states, tags and titles.
KINDS = {"mapping": ("chatgpt", "ChatGPT"), "message-list": ("claude", "Claude")}
WHY_UNRESOLVED = "Imported {} export conversation still implies an open question or unresolved branch."
NOT_EVALUATED = "Imported {} export corpus has not been manually evaluated."
ACTIONS, QUESTIONS, KEYWORDS = 6, 5, 12


def fallback_id(kind: str, at: Column) -> Column:
    return F.format_string(f"{KINDS[kind][0]}-%04d", at)


def _counts(rows: DataFrame, name: str, label: str) -> DataFrame:
    """(cid, name): a map of how often each label occurs in a conversation."""
    sums = rows.groupBy("cid", label).agg(F.count(F.lit(1)).alias("n"))
    return sums.groupBy("cid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias(name))


def audits(messages: DataFrame, raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per conversation: entries, messages, kept, skipped and wrongly blank ones, retention, counts by role and kind, flags.

    raw: (cid, role, kind, entry) of all entries of the export, the system's among them; ``entry`` is false for the second
    and further kinds of one message. pairs: (cid, summary).
    """
    blank = F.col("text") == ""
    sums = messages.groupBy("cid").agg(F.count(F.lit(1)).alias("path_node_count"), F.count_if(~blank).alias("retained_count"), F.count_if(blank).alias("skipped_count"), F.count_if(blank & ~F.col("hidden")).alias("empty_render_count"))
    entries = raw.groupBy("cid").agg(F.count_if("entry").alias("mapping_node_count"))
    bare = pairs.groupBy("cid").agg(F.count_if(F.trim("summary") == "").alias("_bare"))
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("none")).alias("role")
    parts = [sums, bare, _counts(raw.where("entry").select("cid", role), "raw_role_counts", "role"), _counts(raw.where("kind is not null"), "raw_content_type_counts", "kind"), _counts(messages.select("cid", role), "path_role_counts", "role")]
    rows = reduce(lambda a, b: a.join(b, "cid", "left"), parts, entries)
    rows = rows.fillna(0, ["path_node_count", "retained_count", "skipped_count", "empty_render_count", "_bare"])
    ratio = F.when(F.col("path_node_count") == 0, F.lit(0.0)).otherwise(F.round(F.col("retained_count") / F.col("path_node_count"), 4))
    rows = rows.withColumn("retention_ratio", ratio)
    flags = [F.when((F.col("retention_ratio") < 0.65) & (F.col("path_node_count") > 4), "low_retention"), F.when(F.col("empty_render_count") > 5, "high_empty_render"), F.when(F.col("_bare") > 0, "pair_without_response")]
    return rows.withColumn("quality_flags", F.array_compact(F.array(*flags))).drop("_bare")


def threads(conversations: DataFrame, messages: DataFrame, kind: str) -> DataFrame:
    """The conversations that have text, with what all tables say of them: ids, title, text, keywords, ledgers, entities."""
    name, shown = KINDS[kind]
    said = messages.where("text <> ''")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    first_user = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    text = said.groupBy("cid").agg(F.array_join(lines, "\n").alias("combined"), first_user.alias("prompt"), F.min_by("text", "turn").alias("_any"))
    head = T.shorten("prompt" if kind == "mapping" else "_any", 120)
    title = F.coalesce(F.nullif(T.normalize_space("title"), F.lit("")), F.nullif(head, F.lit("")), F.format_string(f"{shown} Conversation %04d", "at"))
    rows = conversations.join(text, "cid").withColumn("title", title).drop("_any")
    slug = T.slugify(F.concat("title", F.lit("-"), F.left(F.col("cid"), F.lit(8))), 96)
    rows = rows.withColumn("family_id", F.concat(F.lit("family-"), slug)).withColumn("thread_uid", F.concat(F.lit("thread-"), slug))
    rows = rows.join(terms.term_maps(rows, "cid", "combined", 18, T.CHAT_STOP_WORDS), "cid", "left")
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("keywords", F.slice(F.coalesce("keywords", none), 1, KEYWORDS)).withColumn("vector_terms", F.coalesce("vector_terms", F.expr("cast(map() as map<string,double>)")))
    rows = rows.withColumn("_s", T.split_sentences("combined"))
    rows = rows.withColumn("actions", T.extract_actions(F.col("_s"), ACTIONS)).withColumn("questions", T.extract_unresolved(F.col("_s"), QUESTIONS))
    start = F.nullif(F.array_join(F.slice("_s", 1, 3), " "), F.lit(""))
    rows = rows.withColumn("summary", T.shorten(F.coalesce(start, "combined"), 320)).drop("_s")
    words = F.transform(F.slice("keywords", 1, 3), lambda k: T.title_case(F.replace(k, F.lit("-"), F.lit(" "))))
    return rows.withColumn("entities", T.distinct_ignoring_case(F.concat(F.array("title"), words)))


def _pairs(base: DataFrame, messages: DataFrame, kind: str) -> DataFrame:
    said = messages.where("text <> ''").select(F.col("cid").alias("thread"), "turn", "role", "text")
    rows = corpus.pairs(said, any_responder=kind != "mapping").withColumnRenamed("thread", "cid").withColumn("body", F.concat_ws(" ", "prompt", "response")).withColumn("_k", F.concat_ws(" ", "cid", "pair_index"))
    rows = rows.drop("pair_id", "search_text").join(base.select("cid", "thread_uid", "family_id", "entities"), "cid")
    terms_of = terms.term_maps(rows, "_k", "body", 18, T.CHAT_STOP_WORDS)
    rows = rows.join(terms_of, "_k", "left").withColumn("pair_id", F.format_string("%s-pair-%03d", "thread_uid", "pair_index"))
    themes = F.slice(F.coalesce("keywords", F.expr("cast(array() as array<string>)")), 1, 8)
    search = F.concat_ws(" ", "pair_id", "prompt", "response")
    return rows.select("cid", "pair_id", "thread_uid", "title", "summary", search.alias("search_text"), themes.alias("themes"), "entities", F.array("family_id").alias("family_ids"), F.coalesce("vector_terms", F.expr("cast(map() as map<string,double>)")).alias("vector_terms"))


def tables(conversations: DataFrame, messages: DataFrame, raw: DataFrame, kind: str, bundle: str = "source", thread_path: str = "source/conversations.json") -> dict[str, DataFrame]:
    """All tables of a corpus by name. ``conversations`` and ``messages`` are read several times: written ones serve best."""
    name, shown = KINDS[kind]
    base = written(threads(conversations, messages, kind), "threads")
    pairs = written(_pairs(base, messages, kind), "pairs")
    audit = written(base.select("cid", "thread_uid").join(audits(messages, raw, pairs), "cid"), "audits")
    near = neardup.near_duplicates(base.select("at", F.coalesce("prompt", F.lit("")).alias("prompt"), F.struct("thread_uid", "title").alias("who")), "at", "prompt", "who")
    family, uid, title = F.array("family_id").alias("family_ids"), F.array("thread_uid").alias("thread_uids"), F.col("title")
    key = [F.col("title").alias("canonical_title"), F.col("thread_uid").alias("canonical_thread_uid"), F.lit(1).alias("member_count"), F.slice("keywords", 1, 8).alias("stable_themes")]
    centre = F.array_join(F.slice("keywords", 1, 4), ", ")
    ten = F.array_join(F.slice("keywords", 1, 10), " ")

    def ledger(column: str, prefix: str, label: str, *more: Column) -> DataFrame:
        rows = base.select("at", "family_id", "thread_uid", F.posexplode(column).alias("position", "item"))
        return rows.select(F.concat(F.lit(f"{prefix}-"), T.slugify("item", 64)).alias(f"{prefix}_key"), F.col("item").alias(f"canonical_{label}"), *more, family, uid, F.lit(1).alias("occurrence_count"), "at", "position")

    def listed(column: str, prefix: str, label: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.concat(F.lit(f"{prefix}-"), T.slugify(x, 64)).alias(f"{prefix}_key"), x.alias(f"canonical_{label}")))

    kinds = F.transform("entities", lambda x, i: F.struct(x.alias("canonical_label"), F.when(i == 0, "conversation").otherwise("concept").alias("entity_type")))
    named = base.select("at", "title", F.posexplode(kinds).alias("position", "e")).select("at", "title", "position", "e.*").withColumn("entity_key", F.lower("canonical_label"))
    first = F.struct("at", "position")
    entities = named.groupBy("entity_key").agg(F.min_by("canonical_label", first).alias("canonical_label"), F.min_by("entity_type", first).alias("entity_type"), F.min(first).alias("_first"))
    entities = written(entities.select("entity_key", F.concat(F.lit("entity-"), T.slugify("canonical_label", 64)).alias("canonical_entity_id"), "canonical_label", "entity_type"), "entities")
    aliases = named.groupBy("entity_key", F.lower("title").alias("_t")).agg(F.min_by("title", first).alias("label"), F.min("at").alias("at"))
    flagged = audit.select("cid", F.col("quality_flags").alias("audit_flags"))
    note = NOT_EVALUATED.format(shown)
    pair_counts = pairs.groupBy("cid").agg(F.count(F.lit(1)).alias("pair_count"))
    themes = [F.slice("keywords", 1, n).alias(f"semantic_{v}themes") for v, n in (("", 6), ("v2_", 8), ("v3_", 8))]
    tags = F.array(F.lit(f"{name}-export"), F.lit("json-export"), F.lit("calibration-import"))
    about = F.concat(title, F.lit(f" imported {shown} conversation centered on "), centre, F.lit("."))
    out = {
        "threads-index": base.join(flagged, "cid", "left").select("thread_uid", F.col("cid").alias("conversation_id"), title.alias("title_normalized"), title.alias("title_raw"), F.lit(f"imported_{name}_export").alias("answer_state"), tags.alias("tags"), F.array(F.lit(f"{name}-thread")).alias("semantic_tags"), "keywords", *themes, F.col("entities").alias("semantic_v3_entities"), F.col("summary").alias("semantic_summary"), F.col("summary").alias("semantic_v2_summary"), about.alias("semantic_v3_summary"), F.size("actions").alias("action_count"), F.size("questions").alias("unresolved_question_count"), "audit_flags", F.lit(thread_path).alias("thread_path"), family, F.col("stamp").alias("update_time_iso"), "at"),
        "semantic-v3-index": base.select("thread_uid", "title", "summary", F.concat_ws(" ", "title", "combined").alias("search_text"), family, "vector_terms", "at"),
        "pairs-index": pairs.drop("cid"),
        "doctrine-briefs": base.select("family_id", *key, F.concat(title, F.lit(" currently centers on "), centre, F.lit(f". Imported from {shown} export {bundle}.")).alias("brief_text"), F.concat_ws(" ", title, ten, "combined").alias("search_text"), "vector_terms", "at"),
        "family-dossiers": base.select("family_id", *key, F.concat(title, F.lit(f" imported {shown} conversation summary: "), "summary").alias("doctrine_summary"), F.concat_ws(" ", title, F.lit("doctrine"), ten, "combined").alias("search_text"), listed("actions", "action", "action").alias("actions"), listed("questions", "question", "question").alias("unresolved"), kinds.alias("key_entities"), "vector_terms", "at"),
        "canonical-families": base.select(F.col("family_id").alias("canonical_family_id"), *key[:2], uid, "at"),
        "action-ledger": ledger("actions", "action", "action", F.lit("open").alias("status")),
        "unresolved-ledger": ledger("questions", "question", "question", F.lit(WHY_UNRESOLVED.format(shown)).alias("why_unresolved")),
        "canonical-entities": entities,
        "entity-aliases": aliases.join(entities.select("entity_key", "canonical_label"), "entity_key").select("canonical_label", "label", "at"),
        "import-audit": audit.drop("cid"),
        "near-duplicates": near.select(F.array("left_title.thread_uid", "right_title.thread_uid").alias("thread_uids"), "similarity", F.array("left_title.title", "right_title.title").alias("titles")),
        "import-manifest": base.join(pair_counts, "cid", "left").select(F.col("cid").alias("conversation_uuid"), "thread_uid", "family_id", F.coalesce("pair_count", F.lit(0)).alias("pair_count"), "title", "at"),
    }
    spark = base.sparkSession
    warn = spark.range(1).select(F.lit("warn").alias("overall_state"), F.lit("warn").alias("source_reliability_state"))
    timeline = spark.createDataFrame([], "family_id string, at string, event string")
    return out | {"doctrine-timeline": timeline, "evaluation-summary": warn.withColumn("notes", F.array(F.lit(note))), "regression-gates": warn.withColumn("source_notes", F.array(F.lit(note))).withColumn("gates", F.expr("cast(array() as array<string>)"))}


def summary(made: dict[str, DataFrame], conversations: DataFrame, corpus_id: str, kind: str) -> DataFrame:
    """One row: the contract of a corpus with the counts of its tables; a conversation without text is an empty one."""

    def of(name: str, label: str, test: Column | None = None) -> DataFrame:
        return made[name].agg((F.count_if(test) if test is not None else F.count(F.lit(1))).alias(label))

    parts = [of("threads-index", "threads"), of("canonical-families", "families"), of("pairs-index", "pairs"), of("action-ledger", "actions"), of("unresolved-ledger", "unresolved"), of("canonical-entities", "entities"), of("near-duplicates", "near_duplicates"), of("import-audit", "flagged_threads", F.size("quality_flags") > 0), conversations.agg(F.count(F.lit(1)).alias("_all"))]
    # Each part is one row.
    one = reduce(lambda a, b: a.join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one"), parts[1:], parts[0].withColumn("_one", F.lit(1))).drop("_one")
    return one.select(F.lit(CONTRACT).alias("contract_name"), F.lit(VERSION).alias("contract_version"), F.lit(f"{KINDS[kind][0]}-export").alias("adapter_type"), T.slugify(F.lit(corpus_id)).alias("corpus_id"), *(c for c in one.columns if c != "_all"), (F.col("_all") - F.col("threads")).alias("empty_conversations"))
