"""Messages to corpus tables: threads, prompt/response pairs, audits, families, ledgers, entities.

Input is a frame of messages (thread, turn, role, text); every operator is one shuffle by thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as T
from loomspark.operators import terms

ASSISTANT_LED = "[assistant-led]"


def retained(messages: DataFrame, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages with text that aren't the system's, white space normalised: (thread, turn, role, text)."""
    rows = messages.select(F.col(thread).alias("thread"), F.col(turn).alias("turn"), F.lower(F.coalesce("role", F.lit(""))).alias("role"), T.normalize_space("text").alias("text"))
    return rows.where("text <> '' and role <> 'system'")


def pairs(messages: DataFrame, any_responder: bool = False) -> DataFrame:
    """(thread, pair_index, pair_id, prompt, response, title, summary, search_text).

    A user message opens a pair; what is answered before any is led by the assistant. any_responder: all other roles
    answer, not the assistant alone.
    """
    rows = messages if any_responder else messages.where("role in ('user', 'assistant')")
    order = Window.partitionBy("thread").orderBy("turn")
    grouped = rows.withColumn("g", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "text"))))
    folded = grouped.groupBy("thread", "g").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("asked"), F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("response"))
    folded = folded.withColumn("pair_index", F.row_number().over(Window.partitionBy("thread").orderBy("g"))).withColumn("prompt", F.coalesce("asked", F.lit(ASSISTANT_LED)))
    pid = F.format_string("%s-pair-%03d", F.col("thread").cast("string"), "pair_index")
    return folded.select(
        "thread", "pair_index", pid.alias("pair_id"), "prompt", "response",
        F.when(F.col("asked").isNull(), F.lit("Assistant-Led Turn")).otherwise(T.shorten("prompt", 80)).alias("title"),
        T.shorten(F.concat(F.lit("User: "), "prompt", F.lit(" Assistant: "), "response"), 240).alias("summary"),
        F.concat_ws(" ", pid, "prompt", "response").alias("search_text"),
    )


def first_prompts(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user'").groupBy("thread").agg(F.min_by("text", "turn").alias("prompt"))


def audit(messages: DataFrame, thread: str = "conv_id") -> DataFrame:
    """Per thread: messages, those off the path (system), kept and skipped ones, retention and flags."""
    rows = messages.select(F.col(thread).alias("thread"), F.lower(F.coalesce("role", F.lit("none"))).alias("role"), (T.normalize_space("text") == "").alias("blank"))
    path = F.col("role") != "system"
    sums = rows.groupBy("thread").agg(F.count(F.lit(1)).alias("message_count"), F.count_if(path).alias("path_count"), F.count_if(path & ~F.col("blank")).alias("retained_count"), F.count_if(path & F.col("blank")).alias("skipped_count"), F.count_if(F.col("role") == "user").alias("user_count"), F.count_if(F.col("role") == "assistant").alias("assistant_count"))
    ratio = F.when(F.col("path_count") == 0, F.lit(0.0)).otherwise(F.round(F.col("retained_count") / F.col("path_count"), 4))
    sums = sums.withColumn("retention_ratio", ratio)
    flags = F.concat_ws(",", F.when((F.col("retention_ratio") < 0.65) & (F.col("path_count") > 4), "low_retention"), F.when(F.col("skipped_count") > 5, "high_empty_render"))
    return sums.withColumn("quality_flags", flags)


def threads(messages: DataFrame) -> DataFrame:
    """(thread, title, thread_text, message_count): title is the first user text, or the first text, in 120 characters."""
    text = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    found = messages.groupBy("thread").agg(F.coalesce(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), F.min_by("text", "turn")).alias("head"), F.array_join(text, " ").alias("thread_text"), F.count(F.lit(1)).alias("message_count"))
    return found.select("thread", T.shorten("head", 120).alias("title"), "thread_text", "message_count")


def ledgers(docs: DataFrame, key: str, text: str, actions: list[str] | None = None, unresolved: list[str] | None = None) -> DataFrame:
    """(key, kind, position, item, item_key): actions and open questions of each document, by their markers."""
    cut = docs.select(key, T.split_sentences(text).alias("s")).select(key, T.extract_actions(F.col("s"), markers=actions).alias("a"), T.extract_unresolved(F.col("s"), markers=unresolved).alias("u"))
    rows = cut.select(key, F.lit("action").alias("kind"), F.posexplode("a").alias("position", "item")).unionByName(cut.select(key, F.lit("unresolved").alias("kind"), F.posexplode("u").alias("position", "item")))
    return rows.withColumn("item_key", T.slugify("item", 64))


def entities(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, label, entity_type, position): the title and the three first keywords, alike but for case only once."""
    words = terms.ranked_terms(docs, key, text, 3, T.CHAT_STOP_WORDS).select(key, "rank", T.title_case(F.replace("token", F.lit("-"), F.lit(" "))).alias("label"), F.lit("concept").alias("entity_type"))
    own = docs.select(key, F.lit(0).alias("rank"), F.col(title).alias("label"), F.lit("conversation").alias("entity_type"))
    rows = own.unionByName(words).withColumn("label", T.normalize_space("label")).where("label <> ''")
    first = Window.partitionBy(key, F.lower("label")).orderBy("rank")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select(key, "label", "entity_type", F.col("rank").alias("position"))


def entity_aliases(found: DataFrame, titles: DataFrame, key: str, title: str) -> DataFrame:
    """Entities over all documents by label in lower case: first label and type, number of documents, first title.

    Partial sums and minima only, so a concept in very many documents gathers no list.
    """
    at = F.struct(key, "position")
    return found.join(titles.select(key, F.col(title).alias("_title")), key).groupBy(F.lower("label").alias("entity_key")).agg(F.min_by("label", at).alias("label"), F.min_by("entity_type", at).alias("entity_type"), F.count_distinct(key).alias("documents"), F.min("_title").alias("first_alias"))
