"""Whole imports: the parts of a chat export, or Markdown documents, read, made into a corpus's tables and written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import importing
from loomspark.operators.review import numbered
from loomspark.plans.shared import written
from loomspark.sources import corpora, exports, sinks

#: Tables that lie beside the others, not in their folder.
OUTSIDE = ["import-manifest"]


def parts(spark: SparkSession, folders: list[str], kind: str) -> DataFrame:
    """Conversations of an export's parts with ``cid`` and ``at``, their number from 1; of one id the first part's stays.

    ``repeats`` says how many others an id had. A file is one JSON array, so its order is that of the rows read.
    """
    key, schema = ("conversation_id", exports.MAPPING) if kind == "mapping" else ("uuid", exports.MESSAGES)
    read = [exports.json_table(spark, f"{f}/conversations.json", schema).withColumn("_part", F.lit(i)).withColumn("_row", F.monotonically_increasing_id()) for i, f in enumerate(folders)]
    rows = reduce(DataFrame.unionByName, read).withColumn(key, F.nullif(key, F.lit("")))
    times = rows.where(F.col(key).isNotNull()).groupBy(key).agg((F.count(F.lit(1)) - 1).alias("repeats"))
    first = numbered(exports.keep_first(rows, key, ["_part", "_row"]), ["_part", "_row"], "_n").withColumn("at", F.col("_n") + 1)
    first = first.join(times, key, "left").fillna(0, ["repeats"]).withColumn("cid", F.coalesce(key, importing.fallback_id(kind, F.col("at"))))
    return written(first.drop("_part", "_row", "_n"), "parts")


def frames(found: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, raw) as operators.importing takes them."""
    if kind == "mapping":
        stamp = exports.iso_time(F.coalesce(F.nullif("update_time", F.lit(0.0)), "create_time"))
        said = exports.mapping_messages(found.withColumn("conversation_id", F.col("cid")))
        nodes = found.select("cid", F.explode(F.map_values("mapping")).alias("n"))
        raw = nodes.select("cid", F.col("n.message.author.role").alias("role"), F.coalesce(F.nullif("n.message.content.content_type", F.lit("")), F.lit("none")).alias("kind"), F.lit(True).alias("entry"))
        title = F.col("title")
    else:
        stamp = F.coalesce(F.nullif("updated_at", F.lit("")), F.nullif("created_at", F.lit("")))
        said = exports.list_messages(found.withColumn("uuid", F.col("cid")))
        text = F.when(exports.T.normalize_space("m.text") != "", F.array(F.lit("text_field"))).otherwise(F.array())
        listed = F.transform(F.coalesce("m.content", F.array()), lambda x: F.lower(F.coalesce(F.nullif(x["type"], F.lit("")), F.lit("none"))))
        kinds = F.concat(text.cast("array<string>"), listed)
        items = found.select("cid", F.explode("chat_messages").alias("m")).select("cid", F.lower(F.coalesce("m.sender", F.lit("none"))).alias("role"), F.when(F.size(kinds) == 0, F.array(F.lit("none"))).otherwise(kinds).alias("kinds"))
        raw = items.select("cid", "role", F.posexplode("kinds").alias("_i", "kind")).select("cid", "role", "kind", (F.col("_i") == 0).alias("entry"))
        title = F.coalesce(*(F.nullif(exports.T.normalize_space(c), F.lit("")) for c in ("name", "summary")))
    messages = said.select(F.col("conversation_id").alias("cid"), "turn", "role", "text", "hidden")
    return found.select("cid", "at", title.alias("title"), stamp.alias("stamp")), messages, raw


def write_corpus(made: dict[str, DataFrame], contract: DataFrame, root: str) -> None:
    """Each table under its name, as a version of its own; the contract last, so that a corpus that has one is whole."""
    for name, rows in made.items():
        sinks.replace_table(rows, f"{root}/{name}" if name in OUTSIDE else f"{root}/corpus/{name}")
    sinks.replace_table(contract, f"{root}/corpus/contract")


def import_export(spark: SparkSession, folder: str, root: str, corpus_id: str) -> DataFrame:
    """Import an export, of one part or several, into ``root``; the result is its contract with the counts."""
    found = corpora.bundles(folder)
    kind = corpora.chat_format(str(found[0]))
    if kind is None:
        raise ValueError(f"{folder} holds no chat export")
    rows = parts(spark, [str(p) for p in found], kind)
    conversations, messages, raw = frames(rows, kind)
    made = importing.tables(conversations, written(messages, "messages"), raw, kind, found[0].name, f"{root}/source/conversations.json")
    skipped = rows.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicate_conversations_skipped"), F.lit(len(found)).alias("bundle_part_count"))
    contract = written(importing.summary(made, conversations, corpus_id, kind).crossJoin(F.broadcast(skipped)), "contract")
    write_corpus(made, contract, root)
    return contract
