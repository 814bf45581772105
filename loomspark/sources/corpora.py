"""Corpus folders as tables: what a valid one holds, contracts, inbox entries, records found by id."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.contracts import CONTRACT, VERSION
from loomspark.sources.exports import EXTENSIONS

#: Files without which a folder is no corpus, and names that listings leave out.
REQUIRED = ["corpus/threads-index.json", "corpus/semantic-v3-index.json", "corpus/pairs-index.json", "corpus/doctrine-briefs.json", "corpus/family-dossiers.json"]
IGNORED = ("__MACOSX", "Thumbs.db", "desktop.ini")


def missing_files(listing: DataFrame) -> DataFrame:
    """(corpus_id, relative_path) that each corpus of a listing (corpus_id, relative_path) lacks."""
    spark = listing.sparkSession
    wanted = listing.select("corpus_id").distinct().join(F.broadcast(spark.createDataFrame([(x,) for x in REQUIRED], "relative_path string")))
    return wanted.join(listing, ["corpus_id", "relative_path"], "left_anti")


def valid_corpora(listing: DataFrame) -> DataFrame:
    return listing.select("corpus_id").distinct().join(missing_files(listing).select("corpus_id").distinct(), "corpus_id", "left_anti")


def contracts(counts: DataFrame, known: DataFrame, adapter_type: str, generated_at: str) -> DataFrame:
    """Contracts with new counts; names and ids that were known stay."""
    old = known.select("corpus_id", F.col("name").alias("_name"), F.col("adapter_type").alias("_adapter"))
    rows = counts.join(old, "corpus_id", "left")
    return rows.select("corpus_id", F.coalesce(F.nullif("_name", F.lit("")), "name").alias("name"), F.coalesce(F.nullif("_adapter", F.lit("")), F.lit(adapter_type)).alias("adapter_type"), "rows", F.lit(CONTRACT).alias("contract_name"), F.lit(VERSION).alias("contract_version"), F.lit(generated_at).alias("generated_at"))


def visible(folder: str) -> list[Path]:
    """Entries of a folder in order, without hidden and system ones."""
    return sorted(p for p in Path(folder).iterdir() if not p.name.startswith(".") and p.name not in IGNORED)


def inbox_entry(folder: str) -> Path:
    """The one entry of an inbox that documents can be made from; none or several raise."""

    def fits(p: Path) -> bool:
        found = p.rglob("*") if p.is_dir() else [p]
        return any(x.is_file() and x.suffix.lower().lstrip(".") in (*EXTENSIONS, "zip") for x in found)

    eligible = [p for p in visible(folder) if fits(p)]
    if len(eligible) != 1:
        raise ValueError(f"{folder} holds {len(eligible)} exports, not one")
    return eligible[0]


def chat_format(folder: str) -> str | None:
    """Which chat export a folder holds, by its files."""
    names = {p.name for p in visible(folder)}
    if "conversations.json" not in names:
        return None
    return "message-list" if "users.json" in names else "mapping" if "user.json" in names else None


def bundles(folder: str) -> list[Path]:
    """The parts of an export: the folder itself if it is one, else its sub-folders that are, in order."""
    if chat_format(folder):
        return [Path(folder)]
    parts = [p for p in visible(folder) if p.is_dir() and chat_format(str(p))]
    if not parts:
        raise FileNotFoundError(f"{folder} holds no chat export")
    return parts


def records_by_id(spark: SparkSession, folder: str, pattern: str, glob: str = "*.yaml") -> DataFrame:
    """(record_id, path) of text files that hold an id; of several files with one id the last counts."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    found = rows.select(F.regexp_extract("value", pattern, 1).alias("record_id"), F.col("_metadata.file_path").alias("path")).where("record_id <> ''")
    return found.groupBy("record_id").agg(F.max("path").alias("path"))


def project_files(files: DataFrame, messages: DataFrame) -> DataFrame:
    """Files (message_id, name) of a project with the text of their message; names that repeat get a number."""
    from pyspark.sql.window import Window

    rows = files.join(messages.select("message_id", "text"), "message_id")
    n = F.row_number().over(Window.partitionBy("name").orderBy("message_id"))
    return rows.withColumn("n", n).select("message_id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", F.col("n") - 1)).alias("name"), "text")
