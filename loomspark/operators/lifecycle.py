"""Sources over time: fingerprints, freshness, incremental reuse, and state machines of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may follow a candidate's state.
TRANSITIONS = {"staged": ("approved", "rejected"), "approved": ("promoted", "rejected"), "promoted": ("rolled-back",), "rejected": (), "rolled-back": ()}


def source_fingerprint(files: DataFrame, by: str, path: str, size: str, modified: str) -> DataFrame:
    """(by, file_count, total_size, fingerprint): 24 hex digits over the sorted ``path:size:modified`` of each source.

    The digest is over one sorted string, so what is gathered for a source is a short entry a file: its listing, not its
    contents.
    """
    entry = F.concat_ws(":", F.col(path).cast("string"), F.col(size).cast("string"), F.col(modified).cast("string"))
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("file_count"), F.sum(size).alias("total_size"), F.left(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "||"), 256), F.lit(24)).alias("fingerprint"))


def freshness(contracts: DataFrame, current: DataFrame) -> DataFrame:
    """Adds freshness to contracts (corpus_id, tracked, snapshot) from current signatures (corpus_id, fingerprint)."""
    rows = contracts.join(current.select("corpus_id", F.col("fingerprint").alias("now")), "corpus_id", "left")
    state = F.when(~F.col("tracked"), "not_applicable").when(F.col("now").isNull(), "missing_source").when(F.col("snapshot").isNull(), "missing_snapshot").when(F.col("snapshot") == F.col("now"), "fresh").otherwise("stale")
    return rows.withColumn("freshness", state)


def delta(listed: DataFrame, prior: DataFrame, key: str, stamp: str) -> DataFrame:
    """Adds action to a listing: reuse where the stamp is known and unchanged, else fetch."""
    old = prior.select(key, F.col(stamp).alias("_prior"))
    return listed.join(old, key, "left").withColumn("action", F.when(F.col(stamp) == F.col("_prior"), "reuse").otherwise("fetch")).drop("_prior")


def scope_check(current: DataFrame, prior: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """One row (current, prior, allowed): a listing with under ``least`` of the known ids mustn't replace them."""
    counts = current.agg(F.count_distinct(key).alias("current")).join(F.broadcast(prior.agg(F.count_distinct(key).alias("prior"))))
    return counts.withColumn("allowed", (F.col("prior") == 0) | (F.col("current") >= least * F.col("prior")))


def transition(now: Column, to: Column) -> Column:
    """Whether a candidate may go from one state to another."""
    allowed = F.lit(False)
    for state, following in TRANSITIONS.items():
        allowed = F.when(now == state, to.isin(*following) if following else F.lit(False)).otherwise(allowed)
    return allowed


def merge_registry(existing: DataFrame, discovered: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Both sides by key: columns in ``kept`` keep what was known, others take what was found, unseen ones stay."""
    old = existing.select(key, *(F.col(c).alias(f"_{c}") for c in existing.columns if c != key))
    rows = old.join(discovered, key, "full_outer")
    out = []
    for c in existing.columns:
        if c != key:
            found = F.col(c) if c in discovered.columns else F.lit(None)
            out.append((F.coalesce(f"_{c}", found) if c in kept else F.coalesce(found, F.col(f"_{c}"))).alias(c))
    return rows.select(key, *out)


def migrate_ids(items: DataFrame, old: str, new: Column) -> tuple[DataFrame, DataFrame]:
    """Items with a recomputed id, and the mapping of ids that changed; a second run changes nothing."""
    rows = items.withColumn("_new", new)
    mapping = rows.where(F.col(old) != F.col("_new")).select(F.col(old).alias("old_id"), F.col("_new").alias("new_id")).distinct()
    return rows.withColumn(old, F.col("_new")).drop("_new"), mapping


#: What belongs to a source by the type of its adapter, as patterns of relative paths.
TRACKED = {
    "markdown-document": r"\.md$", "markdown-transcript": r"(\.md$|(^|/)Attachments/)", "claude-export": r"\.json$", "chatgpt-export": r"\.json$",
    "claude-local-session": r"^(Cookies$|config\.json$|Preferences$|Local Storage/leveldb/|IndexedDB/https_claude\.ai_0\.indexeddb\.leveldb/|Session Storage/|WebStorage/QuotaManager$|WebStorage/QuotaManager-journal$)",
    "chatgpt-local-session": r"^com\.openai\.chat\.binarycookies$",
    "copilot-export": r"(?i)\.(md|markdown|txt|html|htm|json|csv)$", "gemini-export": r"(?i)\.(md|markdown|txt|html|htm|json|csv)$", "grok-export": r"(?i)\.(md|markdown|txt|html|htm|json|csv)$", "perplexity-export": r"(?i)\.(md|markdown|txt|html|htm|json|csv)$",
}


def source_files(listing: DataFrame, adapter: str, top_level: bool = False, path: str = "path") -> DataFrame:
    """The files of a listing (relative paths) that a source of that adapter is made of, each once; none for an unknown one."""
    if adapter not in TRACKED:
        return listing.where("false")
    rows = listing.where(F.col(path).rlike(TRACKED[adapter])).dropDuplicates([path])
    return rows.where(~F.contains(path, F.lit("/"))) if top_level and adapter == "markdown-document" else rows


def attachment_roots(listing: DataFrame, path: str = "path") -> DataFrame:
    """(root): folders named Attachments that hold a file, each once."""
    found = F.regexp_extract(path, r"^((?:.*?/)?Attachments)/", 1)
    return listing.select(found.alias("root")).where("root <> ''").distinct()


def hashed(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with the sha256 of their content, which is read by the executors."""
    return files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).drop(content)


def source_policy(rows: DataFrame, workspace: str) -> DataFrame:
    """Source policies whose roots are absolute: relative ones lie in the workspace."""
    def absolute(c: str) -> Column:
        return F.when(F.startswith(c, F.lit("/")) | (F.col(c) == "") | F.col(c).isNull(), F.col(c)).otherwise(F.concat(F.lit(workspace.rstrip("/") + "/"), F.col(c)))

    return rows.withColumns({c: absolute(c) for c in ("primary_root", "fallback_root") if c in rows.columns})


def candidate_transition(candidates: DataFrame, candidate_id: str, to: str, at: str) -> DataFrame:
    """Candidates (candidate_id, status, ...) with one of them moved on; a move that its state forbids raises."""
    now = candidates.where(F.col("candidate_id") == candidate_id).select("status", transition(F.col("status"), F.lit(to)).alias("ok")).limit(1).collect()
    if not now:
        raise ValueError(f"unknown candidate: {candidate_id}")
    if not now[0]["ok"]:
        raise ValueError(f"{candidate_id} is {now[0]['status']}: it can't be {to}")
    own = F.col("candidate_id") == candidate_id
    return candidates.withColumns({"status": F.when(own, to).otherwise(F.col("status")), "updated_at": F.when(own, at).otherwise(F.col("updated_at") if "updated_at" in candidates.columns else F.lit(None).cast("string"))})
