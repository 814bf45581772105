"""Contracts: a subset of JSON Schema, the schemas of published payloads, provider catalogue and policies."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = "loomspark-corpus"
VERSION = 1


def _required(*names: str, **kinds: object) -> dict:
    return {"type": "object", "required": list(names), "properties": {k: {"type": v} for k, v in kinds.items()}}


# The top-level keys that published payloads need.
SCHEMAS: dict[str, dict] = {
    "corpus-contract": _required("contract_name", "contract_version", "adapter_type", "corpus_id", "name", "generated_at", contract_version="integer"),
    "import-audit": {"type": "array", "items": _required("thread_uid", "retained_count", "skipped_count", "empty_render_count", "retention_ratio", "raw_content_type_counts", "quality_flags", retention_ratio="number")},
    "near-duplicates": {"type": "array", "items": _required("thread_uids", "similarity", "titles", similarity="number", thread_uids="array")},
    "promotion-policy": _required("version", "mode", "thresholds", version="integer", thresholds="object"),
    "source-policy": _required("provider", "generated_at", "decision", "primary_root", "primary_corpus_id", "note"),
    "corpus-candidate": _required("candidate_id", "generated_at", "status", "project_root", "live_corpus_id", "live_root", "candidate_root", "recommendation_state", "diff_summary", "diff_evaluation"),
    "provider-refresh": _required("run_id", "generated_at", "project_root", "provider", "provider_name", "mode", "live_corpus_id", "live_root", "candidate_root", "source_path", "import_result", "evaluation", "candidate"),
    "surface-bundle": _required("contract_name", "contract_version", "generated_at", "project_root", "source_drop_root", "summary", "manifest", "context"),
    "surface-manifest": _required("contract_name", "contract_version", "generated_at", "engine", "project", "schemas", "cli_surfaces", "registry", "providers", "artifacts"),
    "mcp-context": _required("contract_name", "contract_version", "generated_at", "project_root", "source_drop_root", "summary", "registry", "providers", "governance", "latest_events", "review_queue", "schema_catalog"),
}
PROVIDERS = {"chatgpt": "chatgpt-bundle", "claude": "claude-bundle", "gemini": "document-export", "grok": "document-export", "perplexity": "document-export", "copilot": "document-export", "deepseek": "document-export", "mistral": "document-export"}
_KINDS = {"string": str, "array": list, "object": dict, "boolean": bool, "null": type(None)}


def is_kind(value: object, kind: str) -> bool:
    """Whether a JSON value is of a kind; a boolean is no number."""
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, int if kind == "integer" else (int, float))
    return isinstance(value, _KINDS[kind])


def issues(value: object, schema: dict, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, message) of what a value lacks: type, const, enum, required, properties, items."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(is_kind(value, k) for k in kinds):
        yield path, f"is not of type {' or '.join(kinds)}"
    elif "const" in schema and value != schema["const"]:
        yield path, f"is not {schema['const']!r}"
    elif "enum" in schema and value not in schema["enum"]:
        yield path, f"is none of {schema['enum']!r}"
    elif isinstance(value, dict):
        for key in schema.get("required", ()):
            if key not in value:
                yield f"{path}.{key}", "is missing"
        for key, inner in schema.get("properties", {}).items():
            if key in value:
                yield from issues(value[key], inner, f"{path}.{key}")
    elif isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            yield from issues(x, schema["items"], f"{path}[{i}]")


def schema_issues(payloads: DataFrame, name: str, key: str = "id", column: str = "payload") -> DataFrame:
    """(key, path, message) of JSON documents that don't fit a published schema; text that isn't JSON is one issue."""
    schema = SCHEMAS[name]

    @F.udtf(returnType="path string, message string")
    class Issues:
        def eval(self, text: str) -> Iterator[tuple[str, str]]:
            try:
                value = json.loads(text)
            except (TypeError, ValueError):
                yield "$", "is not JSON"
            else:
                yield from issues(value, schema)

    spark = payloads.sparkSession
    spark.udtf.register("loomspark_issues", Issues)
    payloads.select(F.col(key).alias("k"), F.col(column).alias("p")).createOrReplaceTempView("loomspark_payloads")
    return spark.sql(f"SELECT k AS {key}, i.path, i.message FROM loomspark_payloads, LATERAL loomspark_issues(p) i")


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROVIDERS.items()), "provider string, discovery string")


def targets(catalogue: DataFrame, policy: DataFrame, registry: DataFrame) -> DataFrame:
    """The target of each provider: the policy's primary, or its fallback where no policy decided and the primary isn't registered."""
    known = registry.select("corpus_id", F.lit(True).alias("_known"))
    rows = catalogue.join(policy, "provider", "left").join(known.withColumnsRenamed({"corpus_id": "primary_corpus_id", "_known": "_primary"}), "primary_corpus_id", "left")
    fallback = F.col("decision").isNull() & F.col("_primary").isNull() & F.col("fallback_corpus_id").isNotNull()
    return rows.select("provider", "discovery", F.when(fallback, F.col("fallback_corpus_id")).otherwise(F.col("primary_corpus_id")).alias("corpus_id"), F.when(fallback, "fallback").otherwise("primary").alias("role"))


def manifest(spark: SparkSession, registry: DataFrame, generated_at: str) -> DataFrame:
    """The manifest for outside readers: one row with one JSON document."""
    listed = registry.agg(F.sort_array(F.collect_list(F.struct("corpus_id", "status", "is_default"))).alias("registry"))
    named = providers(spark).agg(F.sort_array(F.collect_list(F.struct("provider", "discovery"))).alias("providers"))
    rows = listed.join(F.broadcast(named))
    fields = [F.lit(CONTRACT).alias("contract_name"), F.lit(VERSION).alias("contract_version"), F.lit(generated_at).alias("generated_at"), F.lit("loomspark").alias("engine"), F.lit("").alias("project"), F.lit(list(SCHEMAS)).alias("schemas"), F.array(F.lit("query"), F.lit("queries")).alias("cli_surfaces"), "registry", "providers", F.expr("cast(array() as array<string>)").alias("artifacts")]
    return rows.select(F.lit("manifest").alias("id"), F.to_json(F.struct(*fields)).alias("payload"))
