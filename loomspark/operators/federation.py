"""Federation: registry, flattened indexes and their filter, decisions and what they make of records, canon tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as T
from loomspark.operators import canon, terms
from loomspark.operators.evaluate import latest, one_default


def register(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """The registry with an entry added or replaced; an entry that asks to be the default takes it from the others."""
    takes = entry.where("is_default").limit(1)
    old = registry.join(entry.select("corpus_id"), "corpus_id", "left_anti").join(F.broadcast(takes.agg((F.count(F.lit(1)) > 0).alias("_taken"))))
    old = old.withColumn("is_default", F.col("is_default") & ~F.col("_taken")).drop("_taken")
    return one_default(old.unionByName(entry))


def active(registry: DataFrame) -> DataFrame:
    return registry.where(F.coalesce("status", F.lit("active")) == "active")


def summary(counts: DataFrame, registry: DataFrame, gates: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: numbers of corpora, rows, and corpora by gate and freshness; counts (corpus_id, rows)."""
    rows = active(registry).join(counts, "corpus_id", "left").join(gates, "corpus_id", "left").join(fresh, "corpus_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("corpora"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *(F.count_if(F.col("gate_state") == s).alias(f"gate_{s}") for s in ("pass", "warn", "fail")),
        *(F.count_if(F.col("freshness") == s).alias(s) for s in ("fresh", "stale", "missing_source", "missing_snapshot")),
    )


def query_index(ledger: DataFrame, text: str | None = None, corpus_id: str | None = None, limit: int = 20) -> DataFrame:
    """Rows of a ledger of one corpus (by corpus_id, corpus_ids or source_corpora) that hold a text in some value."""
    rows = ledger
    if corpus_id is not None:
        tests = [F.array_contains(c, corpus_id) for c in ("corpus_ids", "source_corpora") if c in rows.columns]
        if "corpus_id" in rows.columns:
            tests.append(F.col("corpus_id") == corpus_id)
        test = F.lit(False)
        for t in tests:
            test = test | F.coalesce(t, F.lit(False))
        rows = rows.where(test)
    if text:
        nested = ("array", "map", "struct")
        values = [F.to_json(c) if kind.startswith(nested) else F.col(c).cast("string") for c, kind in ledger.dtypes]
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *values)), F.lit(text.lower())))
    return rows.limit(limit)


def decision_groups(records: DataFrame, accepted: DataFrame, prefix: str) -> DataFrame:
    """(member_id, group_id): records joined by accepted decisions (decision_id, subject_ids, canonical_subject).

    A group takes the subject of a decision that names exactly its members, else a slug of them. Two groups with the same
    subject stay apart: later ones get their fingerprint.
    """
    known = accepted.select("decision_id", F.explode(F.array_distinct("subject_ids")).alias("member_id")).join(records.select("member_id"), "member_id")
    first = known.groupBy("decision_id").agg(F.min("member_id").alias("base"))
    edges = known.join(first, "decision_id").where("member_id <> base").select(F.col("base").alias("left_id"), F.col("member_id").alias("right_id"))
    roots = canon.components(records, edges)
    members = roots.groupBy("root").agg(F.sort_array(F.collect_set("member_id")).alias("members"))
    exact = accepted.where("canonical_subject <> ''").select(T.subject_key(F.col("subject_ids")).alias("k"), "canonical_subject").groupBy("k").agg(F.min("canonical_subject").alias("subject"))
    named = members.withColumn("k", T.subject_key(F.col("members"))).join(exact, "k", "left")
    own = F.concat(F.lit(f"{prefix}-"), T.slugify(F.array_join("members", " "), 72))
    named = named.withColumn("group_id", F.coalesce(F.nullif("subject", F.lit("")), own))
    again = F.row_number().over(Window.partitionBy("group_id").orderBy("root"))
    named = named.withColumn("group_id", F.when(again == 1, F.col("group_id")).otherwise(F.concat_ws("-", "group_id", T.fingerprint(F.col("members")))))
    return named.select(F.explode("members").alias("member_id"), "group_id")


def mode_first(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most common value of each group, ties by first place."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))
    return counted.withColumn("i", best).where("i = 1").select(*by, value)


def top_values(rows: DataFrame, by: list[str], value: str, order: str, limit: int, name: str) -> DataFrame:
    """The most common values of an array column of each group, in order."""
    flat = rows.select(*by, order, F.posexplode(value).alias("p", "v"))
    counted = flat.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "p")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))
    kept = counted.withColumn("i", rank).where(F.col("i") <= limit)
    return kept.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(name))


def canonical_families(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: most common title, eight themes, numbers of members and corpora, term vector of the texts."""
    rows = records.join(groups, "member_id")
    base = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"), F.sort_array(F.collect_set("corpus_id")).alias("corpus_ids"))
    title = mode_first(rows, ["group_id"], "label", "member_id").withColumnRenamed("label", "canonical_title")
    themes = top_values(rows, ["group_id"], "themes", "member_id", 8, "stable_themes")
    out = base.join(title, "group_id").join(themes, "group_id", "left")
    if "text" in records.columns:
        out = out.join(terms.term_maps(rows, "group_id", "text", 16, [], 1).select("group_id", "vector_terms"), "group_id", "left")
    return out


def canonical_actions(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group of actions or questions: most common text, status (open if it has none) and reason, members, corpora,
    and the term vector of the members' texts."""
    rows = records.join(groups, "member_id")
    base = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"), F.sort_array(F.collect_set("corpus_id")).alias("corpus_ids"))
    text = mode_first(rows, ["group_id"], "label", "member_id").withColumnRenamed("label", "canonical_text")
    out = base.join(text, "group_id")
    if "status" in records.columns:
        out = out.join(mode_first(rows.withColumn("status", F.coalesce("status", F.lit("open"))), ["group_id"], "status", "member_id"), "group_id")
    if "why" in records.columns:
        out = out.join(mode_first(rows.where("why <> ''"), ["group_id"], "why", "member_id"), "group_id", "left").fillna("", ["why"])
    if "text" in records.columns:
        out = out.join(terms.term_maps(rows, "group_id", "text", 16, [], 1).select("group_id", "vector_terms"), "group_id", "left")
    return out


def canonical_aliases(records: DataFrame, groups: DataFrame, canonical: DataFrame) -> DataFrame:
    """(group_id, alias) of labels and aliases of a group's members other than its canonical label, each once."""
    rows = records.join(groups, "member_id")
    names = F.concat(F.array("label"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))) if "aliases" in records.columns else F.array("label")
    found = rows.select("group_id", F.explode(names).alias("alias")).where("alias <> ''").distinct()
    return found.join(canonical.select("group_id", F.col("label").alias("_label")), "group_id").where("alias <> _label").drop("_label")


def thread_refs(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, corpus_id, thread) of the canonical threads of a group's families."""
    return records.join(groups, "member_id").where("coalesce(thread, '') <> ''").select("group_id", "corpus_id", "thread")


def doctrine_briefs(families: DataFrame) -> DataFrame:
    """Canonical families with brief_text, one sentence on each, and the search_text that a search of briefs reads."""
    corpora = F.array_join("corpus_ids", ", ")
    none = F.expr("cast(array() as array<string>)")
    themes = F.coalesce(F.nullif(F.array_join(F.coalesce("stable_themes", none), ", "), F.lit("")), F.lit("no stable themes"))
    # The brief's wording.
    brief = F.concat("canonical_title", F.lit(" spans "), F.size("corpus_ids").cast("string"), F.lit(" corpora and "), F.col("member_count").cast("string"), F.lit(" family members. Stable themes: "), themes, F.lit(". Corpora: "), F.coalesce(F.nullif(corpora, F.lit("")), F.lit("n/a")), F.lit("."))
    own = [F.coalesce("search_text", F.lit(""))] if "search_text" in families.columns else []
    return families.withColumns({"brief_text": brief, "search_text": F.trim(F.concat_ws(" ", "canonical_title", themes, corpora, *own))})


def family_records(families: DataFrame, dossiers: DataFrame, briefs: DataFrame) -> DataFrame:
    """Families (corpus_id, family_id, title, thread) as records for merging, with what their dossier (themes, entities,
    actions, unresolved: arrays) and their brief (text) add; a family without either keeps its title alone."""
    key = ["corpus_id", "family_id"]
    rows = families.join(dossiers, key, "left").join(briefs.withColumnRenamed("text", "_brief"), key, "left")
    none = F.expr("cast(array() as array<string>)")
    lists = {c: F.coalesce(c, none) for c in ("themes", "entities", "actions", "unresolved")}
    rows = rows.withColumns(lists)
    text = F.trim(F.concat_ws(" ", "title", F.array_join("themes", " "), F.array_join("entities", " "), F.coalesce("_brief", F.lit(""))))
    return rows.select("corpus_id", F.concat_ws(":", "corpus_id", "family_id").alias("member_id"), F.col("title").alias("label"), "thread", "themes", F.col("entities").alias("key_entities"), "actions", "unresolved", text.alias("text"))


def build_canon(records: dict[str, DataFrame], accepted: DataFrame, rejected: DataFrame, prior: DataFrame) -> dict[str, DataFrame]:
    """All of the canon from records by kind (entity, family, action, unresolved), decisions (review_type, subject_ids,
    canonical_subject) and the queue that was: suggestions of pairs that nobody decided on, with the status that was known;
    groups by the accepted decisions; canonical tables, briefs and the conflict report.
    """
    # The review type of each kind.
    kinds = {"entity": "entity-alias", "family": "family-merge", "action": "action-merge", "unresolved": "unresolved-merge"}
    decided = accepted.select("subject_ids").unionByName(rejected.select("subject_ids")).select(F.sort_array("subject_ids").alias("s")).select(F.get("s", F.lit(0)).alias("left_id"), F.get("s", F.lit(1)).alias("right_id")).distinct()
    suggested = canon.suggestions(records["family"], "contradiction", decided)
    out: dict[str, DataFrame] = {}
    for kind, review in kinds.items():
        suggested = suggested.unionByName(canon.suggestions(records[kind], review, decided))
        own = accepted.where(F.col("review_type") == review)
        groups = decision_groups(records[kind], own.withColumn("decision_id", T.subject_key(F.col("subject_ids"))), kind)
        out[f"{kind}_groups"] = groups
        if kind == "entity":
            out["entities"] = canon.canonical_entities(records[kind], groups.withColumnRenamed("group_id", "root")).withColumnRenamed("root", "group_id")
        elif kind == "family":
            out["families"] = canonical_families(records[kind], groups)
        else:
            out[{"action": "actions", "unresolved": "questions"}[kind]] = canonical_actions(records[kind], groups)
    out["briefs"] = doctrine_briefs(out["families"])
    out["queue"] = carry_over(canon.stable_ids(suggested.drop("status")), prior)
    out["conflicts"] = conflict_report(suggested.where("review_type = 'contradiction'"), out["families"])
    return out


def conflict_report(contradictions: DataFrame, families: DataFrame) -> DataFrame:
    shared = families.agg(F.count_if(F.size("corpus_ids") > 1).alias("shared_families"), F.count(F.lit(1)).alias("families"))
    return contradictions.agg(F.count(F.lit(1)).alias("potential_conflicts"), F.count_if(F.col("priority") == "high").alias("high")).join(F.broadcast(shared))


def carry_over(suggested: DataFrame, prior: DataFrame) -> DataFrame:
    """New suggestions with the status that was known, and resolved items that are no longer suggested."""
    old = prior.select("review_id", F.col("status").alias("_was"))
    rows = suggested.join(old, "review_id", "left").withColumn("status", F.when(F.coalesce("_was", F.lit("open")) != "open", F.col("_was")).otherwise(F.lit("open"))).drop("_was")
    stale = prior.where("status <> 'open'").join(suggested.select("review_id"), "review_id", "left_anti")
    return rows.unionByName(stale, allowMissingColumns=True)


def resolve(queue: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue with verdicts (review_id, decision, note, at) applied, and the decisions among them.

    Deferring isn't a decision. Items that aren't open keep their status.
    """
    last = latest(verdicts, "review_id", "at", "decision")
    rows = queue.join(last, "review_id", "left")
    closes = F.col("decision").isNotNull() & (F.col("status") == "open")
    done = rows.withColumn("status", F.when(closes, F.col("decision")).otherwise(F.col("status")))
    decisions = rows.where(closes & F.col("decision").isin("accepted", "rejected")).select("review_id", F.array("left_id", "right_id").alias("subject_ids"), F.col("decision").alias("verdict"), F.col("subject").alias("canonical_subject"), "at")
    return done.drop("decision", "note", "at"), decisions


def federated_documents(families: DataFrame, entities: DataFrame, actions: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Canon tables as search documents of one schema; a family gives a brief and a dossier."""

    def shaped(rows: DataFrame, kind: str, title: str) -> DataFrame:
        none = F.create_map().cast("map<string,double>")
        vector = F.coalesce("vector_terms", none) if "vector_terms" in rows.columns else none
        more = F.array_join("stable_themes", " ") if "stable_themes" in rows.columns else F.lit("")
        return rows.select(F.concat_ws(":", F.lit(kind), "group_id").alias("doc_id"), F.lit(kind).alias("kind"), F.col(title).alias("title"), F.concat_ws(" ", title, more).alias("text"), vector.alias("vector_terms"), "corpus_ids")

    parts = [shaped(families, "federated_family_brief", "canonical_title"), shaped(families, "federated_project_dossier", "canonical_title"), shaped(entities, "federated_entity_dossier", "label"), shaped(actions, "federated_action_cluster", "canonical_text"), shaped(unresolved, "federated_unresolved_cluster", "canonical_text")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_prefix(ids: Column, corpus: Column) -> Column:
    return F.transform(ids, lambda x: F.concat_ws("/", corpus, x))


def of_mode(docs: DataFrame, mode: str | None) -> DataFrame:
    """Federated documents of the kind that a mode asks for; all without one."""
    # The kinds by mode.
    kinds = {"family_brief": ["federated_family_brief"], "action": ["federated_action_cluster"], "unresolved": ["federated_unresolved_cluster"], "entity": ["federated_entity_dossier"], "project": ["federated_project_dossier"]}
    if mode is None:
        return docs
    if mode not in kinds:
        raise ValueError(f"unknown mode: {mode}")
    return docs.where(F.col("kind").isin(kinds[mode]))


def corpora_of(payload: dict[str, Column]) -> Column:
    """The corpora that a canon hit names (corpus_ids, then those of threads, families and sources), in order, each once."""
    none = F.expr("cast(array() as array<string>)")
    lists = [F.coalesce(payload[k], none) for k in ("corpus_ids", "thread_corpora", "family_corpora", "source_corpora") if k in payload]
    return F.array_distinct(F.filter(F.concat(*lists), lambda c: c.isNotNull() & (c != "")))


def live_entry(registry: DataFrame, corpus_id: str | None = None, wanted: list[str | None] | None = None) -> DataFrame:
    """The registry's entry to work on: that of an id; the first of a provider's ids that is registered; the default; the
    only one. None of these raises. One row is read."""
    rows = active(registry)
    if corpus_id:
        found, why = rows.where(F.col("corpus_id") == corpus_id), f"no active corpus {corpus_id}"
    elif wanted is not None:
        ids = list(dict.fromkeys(x for x in wanted if x))
        place = F.array_position(F.array(*(F.lit(x) for x in ids)), F.col("corpus_id")) if ids else F.lit(0)
        found, why = rows.withColumn("_p", place).where("_p > 0").orderBy("_p").drop("_p").limit(1), "no active corpus of the provider"
    else:
        chosen = rows.where("is_default").orderBy("corpus_id").limit(1)
        if chosen.isEmpty() and rows.limit(2).count() == 1:
            chosen = rows
        found, why = chosen, "name a corpus or a provider: several are active"
    if found.isEmpty():
        raise ValueError(why)
    return found


def inspected(targets: DataFrame, registry: DataFrame, contracts: DataFrame) -> DataFrame:
    """Targets (corpus_id, root) with their registry entry, by id or else by root, and whether they have a contract."""
    by_id = registry.select("corpus_id", F.col("status").alias("_s1"), F.col("is_default").alias("_d1"))
    by_root = registry.groupBy("root").agg(F.max_by("status", "corpus_id").alias("_s2"), F.max_by("is_default", "corpus_id").alias("_d2"))
    held = contracts.select("root").distinct().withColumn("has_contract", F.lit(True))
    rows = targets.join(by_id, "corpus_id", "left").join(by_root, "root", "left").join(held, "root", "left")
    return rows.select("corpus_id", "root", (F.col("_s1").isNotNull() | F.col("_s2").isNotNull()).alias("registered"), F.coalesce("_s1", "_s2").alias("registry_status"), F.coalesce("_d1", "_d2", F.lit(False)).alias("is_default"), F.coalesce("has_contract", F.lit(False)).alias("has_contract"))


def snapshot(registry: DataFrame) -> DataFrame:
    """One row on a registry: corpora, active ones, the default."""
    on = F.coalesce("status", F.lit("active")) == "active"
    return registry.agg(F.count(F.lit(1)).alias("corpora"), F.count_if(on).alias("active"), F.min(F.when(on & F.col("is_default"), F.col("corpus_id"))).alias("default_corpus"))
