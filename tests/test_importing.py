"""Imports of chat exports into a corpus's tables, on small files."""

from __future__ import annotations

import json

from loomspark.operators import importing
from loomspark.sources import exports, imports, sinks


def node(i, parent, children, role, text, at, kind="text"):
    return {"id": i, "parent": parent, "children": children, "message": {"id": i, "author": {"role": role}, "create_time": at, "content": {"content_type": kind, "parts": [text]}}}


def mapping(cid, title, *said):
    nodes = {f"n{i}": node(f"n{i}", f"n{i - 1}" if i else None, [f"n{i + 1}"] if i + 1 < len(said) else [], role, text, float(i)) for i, (role, text) in enumerate(said)}
    return {"conversation_id": cid, "title": title, "create_time": 1.0, "update_time": 1700000000.5, "mapping": nodes}


ASK = ("user", "We need to build the parser this week. Whether it holds is unclear to me?")
ANSWER = ("assistant", "Parser parser index.")


def export(folder, *conversations):
    folder.mkdir(parents=True)
    (folder / "conversations.json").write_text(json.dumps(conversations))
    (folder / "user.json").write_text("{}")


def test_mapping_import(spark, tmp_path):
    export(tmp_path / "in" / "p1", mapping("c1-aaaaaaaa", "Parser Plan", ("system", "hide"), ASK, ANSWER), mapping("c2", None, ("assistant", "first"), ASK), mapping("c3", "Empty", ("system", "x")))
    export(tmp_path / "in" / "p2", mapping("c1-aaaaaaaa", "Later", ASK), mapping(None, " ", ("assistant", "only this")))
    root = str(tmp_path / "out")
    got = imports.import_export(spark, str(tmp_path / "in"), root, "My Corpus").first()
    assert (got.corpus_id, got.threads, got.pairs, got.actions, got.unresolved) == ("my-corpus", 3, 4, 2, 2)
    assert (got.empty_conversations, got.duplicate_conversations_skipped, got.bundle_part_count, got.near_duplicates, got.adapter_type) == (1, 1, 2, 1, "chatgpt-export")
    threads = {r.conversation_id: r for r in sinks.read_table(spark, f"{root}/corpus/threads-index").collect()}
    assert threads["c1-aaaaaaaa"].thread_uid == "thread-parser-plan-c1-aaaaa"
    assert threads["c1-aaaaaaaa"].update_time_iso == "2023-11-14T22:13:20.500000+00:00"
    assert threads["c1-aaaaaaaa"].keywords[0] == "parser"
    assert threads["c1-aaaaaaaa"].semantic_v3_entities[:2] == ["Parser Plan", "Parser"]
    assert threads["c2"].title_raw == ASK[1] and threads["chatgpt-0004"].title_raw == "ChatGPT Conversation 0004"
    pairs = sorted((r.thread_uid, r.pair_id[-3:], r.title) for r in sinks.read_table(spark, f"{root}/corpus/pairs-index").collect())
    assert ("thread-parser-plan-c1-aaaaa", "001", ASK[1]) in pairs
    assert [t for u, n, t in pairs if n == "002"] == [ASK[1]]
    action = sinks.read_table(spark, f"{root}/corpus/action-ledger").where("at = 1").first()
    assert (action.action_key, action.status, action.family_ids) == ("action-we-need-to-build-the-parser-this-week", "open", ["family-parser-plan-c1-aaaaa"])
    audit = {r.thread_uid: r for r in sinks.read_table(spark, f"{root}/corpus/import-audit").collect()}["thread-parser-plan-c1-aaaaa"]
    assert (audit.mapping_node_count, audit.path_node_count, audit.retained_count, audit.raw_role_counts) == (3, 2, 2, {"system": 1, "user": 1, "assistant": 1})
    aliases = sinks.read_table(spark, f"{root}/corpus/entity-aliases").where("canonical_label = 'Parser'").orderBy("at").collect()
    assert [r.label for r in aliases] == ["Parser Plan", ASK[1]]
    near = sinks.read_table(spark, f"{root}/corpus/near-duplicates").first()
    assert near.similarity == 1.0 and near.thread_uids[0] == "thread-parser-plan-c1-aaaaa"
    assert sorted(r.pair_count for r in sinks.read_table(spark, f"{root}/import-manifest").collect()) == [1, 1, 2]


def test_message_list_import(spark, tmp_path):
    said = [{"sender": "human", "created_at": "2024-01-01", "text": "What is it?"}, {"sender": "assistant", "created_at": "2024-01-02", "text": "", "content": [{"type": "tool_use", "name": "repl", "input": {"title": "run"}}, {"type": "tool_result", "name": "repl", "content": [{"type": "text", "text": "OK"}, {"type": "text", "text": "done"}]}]}, {"sender": "assistant", "created_at": "2024-01-03", "text": "", "content": []}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "conversations.json").write_text(json.dumps([{"uuid": "u1", "name": "", "summary": "A summary", "updated_at": "2024-02-02", "chat_messages": said}]))
    (tmp_path / "in" / "users.json").write_text("[]")
    root = str(tmp_path / "out")
    got = imports.import_export(spark, str(tmp_path / "in"), root, "x").first()
    assert (got.threads, got.pairs, got.adapter_type, got.flagged_threads) == (1, 1, "claude-export", 0)
    pair = sinks.read_table(spark, f"{root}/corpus/pairs-index").first()
    assert pair.summary == "User: What is it? Assistant: [tool_use:repl:run] [tool_result:repl] done"
    audit = sinks.read_table(spark, f"{root}/corpus/import-audit").first()
    assert (audit.mapping_node_count, audit.skipped_count, audit.empty_render_count, audit.raw_content_type_counts) == (3, 1, 0, {"text_field": 1, "tool_use": 1, "tool_result": 1, "none": 1})


def test_empty_import(spark):
    conversations = spark.createDataFrame([], "cid string, at long, title string, stamp string")
    messages = spark.createDataFrame([], "cid string, turn long, role string, text string, hidden boolean")
    raw = spark.createDataFrame([], "cid string, role string, kind string, entry boolean")
    made = importing.tables(conversations, messages, raw, "mapping")
    assert importing.summary(made, conversations, "x", "mapping").first().threads == 0
    assert made["threads-index"].count() == 0


def test_segments():
    assert exports.text_segments({"text": " a  b", "content": [{"text": "c"}, "A B", {"value": {"stdout": "d"}}]}) == ["a b", "c", "d"]
