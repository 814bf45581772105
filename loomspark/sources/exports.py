"""Readers of chat exports, Markdown and mixed documents, as frames with fixed schemas.

Conversations come as messages (conversation_id, turn, role, text, create_time); files as (path, ext, title, text).
"""

from __future__ import annotations

import csv
import html
import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from loomspark.functions import text as T

MESSAGE = "struct<id:string,author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<string>,text:string,language:string>>"
MAPPING = f"title string, create_time double, update_time double, conversation_id string, mapping map<string, struct<id:string,parent:string,children:array<string>,message:{MESSAGE}>>"
ITEM = "struct<type:string,text:string,name:string,title:string,language:string,mime_type:string,input:string,content:string,value:string,code:string,output:string,stdout:string,stderr:string,is_error:boolean,width:int,height:int,file_name:string>"
FILE = "struct<file_name:string,name:string>"
MESSAGES = f"uuid string, name string, summary string, created_at string, updated_at string, chat_messages array<struct<uuid:string,sender:string,created_at:string,updated_at:string,text:string,content:array<{ITEM}>,attachments:array<{FILE}>,files:array<{FILE}>>>"
EXPORTER = "metadata struct<title:string,link:string,dates:struct<created:string,updated:string>>, messages array<struct<role:string,say:string>>"
#: Content that isn't shown, and where long output is cut.
SKIPPED_CONTENT = ["user_editable_context", "model_editable_context", "thoughts"]
CUT = 500
NESTED = ["content", "value", "output", "stdout", "stderr"]
SAID_AGAIN = ["code", "tool_use", "tool_result", "execution_output", "tool_output", "image", "image_asset", "image_pointer", "attachment", "document", "file"]
EXTENSIONS = ["md", "markdown", "txt", "html", "htm", "json", "csv"]


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or lines; an empty frame of the schema if there is nothing at the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in order; rows without a key all stay."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.where(F.col(key).isNotNull()).withColumn("_n", n).where("_n = 1").drop("_n").unionByName(rows.where(F.col(key).isNull()))


def _part_text(part: Column, images: bool) -> Column:
    """A part is text, or an object with text; in content of several media also an image, by its size."""
    is_object = F.startswith(F.trim(part), F.lit("{"))
    wide, high = F.get_json_object(part, "$.width"), F.get_json_object(part, "$.height")
    size = F.concat(F.lit("[Image: "), F.coalesce(F.concat(wide, F.lit("x"), high), F.lit("unknown")), F.lit("]"))
    kind, text = F.get_json_object(part, "$.content_type"), F.coalesce(F.get_json_object(part, "$.text"), F.lit(""))
    held = F.when(kind == "text", text).when(kind == "image_asset_pointer", size).otherwise("") if images else text
    return F.when(is_object, held).otherwise(F.coalesce(part, F.lit("")))


def _cut(x: Column) -> Column:
    return F.when(F.length(x) > CUT, F.concat(F.left(x, F.lit(CUT - 3)), F.lit("..."))).otherwise(x)


def node_text(role: Column, content: Column) -> Column:
    """What a node of a mapping shows, by content type; what has none is text."""
    kind, parts = F.coalesce(F.nullif(content["content_type"], F.lit("")), F.lit("text")), F.coalesce(content["parts"], F.array().cast("array<string>"))

    def joined(images: bool) -> Column:
        return T.normalize_space(F.array_join(F.transform(parts, lambda p: _part_text(p, images)), " "))

    own = F.coalesce(content["text"], F.lit(""))
    plain = F.array_join(F.filter(parts, lambda p: p.isNotNull() & ~F.startswith(F.trim(p), F.lit("{"))), " ")
    raw = F.trim(F.when(own != "", own).otherwise(plain))
    language = F.coalesce(F.nullif(content["language"], F.lit("")), F.lit("text"))
    shown = (
        F.when(kind == "multimodal_text", joined(True))
        .when(kind == "code", F.when(raw != "", F.concat(F.lit("```"), language, F.lit("\n"), raw, F.lit("\n```"))).otherwise(""))
        .when(kind == "execution_output", F.when(raw != "", F.concat(F.lit("[Execution output: "), _cut(raw), F.lit("]"))).otherwise(""))
        .otherwise(joined(False))
    )
    tool = F.when((role == "tool") & (shown == "") & (F.trim(own) != ""), F.concat(F.lit("[Tool output: "), _cut(F.trim(own)), F.lit("]"))).otherwise(shown)
    return F.when(kind.isin(*SKIPPED_CONTENT), F.lit("")).otherwise(T.normalize_space(tool))


def depth_first(nodes: list[tuple[str, str | None, list[str] | None]]) -> list[str]:
    """Ids of a tree's nodes (id, parent, children) from its roots on, in order; a child that isn't there is left out."""
    known = {i: children for i, _, children in nodes}
    waiting = [i for i, parent, _ in reversed(nodes) if not parent]
    out = []
    while waiting:
        i = waiting.pop()
        if i in known:
            out.append(i)
            waiting += reversed(list(known[i] if known[i] is not None else []))
    return out


@F.pandas_udf(ArrayType(StringType()))
def _depth_first(ids: pd.Series, parents: pd.Series, children: pd.Series) -> pd.Series:
    """A walk whose depth is the conversation's length, so no fixed number of joins can take it."""
    return pd.Series([depth_first(list(zip(*x, strict=True))) for x in zip(ids, parents, children, strict=True)], dtype=object)


def mapping_messages(exports: DataFrame) -> DataFrame:
    """Messages of mapping trees: all branches, without the system's, in order of time (null first), then of the tree."""
    entries = F.map_entries("mapping")
    walked = _depth_first(F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["value"]["parent"]), F.transform(entries, lambda e: e["value"]["children"]))
    rows = exports.where("mapping is not null").select("conversation_id", "title", "mapping", F.posexplode(walked).alias("place", "node_id"))
    rows = rows.select("conversation_id", "title", "place", "node_id", F.try_element_at("mapping", F.col("node_id")).alias("node")).where("node.message is not null")
    role = F.lower(F.coalesce("node.message.author.role", F.lit("")))
    order = Window.partitionBy("conversation_id").orderBy(F.coalesce("node.message.create_time", F.lit(0.0)), "place")
    seen = rows.withColumn("role", role).where("role <> 'system'").withColumn("turn", F.row_number().over(order) - 1)
    hidden = F.coalesce(F.col("node.message.content.content_type").isin(*SKIPPED_CONTENT), F.lit(False))
    return seen.select("conversation_id", F.col("turn").cast("long").alias("turn"), "role", node_text(F.col("role"), F.col("node.message.content")).alias("text"), F.col("node.message.create_time").alias("create_time"), hidden.alias("hidden"))


def iso_time(epoch: Column, now: Column | None = None) -> Column:
    """Seconds since 1970 as an ISO time in UTC, with microseconds where there are any; ``now`` where there is no time."""
    at = F.timestamp_micros(F.round(epoch * 1_000_000).cast("long"))
    whole = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(F.round(epoch * 1_000_000).cast("long"), F.lit(1_000_000))
    text = F.concat(whole, F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))
    return F.coalesce(text, now) if now is not None else text


def text_segments(value: object) -> list[str]:
    """Texts of a nested value, in order, those of one object alike but for case once."""
    if isinstance(value, str):
        said = " ".join(value.split())
        return [said] if said else []
    if isinstance(value, list):
        return [x for v in value for x in text_segments(v)]
    if not isinstance(value, dict):
        return []
    found = text_segments(value["text"]) if isinstance(value.get("text"), str) else []
    found += [x for k in NESTED if k in value for x in text_segments(value[k])]
    first: dict[str, str] = {}
    for x in found:
        first.setdefault(x.lower(), x)
    return list(first.values())


def _read(text: str | None) -> object:
    """A field of a JSON document: Spark hands objects and lists on as JSON, strings as they are."""
    if text and text[:1] in "[{":
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


@F.pandas_udf(ArrayType(StringType()))
def _segments(items: pd.DataFrame) -> pd.Series:
    """Recursion over content of any depth, which columns can't express."""
    rows = items[["text", *NESTED]].to_dict("records")
    return pd.Series([text_segments({k: _read(v) for k, v in row.items() if isinstance(v, str)}) for row in rows], dtype=object)


def _item_text(x: Column, nested: Column) -> Column:
    """What a typed item of a message shows, as a list; ``nested`` are the texts in it."""

    def first(*names: str) -> Column:
        return F.coalesce(*(F.nullif(x[n], F.lit("")) for n in names))

    def one(*parts: Column) -> Column:
        return F.array(F.concat(*parts))

    kind, name = F.lower(F.coalesce(x["type"], F.lit(""))), F.coalesce(first("name"), F.lit("tool"))
    asked = F.coalesce(*(F.nullif(F.get_json_object(x["input"], f"$.{k}"), F.lit("")) for k in ("title", "id", "type")))
    language = F.coalesce(first("language", "mime_type"), F.lit("text"))
    written = F.coalesce(*(F.nullif(F.trim(x[n]), F.lit("")) for n in ("text", "content", "code", "value")), F.nullif(F.array_join(nested, "\n"), F.lit("")))
    result = F.array_join(F.filter(nested, lambda s: F.upper(s) != "OK"), " ")
    output = T.normalize_space(F.array_join(nested, " "))
    size = F.concat(x["width"].cast("string"), F.lit("x"), x["height"].cast("string"))
    close = F.lit("]")
    return (
        F.when(kind == "text", F.array(T.normalize_space(F.coalesce(x["text"], F.lit("")))))
        .when(kind == "code", F.array(F.coalesce(F.concat(F.lit("```"), language, F.lit("\n"), written, F.lit("\n```")), F.concat(F.lit("[code:"), language, close))))
        .when(kind == "tool_use", one(F.lit("[tool_use:"), name, F.coalesce(F.concat(F.lit(":"), asked), F.lit("")), close))
        .when(kind == "tool_result", F.array(F.when(result != "", T.shorten(F.concat(F.lit("[tool_result:"), name, F.lit("] "), result), 200)).otherwise(F.concat(F.lit("[tool_result:"), name, F.when(x["is_error"], ":error").otherwise(""), close))))
        .when(kind.isin("execution_output", "tool_output"), F.array(F.when(output != "", F.concat(F.lit("[Execution output: "), _cut(output), close)).otherwise(F.lit("[Execution output]"))))
        .when(kind.isin("image", "image_asset", "image_pointer"), one(F.lit("[Image: "), F.coalesce(first("file_name", "name", "title"), size, first("mime_type"), F.lit("image")), close))
        .when(kind.isin("attachment", "document", "file"), F.array(F.coalesce(F.concat(F.lit("[file:"), first("file_name", "name", "title"), close), F.lit(""))))
        .otherwise(nested)
    )


def list_messages(exports: DataFrame) -> DataFrame:
    """Messages of message lists: text, typed content, attachments and files; ordered by time, then place.

    A text that a message has said already isn't said again; code, results and names are.
    """
    rows = exports.select(F.col("uuid").alias("conversation_id"), F.posexplode("chat_messages").alias("pos", "m"))
    items = rows.select("conversation_id", "pos", F.posexplode("m.content").alias("i", "x"))
    kind = F.lower(F.coalesce("x.type", F.lit("")))
    once = ~kind.isin(*SAID_AGAIN)
    said = items.select("conversation_id", "pos", "i", F.transform(_item_text(F.col("x"), _segments("x")), lambda s: F.struct(s.alias("s"), once.alias("once"))).alias("said"))
    gathered = said.groupBy("conversation_id", "pos").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "said"))), lambda e: e["said"])).alias("said"))
    rows = rows.alias("r").join(gathered.alias("g"), F.col("r.conversation_id").eqNullSafe(F.col("g.conversation_id")) & (F.col("r.pos") == F.col("g.pos")), "left").select("r.*", "g.said")

    def names(files: Column, label: str) -> Column:
        return F.transform(F.coalesce(files, F.array()), lambda f: F.coalesce(F.concat(F.lit(f"[{label}:"), F.coalesce(F.nullif(f["file_name"], F.lit("")), F.nullif(f["name"], F.lit(""))), F.lit("]")), F.lit("")))

    def add(held: Column, e: Column) -> Column:
        return F.when((e["s"] == "") | (e["once"] & F.array_contains(held, e["s"])), held).otherwise(F.concat(held, F.array(e["s"])))

    parts = F.aggregate(F.coalesce("said", F.expr("cast(array() as array<struct<s:string,once:boolean>>)")), F.array(T.normalize_space("m.text")), add)
    text = T.normalize_space(F.array_join(F.concat(parts, names(F.col("m.attachments"), "attachment"), names(F.col("m.files"), "file")), " "))
    stamp = F.coalesce(F.nullif("m.created_at", F.lit("")), F.nullif("m.updated_at", F.lit("")))
    order = Window.partitionBy("conversation_id").orderBy(stamp.asc_nulls_last(), "pos")
    role = F.when(F.lower("m.sender") == "human", "user").otherwise("assistant")
    hidden = (T.normalize_space("m.text") == "") & (F.coalesce(F.size("m.content"), F.lit(0)) <= 0)
    return rows.select("conversation_id", (F.row_number().over(order) - 1).cast("long").alias("turn"), role.alias("role"), text.alias("text"), stamp.alias("created_at"), hidden.alias("hidden"))


def exporter_messages(docs: DataFrame, fallback: Column) -> DataFrame:
    """Messages of browser-exporter documents; blank ones go, times run on from the document's date by place."""
    link = F.coalesce("metadata.link", F.lit(""))
    uid = F.coalesce(F.nullif(F.regexp_extract(link, "/c/([0-9a-f-]{8,})", 1), F.lit("")), F.left(F.sha1(fallback), F.lit(36)))
    dated = F.coalesce(F.try_to_timestamp("metadata.dates.created", F.lit("M/d/yyyy H:mm:ss")), F.try_to_timestamp("metadata.dates.created", F.lit("M/d/yyyy h:mm:ss a")))
    rows = docs.select(uid.alias("conversation_id"), F.unix_timestamp(dated).alias("base"), F.posexplode("messages").alias("pos", "m"))
    low = F.lower(F.trim(F.coalesce("m.role", F.lit(""))))
    role = F.when(low.isin("user", "human", "you"), "user").when(low.isin("assistant", "chatgpt", "ai"), "assistant").when(low == "system", "system").otherwise(low)
    return rows.where(F.trim(F.coalesce("m.say", F.lit(""))) != "").select("conversation_id", F.col("pos").cast("long").alias("turn"), role.alias("role"), F.col("m.say").alias("text"), (F.col("base") + F.col("pos")).cast("double").alias("create_time"))


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, ext, size, modified, content) of the files that documents can be made from; hidden ones are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    path = F.col("path")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return rows.select(path, ext.alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").where(F.col("ext").isin(*EXTENSIONS) & ~path.rlike(r"/(\.|__MACOSX)"))


def flatten_json(value: object, prefix: str = "") -> list[str]:
    """``a.b[0]: v`` lines of a JSON value, without blanks."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flatten_json(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flatten_json(v, f"{prefix}[{i}]")]
    said = "" if value is None else str(value).strip()
    return [f"{prefix}: {said}" if prefix else said] if said else []


@F.udtf(returnType=StructType([StructField("line", StringType())]))
class FlattenJson:
    """Table function: the lines of flatten_json; text that isn't JSON is one line."""

    def eval(self, text: str) -> Iterator[tuple[str]]:
        try:
            lines = flatten_json(json.loads(text))
        except (TypeError, ValueError):
            lines = [text or ""]
        for line in lines:
            yield (line,)


def _structured(ext: str, text: str) -> str:
    if ext == "json":
        try:
            return "\n".join(flatten_json(json.loads(text)))
        except ValueError:
            return text
    rows = csv.reader(io.StringIO(text))
    return "\n".join(" | ".join(c.strip() for c in row if c.strip()) for row in rows if any(c.strip() for c in row))


@F.pandas_udf(StringType())
def structured_text(ext: pd.Series, text: pd.Series) -> pd.Series:
    """JSON and CSV as lines, which recursion and quoting keep from being columns."""
    return pd.Series([_structured(e, t or "") for e, t in zip(ext, text, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All character references, for pages that hold more than those of text.ENTITIES."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def documents(found: DataFrame) -> DataFrame:
    """(path, ext, title, text) of files(): Markdown as it is, pages stripped, JSON and CSV as lines; blank ones go."""
    raw = F.decode("content", "UTF-8")
    stem = F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1)
    plain = found.where(~F.col("ext").isin("json", "csv")).withColumn("text", F.when(F.col("ext").isin("html", "htm"), T.strip_html(raw)).otherwise(raw))
    made = found.where(F.col("ext").isin("json", "csv")).withColumn("text", structured_text("ext", raw))
    rows = plain.unionByName(made).where(F.trim("text") != "")
    heading = F.nullif(F.regexp_extract("text", r"(?m)^\s*#\s+(.+?)\s*$", 1), F.lit(""))
    keys = [F.nullif(F.trim(F.get_json_object(raw, f"$.{k}")), F.lit("")) for k in ("title", "name", "query", "question", "prompt")]
    words = F.initcap(F.regexp_replace(stem, "[-_]+", " "))
    title = F.when(F.col("ext") == "json", F.coalesce(*keys, words)).when(F.col("ext").isin("md", "markdown"), F.coalesce(heading, stem)).otherwise(words)
    return rows.select("path", "ext", title.alias("title"), "text")


def unpack(archive: str, target: str) -> list[str]:
    """Extract a zip file under target; names that would leave it raise."""
    root = Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} would be written outside {target}")
        z.extractall(root)
        return sorted(z.namelist())
