"""Exact deduplication by composable polynomial fingerprints.

A fingerprint of bytes b_0..b_(n-1) is sum b_i * B^(n-1-i) modulo two primes, with the length. Fingerprints compose:
H(xy) = H(x) * B^|y| + H(y), so the chunks of a huge text are hashed apart, in parallel, and summed with their shifts.
Rows whose fingerprints are equal are candidates only; each is compared with its group's representative, chunk by chunk:
both texts are cut into rows of PART bytes, which meet by the representative's id and the chunk's number, so that no row
holds two texts and a huge one is compared by several tasks.

Defined results: null text counts as empty; empty texts are equal to each other; repeated rows each get their row (all
that carry the largest doc_id of a group are marked kept); a null doc_id is never chosen while the group has another;
an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import bounded, checkpoint, id_type, lean, small_batches, written

#: Two primes below 2^31 and the base of the polynomial for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes hashed at once: 2^16 products below 2^39 stay below 2^64.
CHUNK = 1 << 16
#: Texts beyond this many bytes are cut into chunk rows, which different tasks hash.
HUGE = 8 << 20
#: Bytes of a chunk in a comparison.
PART = 1 << 20
KEY = ["fp_a", "fp_b", "n_bytes"]

_weights: list[np.ndarray] = []


def weights() -> list[np.ndarray]:
    """For each prime B^(CHUNK-1), ..., B, 1."""
    if not _weights:
        for p, b in zip(PRIMES, BASES, strict=True):
            w = np.ones(CHUNK, dtype=np.uint64)
            for i in range(1, CHUNK):
                w[i] = int(w[i - 1]) * b % p
            _weights.append(w[::-1].copy())
    return _weights


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of xy from those of x and y."""
    n = right[2]
    a, b = ((h * pow(base, n, p) + k) % p for h, k, base, p in zip(left, right, BASES, PRIMES, strict=False))
    return a, b, left[2] + n


def fingerprint(data: bytes | memoryview | np.ndarray) -> tuple[int, int, int]:
    """Fingerprint of one text, chunk by chunk."""
    x = np.frombuffer(data, dtype=np.uint8) if not isinstance(data, np.ndarray) else data
    out = (0, 0, 0)
    for i in range(0, len(x), CHUNK):
        part = x[i : i + CHUNK].astype(np.uint64)
        h = [int(np.dot(part, w[CHUNK - len(part) :])) % p for w, p in zip(weights(), PRIMES, strict=True)]
        out = combine(out, (h[0], h[1], len(part)))
    return out


def _views(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value of a binary column, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]]


def _hash_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in _views(batch.column(2))], dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(3))], names=["doc_id", "text_sha256", *KEY])


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, sha, tail, part): the part's hash, shifted by the bytes that follow it."""
    for batch in batches:
        tails = batch.column(3).to_pylist()
        rows = []
        for tail, x in zip(tails, _views(batch.column(4)), strict=True):
            a, b, n = fingerprint(x)
            rows.append((a * pow(BASES[0], tail, PRIMES[0]) % PRIMES[0], b * pow(BASES[1], tail, PRIMES[1]) % PRIMES[1], n))
        found = np.array(rows, dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array(found[:, k]) for k in range(3))], names=["row", "doc_id", "text_sha256", *KEY])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """(doc_id, text_sha256, fp_a, fp_b, n_bytes) of every row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.col("t").cast("binary").alias("b"))
    of = f"doc_id {id_type(docs, id_col)}, text_sha256 string, fp_a long, fp_b long, n_bytes long"
    whole = rows.where(F.octet_length("b") <= huge).mapInArrow(lean(_hash_whole), of)
    parts = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("b"))
        .where(F.octet_length("b") > huge)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("b", 256).alias("text_sha256"), "b", F.octet_length("b").alias("n"))
        .select("*", F.explode(F.expr(f"sequence(0, (n - 1) div {huge})")).alias("k"))
        .select("row", "doc_id", "text_sha256", F.expr(f"cast(greatest(0, n - (k + 1) * {huge}) as long)").alias("tail"), F.expr(f"substring(b, cast(k * {huge} + 1 as int), {huge})").alias("part"))
        .repartition("row", "tail")
        .mapInArrow(lean(_hash_parts), f"row long, {of}")
        .groupBy("row", "doc_id", "text_sha256")
        .agg((F.sum("fp_a") % PRIMES[0]).alias("fp_a"), (F.sum("fp_b") % PRIMES[1]).alias("fp_b"), F.sum("n_bytes").alias("n_bytes"))
        .drop("row")
    )
    return whole.unionByName(parts)


def chunks(texts: DataFrame, key: str, part: int = PART) -> DataFrame:
    """(key, k, chunk): the texts (key, b) cut into chunks of ``part`` bytes; an empty text has none."""
    n = F.octet_length("b")
    numbered = texts.where(n > 0).select(key, "b", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / part).cast("int"))).alias("k"))
    return numbered.select(key, "k", F.substring("b", F.col("k") * part + 1, F.lit(part)).alias("chunk"))


def differing(texts: DataFrame, member: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id) of members (doc_id, keep_id) whose text isn't that of keep_id, from texts (doc_id, b) of the same lengths."""
    kept = written(member.select(F.col("keep_id").alias("doc_id")).distinct(), "kept")
    other = chunks(texts.join(bounded(kept), "doc_id", "left_semi").withColumnRenamed("doc_id", "keep_id"), "keep_id", part).withColumnRenamed("chunk", "other")
    own = chunks(texts.join(bounded(member), "doc_id").withColumn("_row", F.struct("doc_id", "keep_id")), "_row", part)
    own = own.select("_row.doc_id", "_row.keep_id", "k", "chunk")
    return own.join(other, ["keep_id", "k"]).where("chunk <> other").select("doc_id").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, moduli: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, fingerprint.

    moduli: what fingerprints are reduced by before they are compared; small ones make different texts collide, for tests.
    """
    fps = fingerprints(docs, id_col, text_col, huge)
    fps = checkpoint(fps.withColumns({"fp_a": F.col("fp_a") % moduli[0], "fp_b": F.col("fp_b") % moduli[1]}))
    groups = fps.groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Written first, so that both sides of the joins are plain exchanges, whose hot partitions Spark can split.
    several = written(groups.where("group_size > 1"), "several")
    found = checkpoint(fps.join(bounded(several), KEY, "left").withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1))}))
    member = written(found.where("doc_id <> keep_id").select("doc_id", "keep_id").distinct(), "member")
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b"))
    differs = written(differing(text, member), "differs")
    out = found
    if not differs.isEmpty():
        # Different texts with equal fingerprints: the groups concerned are formed anew, by the texts themselves.
        bad = checkpoint(fps.join(differs, "doc_id", "left_semi").select(*KEY).distinct())
        row = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row")
        ids = fps.join(bounded(bad, 10_000), KEY, "left_semi").select(row, "text_sha256", *KEY).distinct()
        again = text.select("doc_id", row, "b", F.sha2("b", 256).alias("text_sha256")).join(ids, ["row", "text_sha256"])
        by_text = again.groupBy("b").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        redone = again.join(by_text, "b").select("doc_id", "text_sha256", "keep_id", "group_size", *KEY)
        fresh = found.join(bounded(bad, 10_000), KEY, "left_anti").select("doc_id", "text_sha256", "keep_id", "group_size", *KEY)
        out = fresh.unionByName(redone)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.format_string("%08x%08x", "fp_a", "fp_b").alias("fingerprint"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows with one doc_id and text, one."""
    found = checkpoint(exact_groups(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"))
    gone = checkpoint(found.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct())
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    stay = docs.join(bounded(gone, 200_000), F.col(id_col).eqNullSafe(F.col("_gone")) & (text == F.col("_sha")), "left_anti")
    repeated = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if repeated.isEmpty():
        return stay
    return stay.withColumn("_sha", text).dropDuplicates([id_col, "_sha"]).drop("_sha")
