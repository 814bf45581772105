"""SimHash near-duplicates by a segment-popcount embedding.

Each text gets a 64-bit SimHash of its 4-word shingles. A fingerprint is mapped to the bit counts of its 32 two-bit
segments, a point of {0,1,2}^32; the Manhattan distance of two points is never over the Hamming distance. The segments
lie in seven groups; if the Manhattan distance is 4 or less, at least three groups are equal, so equal cells of one of
the 35 three-group subgrids hold every pair. Pairs of a cell are kept if their Manhattan distance allows it, then
verified on the 64 bits. A cell with many fingerprints is cut into blocks; each pair of blocks is a task's own group.

Defined results: null and empty texts have fingerprint zero and link like any other; copies collapse to one fingerprint
before the join; repeated rows each get a row; a null doc_id is never a component's id while it has another, and a
component without any has a null one; ids are of any type with an order; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import bounded, checkpoint, id_type, lean, small_batches, written
from loomspark.llm.components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
GROUPS = 7
#: Fingerprints of a cell that are compared as one block.
BLOCK = 256

#: For each byte its bits as eight byte counters.
_SPREAD = np.array([sum(1 << (8 * k) for k in range(8) if v >> k & 1) for v in range(256)], dtype=np.uint64)


def simhash(text: bytes) -> int:
    """Fingerprint of one text; bytes.lower and bytes.split know ASCII letters and ASCII white space only."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    flat, of = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return of(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = [0, *ends[: n - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    m = n - SHINGLE + 1
    hashes = np.fromiter((of(flat[s:e], SEED) for s, e in zip(starts, stops, strict=True)), dtype=np.uint64, count=m).view(np.uint8).reshape(m, 8)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, m, 255):
        counts += _SPREAD[hashes[i : i + 255]].sum(axis=0).view(np.uint8)
    return int(np.packbits(counts * 2 > m, bitorder="little").view(np.uint64)[0])


def _hash_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((simhash(x or b"") for x in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("b")).mapInArrow(lean(_hash_batch), f"doc_id {id_type(docs, id_col)}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks() -> list[int]:
    """For each three of the seven groups of two-bit segments, the bits of those groups."""
    cuts = [round(32 * g / GROUPS) for g in range(GROUPS + 1)]
    groups = [sum(3 << (2 * s) for s in range(cuts[g], cuts[g + 1])) for g in range(GROUPS)]
    return [_signed(sum(groups[g] for g in chosen)) for chosen in combinations(range(GROUPS), GROUPS - MAX_BITS)]


_LOW = 0x5555555555555555


def _embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments in unary (0: 00, 1: 01, 2: 11): differing bits are the Manhattan distance."""
    low = np.uint64(_LOW)
    high = fp >> np.uint64(1)
    return ((fp | high) & low) | (((fp & high) & low) << np.uint64(1))


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key: links inside each key, as many as join what they connect."""
    rest = None
    for batch in batches:
        key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        if rest is not None:
            key, fp = (np.concatenate(x) for x in zip(rest, (key, fp), strict=True))
        last = np.searchsorted(key, key[-1], side="left") if len(key) else 0
        rest = (key[last:], fp[last:])
        if last:
            yield _links(key[:last], fp[:last])
    if rest is not None and len(rest[0]):
        yield _links(*rest)


def _links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    bits = fp.view(np.uint64)
    point = _embed(bits)
    n = len(key)
    label = list(range(n))
    left, right = [], []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    at = np.arange(n)
    roots = at.copy()
    step = 1
    while True:
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        to = at + step
        near = np.bitwise_count(point[at] ^ point[to]) <= MAX_BITS
        near &= roots[at] != roots[to]
        i, j = at[near], to[near]
        close = np.bitwise_count(bits[i] ^ bits[j]) <= MAX_BITS
        joined = False
        for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                label[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(b)
                joined = True
        if joined:
            roots = np.array(label)
            while (up := roots[roots] != roots).any():
                roots = np.where(up, roots[roots], roots)
        step += 1
    return pa.RecordBatch.from_arrays([pa.array(fp[left]), pa.array(fp[right])], names=["a", "b"])


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): fingerprints of ``fps`` (distinct, column fp) that differ in MAX_BITS bits or fewer.

    Enough pairs to connect all that are linked; a pair that others of its cell already connect isn't repeated.
    """
    high = F.shiftrightunsigned("fp", 1)
    low = F.lit(_LOW)
    embedded = F.col("fp").bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(high).bitwiseAND(low), 1))
    point = fps.select("fp", embedded.alias("p"))
    cells = point.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("p").bitwiseAND(F.lit(m))) for k, m in enumerate(cell_masks())))).alias("key"))
    large = checkpoint(cells.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("m")))
    if large.isEmpty():
        rows = cells.select("key", "fp")
    else:
        dealt = cells.join(bounded(large, 500_000), "key", "left")
        own = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("m")).cast("int")
        dealt = dealt.select("key", "fp", F.coalesce("m", F.lit(1)).alias("m"), F.coalesce(own, F.lit(0)).alias("own"))
        pair = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("with")
        dealt = dealt.select("key", "fp", "m", "own", pair)
        rows = dealt.select(F.when(F.col("m") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with"))).alias("key"), "fp")
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return rows.repartition(int(parts), "key").sortWithinPartitions("key").mapInArrow(lean(_link_cells), "a long, b long").distinct()


def _rooted(fps: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints of fps: root is the smallest fingerprint reachable."""
    nodes = written(fps.select("fp").distinct(), "nodes")
    roots = written(connected_components(links(nodes)), "roots")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    # Written before they are joined: both sides then have exchanges of their own, whose hot partitions Spark can split.
    placed = written(_rooted(fps).join(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp"), "placed")
    least = written(placed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    by_fp = written(placed.join(least, "root").select("fp", "component_id"), "by_fp")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: that of the smallest doc_id.

    Rows are told apart by id and text. Of rows that share the id, the one whose text has the smaller hash stays; in a
    component without ids, the one with the smallest hash; of rows alike in both, one.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("text")).alias("doc_id"), F.col(text_col).alias("text"))
    fps = written(fingerprints(rows), "fingerprints")
    placed = written(fps.join(written(_rooted(fps), "rooted"), "fp").select("root", "doc_id"), "placed")
    first = written(placed.groupBy("root").agg(F.min("doc_id").alias("first")), "firsts")
    gone = written(placed.join(first, "root").where("doc_id <> first").select(F.col("doc_id.id").alias("_gone"), F.col("doc_id.text").alias("_text")).distinct(), "gone")
    stay = docs.join(bounded(gone), F.col(id_col).eqNullSafe(F.col("_gone")) & (key == F.col("_text")), "left_anti")
    if placed.join(first, "root").where("doc_id = first").groupBy("root").count().where("count > 1").isEmpty():
        return stay
    return stay.withColumn("_text", key).dropDuplicates([id_col, "_text"]).drop("_text")
