"""Benchmark decontamination by spaced-seed hashing.

Column expressions only. Words (runs of letters and digits, lower-cased) are hashed; a mask such as 110101 hashes the
words at its ones and ignores the others, so a substituted word under a zero changes nothing. The masks' hashes at
every position of every document are probed against those of the benchmark, which is broadcast in blocks of bounded
size; a block reads the documents once for all masks. Around each hit every window of WINDOW words of the item that holds
it is laid along the hit's diagonal; a word matches if it stands in the document at its place or BAND words from it. A
pair (document, item) is reported when LEAST of a window matches. With these masks every window of 10 or more words with a
fifth of its words substituted has a hit.

Defined results: null or empty texts have no words and no rows; an item of 5 to 9 words uses the mask 11, one of fewer
words has to occur word for word (an item of one word is found wherever that word is); repeated rows with one doc_id give
one row for each item, and so do rows without a doc_id, under null; benchmark rows that share an item_id count as one
item; an excerpt of an item is reported from WINDOW words on (less LEAST), a shorter one isn't; an empty table on either
side gives an empty result; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import bounded, checkpoint

#: The masks by the least number of words of the items that they are for.
MASKS = {10: ("110101", "1100011"), 5: ("11",), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",)}
WINDOW = 25
BAND = 2
LEAST = 0.8
#: Rows (key, item, position) that are broadcast at once: 32 bytes each, so 64 MB.
BLOCK_ROWS = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _keys(h: str, mask: str) -> Column:
    """The mask's hash at each position of the array column h."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    last = F.size(h) - len(mask)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(mask), *(F.get(F.col(h), i + o) for o in ones)))


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), words(F.col(text).cast("string")).alias("w")).select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def masks_of(words: int) -> tuple[str, ...]:
    """The masks that items of so many words are sought with."""
    return next(masks for least, masks in MASKS.items() if words >= least)


def _hits(docs: DataFrame, seeds: DataFrame, masks: list[str]) -> DataFrame:
    """Stretches (doc_id, item, s, at, seen) around the seeds' hits: the item's words s.. lie at the document's at..

    Hits on one diagonal in the same WINDOW words of the item give one stretch, which holds all their windows.
    """
    # The outer form: before a plain explode, Spark would put a filter that computes the keys anew.
    keyed = docs.select("id", "h", F.array(*(_keys("h", m) for m in masks)).alias("keys")).select("id", "h", F.flatten("keys").alias("keys"), *(F.size(F.col("keys")[k]).alias(f"n{k}") for k in range(len(masks))))
    probed = keyed.select("id", "h", *(f"n{k}" for k in range(len(masks))), F.posexplode_outer("keys").alias("pos", "key")).join(F.broadcast(seeds), "key")
    # The place within the mask's own keys: those of the masks before it are taken off.
    p = F.col("pos")
    before = F.lit(0)
    for k in range(len(masks)):
        p = F.when(F.col("pos") >= before, F.col("pos") - before).otherwise(p)
        before = before + F.col(f"n{k}")
    block = F.floor(F.col("q") / WINDOW).cast("int") * WINDOW
    s = F.greatest(F.lit(0), block - (WINDOW - 1))
    found = probed.select("id", "h", "item", "n", s.alias("s"), F.least(F.col("n"), block + 2 * WINDOW - 1).alias("e"), (p - F.col("q")).alias("diagonal"))
    at = F.col("diagonal") + F.col("s")
    low = F.greatest(at - BAND, F.lit(0))
    high = F.least(F.col("diagonal") + F.col("e") + BAND, F.size("h"))
    return found.select(F.col("id").alias("doc_id"), "item", "s", "e", at.alias("at"), F.slice("h", low + 1, F.greatest(high - low, F.lit(0))).alias("seen"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, similarity, matched, words, doc_at, item_at."""
    items = _hashed(benchmark, item_col, item_text).where(F.size("h") > 0)
    items = checkpoint(items.select("id", "h", F.size("h").alias("n"), F.xxhash64("id", "h").alias("item")).dropDuplicates(["item", "n"]))
    sizes = {r["n"]: r["count"] for r in items.groupBy(F.least("n", F.lit(max(MASKS))).alias("n")).count().collect()}
    masks = sorted({m for n in sizes for m in masks_of(n)})
    if not masks:
        return items.where("false").join(docs.select(F.col(id_col).alias("doc_id")).where("false")).select("doc_id", F.col("id").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("matched"), F.lit(0).alias("words"), F.lit(0).alias("doc_at"), F.lit(0).alias("item_at"))
    none = F.expr("cast(array() as array<bigint>)")

    def wanted(mask: str) -> Column:
        fits = [k for k, held in MASKS.items() if mask in held]
        tests = [(F.col("n") >= k) & (F.col("n") < min([x for x in MASKS if x > k], default=1 << 30)) for k in fits]
        return reduce(lambda a, b: a | b, tests)

    keys = F.array(*(F.when(wanted(m), _keys("h", m)).otherwise(none) for m in masks))
    seeds = checkpoint(items.select("item", "n", F.explode(keys).alias("keys")).select("item", "n", F.posexplode("keys").alias("q", "key")))
    blocks = max(1, -(-seeds.count() // BLOCK_ROWS))
    hashed = _hashed(docs, id_col, text_col)
    out = None
    for b in range(blocks):
        part = seeds.where(F.pmod(F.xxhash64("item", "q"), F.lit(blocks)) == b) if blocks > 1 else seeds
        hits = _hits(hashed, part, masks)
        out = hits if out is None else out.unionByName(hits)
    stretches = out.groupBy("doc_id", "item", "s", "e", "at").agg(F.first("seen").alias("seen"))
    wide = F.least(F.lit(WINDOW), F.col("n"))
    low = F.greatest(F.col("at") - BAND, F.lit(0))

    def matches(j: Column) -> Column:
        here = F.col("at") + j - low
        word = F.get("h", F.col("s") + j)
        same = F.lit(False)
        for d in range(-BAND, BAND + 1):
            same = same | F.coalesce(F.get("seen", here + d) == word, F.lit(False))
        return same.cast("int")

    checked = stretches.join(bounded(items.select("item", "id", "h", "n"), 20_000), "item")
    flags = F.transform(F.sequence(F.lit(0), F.col("e") - F.col("s") - 1), matches)
    checked = checked.select("doc_id", F.col("id").alias("item_id"), "s", "at", wide.alias("words"), flags.alias("flags"))
    sums = F.aggregate("flags", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    checked = checked.withColumn("sums", sums)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("flags") - F.col("words")), lambda i: F.struct((F.get("sums", i + F.col("words")) - F.get("sums", i)).alias("matched"), (-i).alias("before"))))
    passed = checked.withColumn("best", best).where(F.col("best.matched") >= F.ceil(F.col("words") * LEAST))
    place = F.col("best.before")
    best = F.max(F.struct((F.col("best.matched") / F.col("words")).alias("similarity"), F.col("best.matched").alias("matched"), "words", (-F.greatest(F.col("at") - place, F.lit(0))).alias("before"), (place - F.col("s")).alias("from"))).alias("best")
    return passed.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", "best.matched", "best.words", (-F.col("best.before")).alias("doc_at"), (-F.col("best.from")).alias("item_at"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that overlap no benchmark item; told by their texts, not by their ids."""
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = contaminated(docs.select(sha.alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    gone = checkpoint(found.select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(bounded(gone, 200_000), sha == F.col("_gone"), "left_anti")
