"""Katz backoff language model of words, of any order.

Counts of n-grams of 1 to ORDER words come from all training documents, none of them left out. An n-gram seen c times has
the probability d(c) * c / c(history), d being the Good-Turing discount of its order for counts up to K and 1 beyond; a
word that wasn't seen after a history gets alpha(history) times its probability after the history without its first
word, and so on down to single words, where alpha makes each sum exactly one. Words: d(c) * c / N, and what is left is the
probability of an unknown word. (If discounting leaves a history fewer than 1/(c(history) + 1), its n-grams are scaled
down so that it leaves that.)

The model is built from the lowest order up: the sum that alpha needs is over the probabilities of the order below, which
the step before has written. The recursion of a token, p(w | h) or alpha(h) * p(w | h'), is a sum of logarithms: that of
p(w), for each order alpha of the history, and for each n-gram in the model what it adds to the backed-off value. So a
model is one table of weights by n-gram, in which an n-gram's weight holds its alpha as a history too; scoring is one
join and a sum. Words and n-grams are known by 64-bit hashes. The weights of the most frequent FREQUENT_WORDS words and
FREQUENT_GRAMS n-grams are broadcast (16 bytes each) and applied where the text is read, so that no key of the join is
hot; the sums that are known there go through it under keys of their own, dealt out over SALTS.

``scored`` scores the table that it learns from and needs no such table: katz_parts gives the same model's scores.

Defined results: null text counts as empty; an empty text is its end mark alone; rows that share a doc_id are parts of
one document, in one result row; a null doc_id is learned from by no one, and rows without one are scored as one document;
ids are of any type; without any training text every token is unknown with probability one; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import crc_mod, drop, id_type, release, small_batches, written

ORDER = 3
K = 5
FREQUENT_WORDS = 500_000
FREQUENT_GRAMS = 400_000
#: Tokens that a task holds before it hands on their counts.
BUFFER = 3_000_000
ROWS = 100_000
#: Bytes of the texts that are scored together, but for the last one's.
TOGETHER = 3_000_000
#: Hashes of the end of a text and of what stands before its first word; no word has white space.
END = xxhash.xxh64_intdigest(b" end", 42)
START = xxhash.xxh64_intdigest(b" start", 42)
#: Sums that are known where a text is read, and the keys that each is dealt out over.
SUMS = ("tokens", "known", "base", "model")
SALTS = 1024

_END = b" "


class Numbered:
    """Words of some texts as numbers from 0 on, and their hashes; END is 0."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.number[_END]

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, each text followed by END; how many each text has."""
        flat, sizes = [], []
        for t in texts:
            words = (t or b"").lower().split()
            words.append(_END)
            flat += words
            sizes.append(len(words))
        return np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat)), np.array(sizes, dtype=np.int64)

    def hashes(self) -> np.ndarray:
        of = xxhash.xxh64_intdigest
        out = np.fromiter((of(w, 42) for w in self.number), dtype=np.uint64, count=len(self.number))
        out[0] = END
        return out


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of the n-gram whose history has the key left and whose last words have the key right."""
    x = (left ^ (left >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


def starts(order: int) -> list[int]:
    """Keys of the histories before a text's first word, by their length; the first is no key."""
    out = [0, START]
    for _ in range(2, order):
        one = np.array([out[-1]], dtype=np.uint64)
        out.append(int(mix(one, one)[0]))
    return out


def keys(words: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 2 on (key, history, lower): of the n-gram that ends at each word, without its last, its first word."""
    first = np.cumsum(sizes) - sizes
    lower = words
    for before in starts(order)[1:]:
        history = np.empty_like(lower)
        history[1:] = lower[:-1]
        history[first] = before
        key = mix(history, lower)
        yield key, history, lower
        lower = key


def _pieces(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS]) for c in columns], names=names)


def _counter(order: int) -> Callable:
    """Rows (text): (level, h, low, n), counts of n-grams by order; a word has itself as low and no h."""
    names = ["level", "h", "low", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Numbered(), []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            token, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key = words.hashes()
            total = np.bincount(token, minlength=len(key))
            seen = np.flatnonzero(total)
            yield from _pieces([np.ones(len(seen), np.int32), np.zeros(len(seen), np.int64), key[seen].view(np.int64), total[seen].astype(np.int32)], names)
            for level, (gram, history, lower) in enumerate(keys(key[token], sizes, order), 2):
                _, at, n = np.unique(gram, return_index=True, return_counts=True)
                yield from _pieces([np.full(len(at), level, np.int32), history[at].view(np.int64), lower[at].view(np.int64), n.astype(np.int32)], names)
            words.__init__()

        for batch in batches:
            held.append(words.tokens(batch.column(0).to_pylist()))
            if sum(len(x[0]) for x in held) >= BUFFER:
                yield from out()
        yield from out()

    return run


def discounts(counts: dict[int, int]) -> list[float]:
    """Good-Turing factors for the counts 0..K; r / (r + 1) where the counts of counts give none."""
    n = [counts.get(r, 0) for r in range(K + 2)]
    out = [0.0] * (K + 1)
    rest = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else r / (r + 1)
    return out


def _discounted(c: Column, d: list[float]) -> Column:
    factor = F.lit(1.0)
    for r in range(1, K + 1):
        factor = F.when(c == r, d[r]).otherwise(factor)
    return factor * c


def words_scale(n: int, counts: list[int], d: list[float]) -> tuple[float, float]:
    """What the words' discounted shares of n tokens are scaled by, and the probability of an unknown word; counts: of counts.

    Words keep what their discounts leave, and at least one token's worth goes to unknown ones.
    """
    left = n - sum(r * of * (1 - d[r]) for r, of in enumerate(counts, 1))
    scale = min(1.0, n / (left * (1 + 1 / n))) if n else 1.0
    return scale, 1 - scale * left / n if n else 1.0


def most_frequent(rows: DataFrame, limit: int, columns: tuple[str, ...] = ()):  # noqa: ANN201
    """The rows (key, c) with the greatest counts, at most ``limit``, the most frequent first: those from a count on, found
    from a histogram of counts.
    """
    step = F.floor(F.log2("c") * 16)
    least, total = None, 0
    for r in sorted(rows.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        total += r["count"]
        if total > limit:
            break
        least = r["s"]
    got = rows.where(step >= least if least is not None else F.lit(False)).select("key", "c", *columns).toPandas()
    return got.sort_values(["c", "key"], ascending=[False, True], ignore_index=True)


def _key(history: str, lower: str) -> Column:
    @F.pandas_udf("long")
    def key(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(mix(a.to_numpy().astype(np.int64).view(np.uint64), b.to_numpy().astype(np.int64).view(np.uint64)).view(np.int64))

    return key(history, lower)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Model:
    """N, V, p_unknown, the discounts by order, log alpha of what is before a text by order, and ``weights``: (key, c,
    known, base, model) of all words and n-grams. The tables that it is made from are deleted at the end.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", order: int = ORDER) -> None:
        spark = docs.sparkSession
        small_batches(spark)
        self.order = order
        text = docs.select(F.col(text_col).cast("binary").alias("b"))
        found = text.mapInArrow(_counter(order), "level int, h long, low long, n int")
        counts = written(found.groupBy("level", "h", "low").agg(F.sum("n").alias("c")), "counts", "level")
        del found
        release(spark)
        words = counts.where("level = 1").select(F.col("low").alias("key"), "c")
        of = words.agg(F.count("c").alias("v"), F.sum("c").alias("n"), *(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2))).first()
        self.N, self.V = of["n"] or 0, of["v"]
        self.discounts = {1: discounts({r: of[f"n{r}"] for r in range(1, K + 2)})}
        scale, self.p_unknown = words_scale(self.N, [of[f"n{r}"] for r in range(1, K + 1)], self.discounts[1])
        base = F.log10((F.col("c") + 1) / F.lit(float(self.N + self.V + 1)))
        p = F.lit(scale / max(1, self.N)) * _discounted(F.col("c"), self.discounts[1])
        levels, used = [words.select("key", "c", F.lit(1.0).alias("known"), base.alias("base"), p.alias("p"), F.log10(p).alias("model"))], [counts]
        self.before, alphas = [0.0] * (order + 1), []
        for level in range(2, order + 1):
            rows = counts.where(F.col("level") == level).select("h", "low", "c")
            of = rows.agg(*(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2))).first()
            self.discounts[level] = discounts({r: of[f"n{r}"] for r in range(1, K + 2)})
            below = levels[-1].select(F.col("key").alias("low"), F.col("p").alias("p_low"))
            # Written before each join, so that its hot partitions, of frequent words, can be split.
            known = written(rows.join(below, "low"), "known")
            mass, total = _discounted(F.col("c"), self.discounts[level]), F.col("total")
            sums = known.groupBy("h").agg(F.sum(mass).alias("mass"), F.sum("c").alias("total"), F.sum("p_low").alias("p_low"))
            most, share = 1 - 1 / (total + 1), F.col("mass") / total
            rated = sums.select("h", "total", F.least(F.lit(1.0), most / share).alias("scale"), share.alias("share"), "p_low")
            histories = written(rated.select("h", "total", "scale", ((1 - F.col("scale") * F.col("share")) / (1 - F.col("p_low"))).alias("alpha")), "histories")
            grams = known.join(histories, "h").select("h", "low", "c", (F.col("scale") * mass / total).alias("p"), "p_low", "alpha")
            grams = grams.select(_key("h", "low").alias("key"), "c", F.lit(0.0).alias("known"), F.lit(0.0).alias("base"), "p", (F.log10("p") - F.log10("alpha") - F.log10("p_low")).alias("model"))
            levels.append(written(grams, "grams"))
            alphas.append(histories.select(F.col("h").alias("key"), F.log10("alpha").alias("alpha")))
            used += [known, histories, levels[-1]]
            start = histories.where(F.col("h") == _signed(starts(order)[level - 1])).first()
            self.before[level] = math.log10(start["alpha"]) if start else 0.0
            release(spark)
        out = None
        for k, rows in enumerate(levels):
            rows = rows.drop("p")
            if k < len(alphas):
                rows = rows.join(alphas[k], "key", "left").withColumn("model", F.col("model") + F.coalesce("alpha", F.lit(0.0))).drop("alpha")
            out = rows if out is None else out.unionByName(rows)
        self.weights = written(out, "weights")
        drop(*used)
        release(spark)


def _reader(shared, order: int) -> Callable:
    """Rows (doc_id, text): (doc_id, key, value) for the keys that aren't frequent, and the sums of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (word, known_base, word_model), (gram, gram_model), start = shared.value

        def look(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(table):
                return np.zeros(0, dtype=np.int64), np.zeros(len(wanted), dtype=bool)
            at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
            hit = table[at] == wanted
            return at[hit], hit

        done = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                size, hi = 0, lo
                while hi < len(texts) and size < TOGETHER:
                    size += len(texts[hi] or b"")
                    hi += 1
                words, m = Numbered(), hi - lo
                token, sizes = words.tokens(texts[lo:hi])
                text = np.repeat(np.arange(m), sizes)
                hashes = words.hashes()
                at, hit = look(word, hashes)
                weight = np.zeros((2, len(hashes)))
                weight[0, hit], weight[1, hit] = known_base[at], word_model[at]
                frequent = hit[token]
                model = np.bincount(text, weight[1][token], m) + start
                rows, asked = [text[~frequent]], [hashes[token[~frequent]]]
                for key, _, _ in keys(hashes[token], sizes, order):
                    at, found = look(gram, key)
                    model += np.bincount(text[found], gram_model[at], m)
                    rows.append(text[~found])
                    asked.append(key[~found])
                sums = [sizes.astype(float), np.bincount(text, frequent, m), np.bincount(text, weight[0][token], m), model]
                salt = (np.arange(m) + done) % SALTS
                done += m
                n = sum(map(len, asked))
                rows = np.concatenate([*rows, *([np.arange(m)] * len(SUMS))]) + lo
                asked = np.concatenate([*(x.view(np.int64) for x in asked), *(1 + k * SALTS + salt for k in range(len(SUMS)))])
                values = np.ones(len(asked))
                values[n:] = np.concatenate(sums)
                for i in range(0, len(asked), ROWS):
                    part = slice(i, i + ROWS)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[part])), pa.array(asked[part]), pa.array(values[part])], names=["doc_id", "key", "value"])
                lo = hi

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    weights = model.weights

    def frequent(which: Column, limit: int, columns: list[str]) -> list[np.ndarray]:
        """Weights of the most frequent keys, at most ``limit``, in the keys' order."""
        got = most_frequent(weights.where(which), limit, tuple(columns))
        key = got["key"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(key)
        return [key[order], *(got[c].to_numpy(dtype=float)[order] for c in columns)]

    shared = spark.sparkContext.broadcast((frequent(F.col("known") == 1, FREQUENT_WORDS, ["base", "model"]), frequent(F.col("known") == 0, FREQUENT_GRAMS, ["model"]), sum(model.before)))
    of = f"doc_id {id_type(docs, id_col)}, key long, value double"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("b")).mapInArrow(_reader(shared, model.order), of)
    own = spark.range(1, 1 + len(SUMS) * SALTS).select(F.col("id").alias("key"), *(F.when(F.floor((F.col("id") - 1) / SALTS) == k, 1.0).otherwise(0.0).alias(c) for k, c in enumerate(SUMS)))
    table = weights.select("key", F.lit(0.0).alias("tokens"), "known", "base", "model").unionByName(own)
    sums = rows.join(table, "key").groupBy("doc_id").agg(*(F.sum(F.col("value") * F.col(c)).alias(c) for c in SUMS))
    unknown = F.col("tokens") - F.col("known")
    return sums.select(
        "doc_id",
        F.round("tokens").cast("long").alias("n_tokens"),
        F.round("known").cast("long").alias("n_known"),
        (F.col("base") - unknown * math.log10(model.N + model.V + 1)).alias("base_score"),
        (F.col("model") + unknown * math.log10(model.p_unknown)).alias("score"),
    )


def scored(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod folds isn't held."""
    from loomspark.llm import katz_parts

    return katz_parts.scored(docs, folds, held, id_col, text_col, order)
