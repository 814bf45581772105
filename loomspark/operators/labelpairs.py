"""Pairs of labels that share tokens, compared in blocks and summed where they meet: entity aliases as assist entries.

What an entry says of a pair, but for its ids, follows from the two labels. So members with one label are one row, rows meet
in a block's index of tokens (numpy on Arrow batches), and only sums or the best few of each left label leave a task.
Frequent tokens and stop words are bits; two rows meet at a token that isn't, or that both sets are found by (prefix filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as T
from loomspark.operators import review
from loomspark.operators.setjoin import BROADCAST, GROUP, blocks, partitions
from loomspark.plans.shared import numbered, written

#: Rows that are sent to all tasks at a time; meetings and pairs of members that are looked at together.
BLOCK, MEETINGS = 65_536, 2_000_000
#: Entries of a left label that are kept where the best few are asked for.
BEST = 3
#: Bits of a mark: one for each stop word, the others for the most common tokens.
BITS, STOPS = 64, len(T.SEARCH_STOP_WORDS)
COUNTS = [r.replace("-", "_") for r in review.RELATIONS] + ["zero_overlap", "high_score", "low_specificity"]
#: Relations in the order of their names, as numbers.
PLACES = np.array([sorted(review.RELATIONS).index(r) for r in review.RELATIONS])


class Labels:
    """The labels that have tokens as rows, each with at most GROUP of its members (place in the order of ids, part)."""

    def __init__(self, records: DataFrame) -> None:
        own = ["member_id", "corpus_id", "label", F.coalesce(F.col("entity_type") == "concept", F.lit(True)).alias("concept")]
        self.members = members = written(numbered(records.where("corpus_id is not null").select(*own), ["member_id"], "place"), "members")
        group = F.floor((F.row_number().over(Window.partitionBy("label", "concept").orderBy("place")) - 1) / GROUP)
        rows = members.withColumn("g", group).groupBy("label", "concept", "g").agg(F.collect_list(F.struct("place", F.xxhash64("corpus_id").alias("part"))).alias("m"))
        rows = rows.withColumns({"tokens": T.token_set(F.col("label")), "plain": review.label("label"), "anchor": review.label(T.slugify("label", 72))}).where(F.size("tokens") > 0)
        dashed = F.col("label").rlike("[-_]")
        words = F.when(dashed, T.token_set(F.col("plain"))).otherwise(F.expr("cast(array() as array<string>)"))
        rows = rows.withColumns({"vague": F.size(review.label_signals(F.trim("label"))) > 0, "dashed": dashed, "words": words})
        rows = numbered(rows, ["label", "concept", "g"], "no")
        # The place of a label is that of its first row.
        self.rows = written(rows.withColumn("by", F.min("no").over(Window.partitionBy("label"))), "labels")

    def odd(self) -> bool:
        """Whether entries don't follow from the labels' own words: a title's parting mark in a label, a subject without
        words; or members or collections that can't be told apart.
        """
        marked = F.contains(F.concat("label", F.lit(" ")), F.lit(" <> ")) | (F.col("anchor") == "")
        parts = self.members.select("corpus_id").distinct().groupBy(F.xxhash64("corpus_id").alias("h"))
        return any(not x.isEmpty() for x in (self.rows.where(marked), self.members.groupBy("member_id").count().where("count > 1"), parts.count().where("count > 1")))

    def coded(self) -> DataFrame:
        """(no, by, plain, vague, concept, dashed, places, parts, items, bits, w): tokens, and a dashed label's plain words, as
        numbers from the rarest to the most common, odd for stop words; bits: the places of the tokens' marks, or -1.
        """
        words = self.rows.select("no", F.explode("tokens").alias("t"), F.lit(True).alias("own")).unionByName(self.rows.select("no", F.explode("words").alias("t"), F.lit(False).alias("own")))
        common = words.groupBy("t").agg(F.count_if("own").alias("f"))
        stop = F.array_position(T.words_list(T.SEARCH_STOP_WORDS), F.col("t")).cast("int")
        rank = written(numbered(common.withColumn("stop", stop), ["f", "t"]), "ranks")
        often = rank.where("stop = 0").orderBy(F.desc("i")).limit(BITS - STOPS).select("t", (F.row_number().over(Window.orderBy(F.desc("i"))) + (STOPS - 1)).alias("often"))
        bit = F.when(F.col("stop") > 0, F.col("stop") - 1).otherwise(F.coalesce("often", F.lit(-1)))
        rank = rank.join(F.broadcast(often), "t", "left").select("t", (2 * F.col("i") + (F.col("stop") > 0).cast("int")).alias("i"), bit.alias("bit"))
        if rank.count() <= BROADCAST:
            rank = F.broadcast(rank)
        found = words.join(rank, "t").groupBy("no").agg(F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("i", "bit")))).alias("x"), F.collect_list(F.when(~F.col("own"), F.col("i"))).alias("w"))
        rows = self.rows.select("no", "by", "plain", "vague", "concept", "dashed", F.col("m.place").alias("places"), F.col("m.part").alias("parts")).join(found, "no")
        rows = rows.withColumns({"items": F.col("x.i"), "bits": F.col("x.bit")}).drop("x")
        return written(rows.repartition(partitions(rows)), "coded")


class _Rows:
    """Columns of a table of coded rows as arrays."""

    def __init__(self, rows: pa.Table, least: float) -> None:
        def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
            x = rows.column(name).combine_chunks()
            return np.r_[0, np.cumsum(x.value_lengths().to_numpy())].astype(np.int64), x.flatten().to_numpy(zero_copy_only=False)

        self.no, self.by = rows.column("no").to_numpy(), rows.column("by").to_numpy()
        self.vague, self.concept, self.dashed = (rows.column(c).to_numpy().astype(bool) for c in ("vague", "concept", "dashed"))
        self.plain = rows.column("plain")
        ends, items = flat("items")
        bits = flat("bits")[1].astype(np.int64)
        self.words_at, self.words = flat("w")
        self.members_at, self.places = flat("places")
        self.parts = flat("parts")[1]
        self.m = np.diff(self.members_at)
        self.n = np.diff(ends)
        row = np.repeat(np.arange(len(self.n)), self.n)
        marked = bits >= 0
        self.mark = np.zeros(len(self.n), dtype=np.uint64)
        np.bitwise_or.at(self.mark, row[marked], np.uint64(1) << bits[marked].astype(np.uint64))
        head = np.arange(len(items)) - ends[row] < (self.n - np.ceil(self.n * least - 1e-9) + 1)[row]
        use = head | ~marked
        self.row, self.item, self.top = row[use], items[use], marked[use]
        self.items_at, self.items = ends, items
        # Different words of the plain label, stop words among them.
        self.pn = np.where(self.dashed, np.diff(self.words_at), self.n)
        self.stop_mark = self.mark & np.uint64((1 << STOPS) - 1)

    def strings(self, at: np.ndarray) -> list[str]:
        return self.plain.take(pa.array(at)).to_pylist()

    def plain_words(self, at: np.ndarray, most: int) -> np.ndarray:
        """Numbers of the plain labels' words, -1 where there are no more."""
        out = np.full((len(at), most), -1, dtype=np.int64)
        for d, starts, values in ((True, self.words_at, self.words), (False, self.items_at, self.items)):
            which = np.nonzero(self.dashed[at] == d)[0]
            size = np.diff(starts)[at[which]]
            r, k = _runs(size)
            out[which[r], k] = values[starts[at[which]][r] + k]
        return out


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes: the run, and the place in it."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of runs that together have at most ``most`` elements, or one run."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        yield slice(start, end)
        start = end


class _Index:
    """The rows of a block by their tokens."""

    def __init__(self, rows: pa.Table, least: float) -> None:
        self.x = x = _Rows(rows, least)
        order = np.argsort(x.item, kind="stable")
        self.row, self.top = x.row[order], x.top[order]
        self.item, at, self.size = np.unique(x.item[order], return_index=True, return_counts=True)
        self.at = at

    def pairs(self, y: _Rows, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, in common, score in units of 1e-4) of the block's rows a and others b with a's number not above b's."""
        x = self.x
        place = np.minimum(np.searchsorted(self.item, y.item), len(self.item) - 1)
        known = self.item[place] == y.item
        row, place, top = y.row[known], place[known], y.top[known]
        size = self.size[place]
        # Whole rows of y at a time, so that all meetings of a pair are seen together.
        for part in _slices(np.bincount(row, weights=size, minlength=len(y.n)).astype(np.int64), MEETINGS):
            lo, hi = np.searchsorted(row, [part.start, part.stop])
            r, k = _runs(size[lo:hi])
            a = self.row[self.at[place[lo:hi]][r] + k]
            key = np.sort((((row[lo:hi][r] - part.start) * len(x.n) + a) << 1) | top[lo:hi][r])
            if not len(key):
                continue
            pair = key >> 1
            first = np.nonzero(np.r_[True, pair[1:] != pair[:-1]])[0]
            rare = np.add.reduceat((key & 1) ^ 1, first)
            b, a = np.divmod(pair[first], len(x.n))
            b += part.start
            both = rare + np.bitwise_count(x.mark[a] & y.mark[b])
            either = x.n[a] + y.n[b] - both
            score = (both * 20000 + either) // (2 * either)
            fits = (score / 10000.0 >= threshold) & (x.no[a] <= y.no[b]) & ~((both == 1) & (either == 1) & x.concept[a] & y.concept[b])
            yield a[fits], b[fits], both[fits], score[fits]


def _relations(x: _Rows, y: _Rows, a: np.ndarray, b: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Relation of each pair of rows, as its place in RELATIONS, and the number of content words that both labels share."""
    stops = np.bitwise_count(x.stop_mark[a] & y.stop_mark[b]).astype(np.int64)
    shared = both - stops
    la, lb = x.n[a] - np.bitwise_count(x.stop_mark[a]), y.n[b] - np.bitwise_count(y.stop_mark[b])
    words, plain = shared.copy(), both.copy()
    apart = np.nonzero(x.dashed[a] | y.dashed[b])[0]
    longest = np.ceil(np.log2(np.maximum(1, np.maximum(x.pn[a[apart]], y.pn[b[apart]])))).astype(np.int64)
    for size in np.unique(longest):
        of, step = apart[longest == size], max(1, MEETINGS >> (2 * int(size)))
        for k in range(0, len(of), step):
            at = of[k : k + step]
            u, v = x.plain_words(a[at], 1 << size), y.plain_words(b[at], 1 << size)
            met = (u[:, :, None] == v[:, None, :]) & (u >= 0)[:, :, None]
            plain[at] = met.sum(axis=(1, 2))
            words[at] = (met & (u % 2 == 0)[:, :, None]).sum(axis=(1, 2))
            la[at], lb[at] = (((z >= 0) & (z % 2 == 0)).sum(axis=1) for z in (u, v))
    either = la + lb - words
    alike = (words >= 2) & (((words * 20000 + either) // np.maximum(2 * either, 1) >= 5000) | (words == np.minimum(la, lb)))
    out = np.where(alike, 2, np.where(words >= 1, 3, 4))
    # Of a label inside another all words but its first and last are words of the other.
    near = np.nonzero(plain >= np.minimum(x.pn[a], y.pn[b]) - 2)[0]
    for k in range(0, len(near), MEETINGS):
        at = near[k : k + MEETINGS]
        for i, p, q in zip(at, x.strings(a[at]), y.strings(b[at]), strict=True):
            if p == "" or q == "":
                out[i] = 5
            elif p == q:
                out[i] = 0
            elif p in q or q in p:
                out[i] = 1
    return out, shared


def _directed(x: _Rows, y: _Rows, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many pairs of members of different parts have the left one in a, and how many in b."""
    out = np.zeros((2, len(a)), dtype=np.int64)
    for part in _slices(x.m[a] * y.m[b], MEETINGS):
        p, q = a[part], b[part]
        r, k = _runs(x.m[p] * y.m[q])
        of = y.m[q][r]
        i, j = x.members_at[p][r] + k // of, y.members_at[q][r] + k % of
        apart, less = x.parts[i] != y.parts[j], x.places[i] < y.places[j]
        for side, which in enumerate((apart & less, apart & ~less)):
            out[side, part] = np.bincount(r[which], minlength=len(p))
    out[1, x.no[a] == y.no[b]] = 0
    return out[0], out[1]


def _entries(index: _Index, y: _Rows, threshold: float, kinds: list[int] | None) -> Iterator[tuple]:
    """(a, b, score, relation, shared, n of pairs with the left member in a, n of those with it in b), as arrays."""
    x = index.x
    for a, b, both, score in index.pairs(y, threshold):
        n, m = _directed(x, y, a, b)
        any_ = n + m > 0
        a, b, both, score, n, m = (z[any_] for z in (a, b, both, score, n, m))
        kind, shared = _relations(x, y, a, b, both)
        if kinds:
            of = np.isin(kind, kinds)
            a, b, score, kind, shared, n, m = (z[of] for z in (a, b, score, kind, shared, n, m))
        yield a, b, score, kind, shared, n, m


class _Sums:
    """Sums of entries by their left rows."""

    def __init__(self, rows: int) -> None:
        self.rows, self.n, self.best = rows, np.zeros((len(COUNTS), rows), dtype=np.int64), np.zeros(rows, dtype=np.int64)

    def add(self, left: np.ndarray, n: np.ndarray, score: np.ndarray, kind: np.ndarray, shared: np.ndarray, vague: np.ndarray) -> None:
        kinds = len(review.RELATIONS)
        self.n[:kinds] += np.bincount(kind * self.rows + left, weights=n, minlength=kinds * self.rows).astype(np.int64).reshape(kinds, self.rows)
        for k, of in enumerate((shared == 0, score >= 9000, vague)):
            self.n[kinds + k] += np.bincount(left[of], weights=n[of], minlength=self.rows).astype(np.int64)
        np.maximum.at(self.best, left[n > 0], score[n > 0])

    def batch(self, no: np.ndarray) -> pa.RecordBatch:
        has = self.n.sum(axis=0) > 0
        return pa.RecordBatch.from_arrays([pa.array(z[has]) for z in (no, self.best, *self.n)], names=["no", "best", *COUNTS])


def _summed(held: Broadcast, threshold: float, least: float, kinds: list[int] | None):  # noqa: ANN202
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            if index is None:
                index = _Index(held.value, least)
                own = _Sums(len(index.x.no))
            y = _Rows(pa.Table.from_batches([batch]), least)
            other = _Sums(len(y.no))
            for a, b, score, kind, shared, n, m in _entries(index, y, threshold, kinds):
                vague = index.x.vague[a] | y.vague[b]
                own.add(a, n, score, kind, shared, vague)
                other.add(b, m, score, kind, shared, vague)
            yield other.batch(y.no)
        if index is not None:
            yield own.batch(index.x.no)

    return summed


def _top(left: np.ndarray, score: np.ndarray, kind: np.ndarray, by: np.ndarray, right: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Of entries those of each left row that fewer than BEST pairs of members come before; ties stay together."""
    order = np.lexsort((by, kind, -score, left))
    rows = left, score, kind, by, right, n = [z[order] for z in (left, score, kind, by, right, n)]
    if not len(left):
        return rows
    new = np.r_[True, left[1:] != left[:-1]]
    tie = new | np.r_[True, (score[1:] != score[:-1]) | (kind[1:] != kind[:-1]) | (by[1:] != by[:-1])]
    before = np.cumsum(n) - n
    at = np.arange(len(left))
    first = before[np.maximum.accumulate(np.where(tie, at, 0))] - before[np.maximum.accumulate(np.where(new, at, 0))]
    return [z[first < BEST] for z in rows]


def _picked(held: Broadcast, threshold: float, least: float):  # noqa: ANN202
    def batch(no: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(z) for z in (no[rows[0]], *rows[1:])], names=["left", "score", "kind", "by", "right", "n"])

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for one in batches:
            if index is None:
                index = _Index(held.value, least)
                x, kept = index.x, [np.zeros(0, dtype=np.int64)] * 6
                # The score of the last of BEST pairs, below which nothing counts.
                floor = np.zeros(len(x.no), dtype=np.int64)
            y = _Rows(pa.Table.from_batches([one]), least)
            for a, b, score, kind, _, n, m in _entries(index, y, threshold, None):
                kind = PLACES[kind]
                of = m > 0
                yield batch(y.no, _top(b[of], score[of], kind[of], x.by[a[of]], x.no[a[of]], m[of]))
                of = (n > 0) & (score >= floor[a])
                new = (a[of], score[of], kind[of], y.by[b[of]], y.no[b[of]], n[of])
                kept = _top(*(np.concatenate(z) for z in zip(kept, new, strict=True)))
                full = np.bincount(kept[0], weights=kept[5], minlength=len(floor)) >= BEST
                last = np.full(len(floor), np.iinfo(np.int64).max)
                np.minimum.at(last, kept[0], kept[1])
                floor = np.where(full, last, 0)
        if index is not None:
            yield batch(x.no, kept)

    return picked


def _over_blocks(labels: Labels, threshold: float, task, schema: str) -> DataFrame:  # noqa: ANN001
    """What the tasks give of each block of rows and the rows from its first on."""
    coded, least = labels.coded(), max(threshold - 1e-4, 0.01)
    out = None
    for held, rest in blocks(coded, BLOCK):
        part = written(rest.mapInArrow(task(held, threshold, least), schema), "met")
        out = part if out is None else out.unionByName(part)
    return coded.sparkSession.createDataFrame([], schema) if out is None else out


def _old(records: DataFrame, threshold: float, relations: list[str] | None) -> DataFrame:
    from loomspark.operators import canon

    return review.entries(canon.suggestions(records, "entity-alias", threshold=threshold), relations)


def anchors(records: DataFrame, threshold: float, relations: list[str] | None = None) -> DataFrame:
    """review.anchors of the entries of entity aliases among records, without the entries."""
    labels = Labels(records)
    if labels.odd():
        return review.anchors(_old(records, threshold, relations))
    kinds = [review.RELATIONS.index(r) for r in relations] if relations else None
    schema = ", ".join(f"{c} long" for c in ("no", "best", *COUNTS))
    sums = _over_blocks(labels, threshold, lambda held, t, least: _summed(held, t, least, kinds), schema)
    each = [F.max("best").alias("best"), *(F.sum(c).alias(c) for c in COUNTS)]
    found = sums.groupBy("no").agg(*each).join(labels.rows.select("no", "anchor"), "no").groupBy("anchor").agg(*each)
    kinds_of = COUNTS[: len(review.RELATIONS)]
    total = sum((F.col(c) for c in kinds_of[1:]), F.col(kinds_of[0]))
    exactish = F.col("exact_match") + F.col("substring") + F.col("high_overlap")
    rows = found.select("anchor", total.alias("item_count"), (F.col("best") / 10000.0).alias("best_score"), *kinds_of, exactish.alias("exactish"), "zero_overlap", "high_score", "low_specificity")
    return written(rows, "anchors")


def examples(records: DataFrame, threshold: float) -> DataFrame:
    """(anchor, place, review_id, score, relation): review.examples of the entries of entity aliases among records."""
    labels = Labels(records)
    if labels.odd():
        return review.examples(_old(records, threshold, None), BEST).drop("hint")
    found = _over_blocks(labels, threshold, _picked, "left long, score long, kind long, by long, right long, n long")
    upto = Window.partitionBy("left").orderBy(F.desc("score"), "kind", "by")
    before = F.sum("n").over(upto) - F.sum("n").over(Window.partitionBy("left", "score", "kind", "by"))
    best = found.withColumn("before", before).where(F.col("before") < BEST).select("left", "right", "score", "kind")
    sides = [labels.rows.select(F.col("no").alias(s), F.col("label").alias(f"{s}_label"), F.col("m").alias(f"{s}_m"), *(["anchor"] if s == "left" else [])) for s in ("left", "right")]
    pairs = best.join(sides[0], "left").join(sides[1], "right").withColumn("l", F.explode("left_m")).withColumn("r", F.explode("right_m")).where("l.part <> r.part and l.place < r.place")
    ids = [labels.members.select(F.col("place").alias(f"{s}_place"), F.col("member_id").alias(f"{s}_id")) for s in ("left", "right")]
    pairs = pairs.select("anchor", "score", "kind", F.concat_ws(" <> ", "left_label", "right_label").alias("title"), F.col("l.place").alias("left_place"), F.col("r.place").alias("right_place")).join(ids[0], "left_place").join(ids[1], "right_place")
    relation = F.get(F.array(*(F.lit(r) for r in sorted(review.RELATIONS))), F.col("kind").cast("int"))
    rows = pairs.select("anchor", T.review_id("entity-alias", F.array("left_id", "right_id")).alias("review_id"), (F.col("score") / 10000.0).alias("score"), relation.alias("relation"), "title")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "relation", "title", "review_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= BEST).select("anchor", "place", "review_id", "score", "relation")
