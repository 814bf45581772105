"""Scores of a table by a Katz model of its own training rows, without a table of the model (see katz).

A token is an event: its word and the words before it. All n-grams that end in a word z after a word y, of every order, and
all histories that end in y hold the same y; so if events are dealt out by y, each part counts its n-grams, forms its
histories' alphas and scores its own events, and only sums by document leave it. Events of a word y that fills more than a
part are dealt out by the word before y too (at order 2 by z): what is longer than (y, z) is still whole in its part, and
the counts of (y, z) are added up over the parts and given back to them.

Events travel packed: for each chunk of texts and part one compressed row, with words as ranks among the FREQUENT_WORDS
most frequent ones or as places in the row's list of hashes. Parts are written once, sorted by history and with their counts
of counts; when the discounts are known they are read again and scored. Both go through a part in slices of whole words y, so
that what a task holds for each event is little more than the event. Counts of rare words, which no task holds, come by joins: for the sums
of p(z) over what follows y, and for the tokens that are rare.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import katz
from loomspark.llm._common import crc_mod, drop, id_type, release, small_batches, trim, written

#: Events of a part, on average; a word with more is dealt out over several parts. The least number of parts.
PART = 1_500_000
PARTS = 12
#: Events of a part that are counted or scored at a time, if no word has more.
SLICE = 250_000
#: Kinds of rows of a part before its counts of counts, whose kind is their level: packed events, pairs of a word that is
#: dealt out, pairs with a rare word.
EVENTS, SPLIT, RARE = -1, 0, 1


def _landed(df: DataFrame, name: str) -> DataFrame:
    """``written``, after which the files of its shuffles are deleted at once; else they stay until the JVM collects."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def _pack(value: object) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> object:
    return pickle.loads(pa.Codec("zstd").decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True))  # noqa: S301


def _planes(x: np.ndarray) -> list[bytes]:
    """Bytes of 32-bit numbers, plane by plane, without those that are all zero."""
    x = x.astype(np.int32, copy=False)
    low, top = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return [(x >> np.int32(8 * k)).astype(np.uint8).tobytes() if low < 0 or top >> 8 * k else b"" for k in range(4)]


def _places(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of x, all below n, in order, and the place of each of the n among them."""
    used = np.zeros(n, dtype=bool)
    used[x] = True
    return np.flatnonzero(used), np.cumsum(used, dtype=np.int32) - np.int32(1)


def _whole(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), dtype=np.uint8)
    for k, p in enumerate(planes):
        if p:
            out[:, k] = np.frombuffer(p, dtype=np.uint8)
    return out.reshape(-1).view("<i4")


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:0].dtype.type(0))


class Words:
    """The frequent words: hashes in order, the rank of each, and by rank what their counts give."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, base: np.ndarray, p: np.ndarray) -> None:
        self.by_rank = hashes
        self.base, self.p = base, p
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.n = len(hashes)

    def codes(self, hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Rank of a frequent word, else n + its place in rare, which is in order; -1 of what is in neither."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for table, value in ((rare, lambda at: at + self.n), (self.sorted, lambda at: self.order[at])):
            if len(table) and len(hashes):
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                hit = table[at] == hashes
                out[hit] = value(at[hit])
        return out

    def parted(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of hashes, and those that aren't frequent words', in order."""
        by, out = np.argsort(hashes), np.empty(len(hashes), dtype=np.int64)
        h = hashes[by]
        at = np.searchsorted(self.sorted, h)
        hit = self.sorted[np.minimum(at, self.n - 1)] == h if self.n else np.zeros(len(h), dtype=bool)
        rare = np.unique(h[~hit])
        out[by[hit]] = self.order[at[hit]]
        out[by[~hit]] = self.n + np.searchsorted(rare, h[~hit])
        return out, rare

    def hashes(self, codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        return np.concatenate([self.by_rank, rare])[codes]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text): (key, n), how often words are in some texts."""
    words, total, held = katz.Numbered(), np.zeros(0, dtype=np.int64), 0

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            yield from katz._pieces([words.hashes().view(np.int64), total], ["key", "n"])

    for batch in batches:
        token, _ = words.tokens(batch.column(0).to_pylist())
        more = np.bincount(token, minlength=len(words.number))
        more[: len(total)] += total
        total, held = more, held + len(token)
        if held >= katz.BUFFER:
            yield from out()
            words, total, held = katz.Numbered(), np.zeros(0, dtype=np.int64), 0
    yield from out()
    trim()


def _dealer(shared, order: int, parts: int) -> Callable:
    """Rows (doc_id, train, text): (part, blob), the events of some texts that go to a part."""
    depth = max(1, order - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = shared.value
        words, held, ids, train = katz.Numbered(), [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            token, sizes = np.concatenate([t for t, _ in held]), np.concatenate([n for _, n in held])
            doc_ids, trained = pa.concat_arrays(ids), np.concatenate(train)
            hashes = np.append(words.hashes(), np.uint64(katz.START))
            for x in (held, ids, train):
                x.clear()
            words.__init__()
            code, rare = known.parted(hashes)
            code = code.astype(np.int32)
            first = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            before, last = [], token
            for _ in range(depth):
                here = np.empty_like(last)
                here[1:] = last[:-1]
                here[first] = len(hashes) - 1
                before.append(here)
                last = here
            home = (katz.mix(hashes, hashes) % np.uint64(parts)).astype(np.int32)
            part = home[before[0]]
            if len(split[0]):
                at = np.minimum(np.searchsorted(split[0], hashes), len(split[0]) - 1)
                over = np.where(split[0][at] == hashes, split[1][at], 1).astype(np.uint64)
                spread = katz.mix(hashes, np.full_like(hashes, 7))
                by = before[1] if order > 2 else token
                many = np.flatnonzero(over[before[0]] > 1)
                part[many] = (part[many] + (spread[by[many]] % over[before[0][many]]).astype(np.int64)) % parts
            # In place and in 32 bits where they do, as a worker holds this beside the other's and the JVM's.
            key = code[before[0]].astype(np.int64)
            key <<= 24
            if depth > 1:
                key |= code[before[1]]
            key |= np.left_shift(part, 48, dtype=np.int64)
            by_part = np.argsort(key).astype(np.int32)
            del key
            part = part[by_part]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = by_part[lo:hi]
                columns = [code[b[at]] for b in [*before, token]]
                used, place = _places(np.concatenate([c[c >= known.n] for c in columns]) - known.n, len(rare))
                columns = [np.where(c >= known.n, place[np.maximum(c - known.n, 0)] + np.int32(known.n), c) if len(rare) else c for c in columns]
                mine = doc[at]
                docs, of = _places(mine, len(sizes))
                of = of[mine]
                batch = pa.RecordBatch.from_arrays([doc_ids.take(pa.array(docs))], names=["doc_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch)
                columns[:2] = [_steps(c) for c in columns[:2]] if depth > 1 else [_steps(columns[0]), columns[1]]
                blob = _pack((hi - lo, sink.getvalue().to_pybytes(), np.packbits(trained[docs]).tobytes(), rare[used].tobytes(), [_planes(c) for c in columns], _planes(of)))
                yield pa.RecordBatch.from_arrays([pa.array([int(part[lo])], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

        for batch in batches:
            token, sizes = words.tokens(batch.column("b").to_pylist())
            held.append((token.astype(np.int32), sizes))
            ids.append(batch.column("doc_id"))
            train.append(batch.column("train").to_numpy(zero_copy_only=False).astype(bool))
            if sum(len(x[0]) for x in held) >= katz.BUFFER:
                yield from out()
        yield from out()
        trim()

    return run


def _events(blobs: list[bytes], known: Words, order: int) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(ids, training or not by id, rare words' hashes, columns of words with the last one at the end, place of the id)."""
    ids, trained, lists, parts = [], [], [], []
    for blob in blobs:
        n, raw, bits, rare, columns, of = _unpack(blob)
        ids.append(pa.ipc.open_stream(raw).read_all().column(0).combine_chunks())
        trained.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(ids[-1])).astype(bool))
        lists.append(np.frombuffer(rare, dtype=np.uint64))
        columns = [_whole(c, n) for c in columns]
        columns[0] = np.cumsum(columns[0], dtype=np.int32)
        if len(columns) > 2:
            columns[1] = np.cumsum(columns[1], dtype=np.int32)
        parts.append((columns, _whole(of, n)))
    if len(parts) == 1:
        return ids[0], trained[0], lists[0], *parts[0]
    rare = np.unique(np.concatenate(lists))
    at = 0
    for k, (columns, of) in enumerate(parts):
        place = (np.searchsorted(rare, lists[k]) + known.n).astype(np.int32)
        if len(place):
            columns[:] = [np.where(c >= known.n, place[np.maximum(c - known.n, 0)], c) for c in columns]
        of += at
        at += len(ids[k])
    whole = [np.concatenate([p[0][k] for p in parts]) for k in range(len(parts[0][0]))]
    return pa.concat_arrays(ids), np.concatenate(trained), rare, whole, np.concatenate([p[1] for p in parts])


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct row of two columns of numbers below 2**31, and the distinct row of each row."""
    key = (columns[0].astype(np.int64) << 32) | columns[1]
    new = np.ones(len(key), dtype=bool)
    if (key[1:] >= key[:-1]).all():
        new[1:] = key[1:] != key[:-1]
        return np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - np.int32(1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new[1:] = key[1:] != key[:-1]
    of = np.empty(len(key), dtype=np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], of


def _sorted(columns: list[np.ndarray], of: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Events in the order of their words from the first on, then of documents; in whole numbers of 63 bits where these fit."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        by = np.lexsort([of, *reversed(columns)])
        return [c[by] for c in columns], of[by]
    key = np.zeros(len(of), dtype=np.int64)
    for c, b in zip(columns, bits, strict=True):
        key = (key << b) | c
    by = np.argsort(key)
    key = key[by]
    # Events of one key have the same words, so that their documents alone are still to be put in order.
    rank, size = np.cumsum(np.append(False, key[1:] != key[:-1])[: len(key)], dtype=np.int64), int(of.max(initial=0)).bit_length()
    of = (np.sort((rank << size) | of[by]) & ((1 << size) - 1)).astype(of.dtype)
    del key, rank
    return [c[by] for c in columns], of


def _slices(y: np.ndarray) -> Iterator[slice]:
    """Slices of events, in the order of y, with whole words y: of at most SLICE events, or of one word with more."""
    ends, lo = np.append(np.flatnonzero(y[1:] != y[:-1]) + 1, len(y)), 0
    while lo < len(y):
        hi = int(ends[max(np.searchsorted(ends, lo + SLICE, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
        yield slice(lo, hi)
        lo = hi


def _grams(columns: list[np.ndarray], order: int, train: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from 2 on: first event of each n-gram, the n-gram of each event, counts, first event and number of each history."""
    z = columns[-1]
    start, history = _same(columns[0], np.zeros_like(columns[0]))
    for level in range(2, order + 1):
        if level > 2:
            start, history = _same(history, columns[level - 2])
        first, gram = _same(history, z)
        yield first, gram, np.bincount(gram, train, len(first)).astype(np.int64), start, history


KIND = "part int, kind int, a long, b long, c long, blob binary"


def _counter(shared, order: int) -> Callable:
    """The blobs of a part: its events, packed again as one, and what its counts say (KIND)."""

    def run(table: pa.Table) -> pa.Table:
        known, split = shared.value
        part, blobs = table.column("part")[0].as_py(), table.column("blob").to_pylist()
        ids, trained, rare, columns, of = _events(blobs, known, order)
        names = pa.array(np.arange(0), pa.int64()) if not len(ids) else ids.dictionary_encode()
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        del blobs
        # Sorted by history; documents as places among the distinct ids.
        columns, of = _sorted(columns, of)
        hashes = np.concatenate([known.by_rank, rare])
        over = np.isin(hashes, split[0])
        found = np.zeros((order + 1, katz.K + 1), dtype=np.int64)
        for at in _slices(columns[0]):
            mine = [c[at] for c in columns]
            for level, (first, _, c, _, _) in enumerate(_grams(mine, order, trained[of[at]].astype(float)), 2):
                y, z = mine[0][first], mine[-1][first]
                own = ~over[y] if level == 2 else np.ones(len(first), dtype=bool)
                found[level] += np.bincount(np.minimum(c[own], katz.K + 2), minlength=katz.K + 3)[1 : katz.K + 2]
                if level == 2:
                    out.append((SPLIT, hashes[y[~own]].view(np.int64), hashes[z[~own]].view(np.int64), c[~own]))
                    seen = own & (c > 0) & (z >= known.n)
                    out.append((RARE, hashes[y[seen]].view(np.int64), hashes[z[seen]].view(np.int64), c[seen]))
        out += [(level, np.arange(1, katz.K + 2), found[level], np.zeros(katz.K + 1)) for level in range(2, order + 1)]
        place = names.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        if names.indices.null_count:
            place = np.where(names.indices.is_null().to_numpy(zero_copy_only=False), len(names.dictionary), np.nan_to_num(names.indices.to_numpy(zero_copy_only=False)).astype(np.int32)).astype(np.int32)
        distinct = pa.concat_arrays([names.dictionary, pa.nulls(1, names.dictionary.type)]) if names.indices.null_count else names.dictionary
        document = place[of]
        learned = np.zeros(len(distinct), dtype=bool)
        learned[place] = trained
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([distinct], names=["doc_id"])
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        columns[:2] = [_steps(c) for c in columns[:2]] if len(columns) > 2 else [_steps(columns[0]), columns[1]]
        blob = _pack((len(of), sink.getvalue().to_pybytes(), np.packbits(learned).tobytes(), rare.tobytes(), [_planes(c) for c in columns], _planes(document)))
        sizes = [len(o[1]) for o in out]
        n = sum(sizes)
        return pa.table(
            {
                "part": pa.array(np.full(n + 1, part), pa.int32()),
                "kind": pa.array(np.append(np.repeat([o[0] for o in out], sizes), EVENTS), pa.int32()),
                **{name: pa.array(np.append(np.concatenate([o[k] for o in out]) if out else np.zeros(0), 0).astype(np.int64)) for k, name in enumerate("abc", 1)},
                "blob": pa.array([None] * n + [blob], pa.binary()),
            }
        )

    def lean(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            trim()

    return lean


def _mass(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(c <= katz.K, np.array(d)[np.minimum(c, katz.K)], 1.0) * c


def _scorer(shared, order: int, found: list[list[float]], id_of: pa.DataType) -> Callable:
    """A part and what is said of it, rows (kind, a, b, v): (doc_id, key, tokens, known, base, model, asked).

    A key is a rare word, whose known, base and share of the model are still to be added: ``tokens`` is their number and
    ``asked`` that of the tokens whose model ends in the word alone.
    """

    def ended(columns: list[np.ndarray], train: np.ndarray, n: int, p_word: np.ndarray, more: np.ndarray, alpha_of: np.ndarray, said: np.ndarray, said_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's logarithm of each event, and whether it ends in the word alone and that is rare."""
        z = columns[-1]
        lower = p_word[z]
        with np.errstate(divide="ignore"):
            model = np.where(z < n, np.log10(lower), 0.0)
        asked = z >= n
        for level, (first, gram, c, start, history) in enumerate(_grams(columns, order, train), 2):
            h, seen = history[first], c > 0
            mass, total = _mass(c, found[level]), np.bincount(h, c, len(start))
            share = np.bincount(h, mass, len(start)) / np.maximum(total, 1)
            below = np.bincount(h[seen], lower[first[seen]], len(start))
            if level == 2:
                below = below + more[columns[0][start]]
            with np.errstate(divide="ignore", invalid="ignore"):
                scale = np.minimum(1.0, (1 - 1 / (total + 1)) / share)
                alpha = np.where(total > 0, (1 - scale * share) / (1 - below), 1.0)
                p = scale[h] * mass / total[h]
            if level == 2:
                given = alpha_of[columns[0][start]]
                over = ~np.isnan(given)
                alpha = np.where(over, given, alpha)
                split = over[h]
                if split.any():
                    wanted = (columns[0][first[split]].astype(np.int64) << 32) | z[first[split]]
                    at = np.minimum(np.searchsorted(said, wanted), max(0, len(said) - 1))
                    hit = said[at] == wanted if len(said) else np.zeros(len(wanted), dtype=bool)
                    got = np.zeros(len(wanted))
                    got[hit] = said_v[at[hit]]
                    p[split], seen[split] = got, hit
            with np.errstate(divide="ignore", invalid="ignore"):
                model = np.where(seen[gram], np.log10(np.where(seen, p, 1.0))[gram], np.log10(alpha)[history] + model)
            asked &= ~seen[gram]
            lower = np.where(seen, p, 0.0)[gram]
            del first, gram, c, start, history, h, seen, mass, total, share, below, scale, alpha, p
        return model, asked

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, _ = shared.value
        ids, trained, rare, columns, of = _events(left.column("blob").to_pylist(), known, order)
        z = columns[-1]
        kind, a, b, v = (right.column(c).to_numpy() for c in ("kind", "a", "b", "v"))
        a, b = known.codes(a.astype(np.int64).view(np.uint64), rare), known.codes(b.astype(np.int64).view(np.uint64), rare)
        size = known.n + len(rare)
        more, alpha_of = np.zeros(size), np.full(size, np.nan)
        for of_kind, into in ((RARE, more), (EVENTS, alpha_of)):
            here = (kind == of_kind) & (a >= 0)
            into[a[here]] = v[here]
        mine = np.flatnonzero(kind == SPLIT)
        said = (a[mine] << 32) | b[mine]
        by = np.argsort(said)
        said, said_v = said[by], v[mine[by]]
        del kind, a, b, v, mine, by
        p_word = np.concatenate([known.p, np.zeros(len(rare))])
        model, asked = np.zeros(len(z)), z >= known.n
        for at in _slices(columns[0]):
            model[at], asked[at] = ended([c[at] for c in columns], trained[of[at]].astype(float), known.n, p_word, more, alpha_of, said, said_v)
        m = len(ids)
        frequent = z < known.n
        tokens = np.bincount(of, frequent, m)
        base = np.bincount(of, np.concatenate([known.base, np.zeros(len(rare))])[z], m)
        rest = np.flatnonzero(~frequent)
        pairs, pair = _same(of[rest], z[rest])
        at = rest[pairs]
        n = len(pairs)
        none = np.zeros(n)
        return pa.table(
            {
                "doc_id": pa.concat_arrays([ids, ids.take(pa.array(of[at]))]),
                "key": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(np.concatenate([known.by_rank, rare])[z[at]].view(np.int64), pa.int64())]),
                "tokens": np.concatenate([tokens, np.bincount(pair, minlength=n)]).astype(np.int64),
                "known": np.concatenate([tokens, none]).astype(np.int64),
                "base": np.concatenate([base, none]),
                "model": np.concatenate([np.bincount(of, model, m), none]),
                "asked": np.concatenate([np.zeros(m), np.bincount(pair, asked[rest], n)]).astype(np.int64),
            }
        )

    fields = ("key", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("asked", pa.int64())
    nothing = pa.schema([("doc_id", id_of), *fields]).empty_table()

    def lean(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            # What is said of a word may reach a part that has none of its events.
            return run(left, right) if left.num_rows else nothing
        finally:
            trim()

    return lean


def scored(docs: DataFrame, folds: int, held: int, id_col: str, text_col: str, order: int) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod folds isn't held."""
    spark = docs.sparkSession
    small_batches(spark)
    learned = F.coalesce(crc_mod(id_col, folds) != held, F.lit(False))
    text = F.col(text_col).cast("binary").alias("b")
    counted = docs.where(learned).select(text).mapInArrow(_word_counts, "key long, n long")
    words = _landed(counted.groupBy("key").agg(F.sum("n").alias("c")), "words")
    release(spark)
    of = words.agg(F.count("c").alias("v"), F.sum("c").alias("n"), *(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, katz.K + 2))).first()
    N, V = of["n"] or 0, of["v"]
    found = [[], katz.discounts({r: of[f"n{r}"] for r in range(1, katz.K + 2)})]
    scale, p_unknown = katz.words_scale(N, [of[f"n{r}"] for r in range(1, katz.K + 1)], found[1])
    p_word = F.lit(scale / max(1, N)) * katz._discounted(F.col("c"), found[1])

    top = katz.most_frequent(words, katz.FREQUENT_WORDS)
    base = np.log10((top["c"].to_numpy(dtype=float) + 1) / (N + V + 1))
    known = Words(top["key"].to_numpy(dtype=np.int64).view(np.uint64), top["c"].to_numpy(), base, _mass(top["c"].to_numpy(dtype=np.int64), found[1]) * scale / max(1, N))
    big = [(r["key"] & (2**64 - 1), r["c"]) for r in words.where(F.col("c") > PART).collect()]
    n_docs = docs.count()
    big += [(katz.START, n_docs)] if n_docs > PART else []
    big.sort()
    split = np.array([k for k, _ in big], dtype=np.uint64), np.array([math.ceil(1.2 * c / PART) for _, c in big], dtype=np.int64)
    parts = max(PARTS, math.ceil(1.2 * N / PART))
    shared = spark.sparkContext.broadcast((known, split))

    rows = docs.select(F.col(id_col).alias("doc_id"), learned.alias("train"), text).mapInArrow(_dealer(shared, order, parts), "part int, blob binary")
    counts = _landed(rows.groupBy("part").applyInArrow(_counter(shared, order), KIND), "parts")
    del rows
    release(spark)

    n_of = {(r["kind"], r["a"]): r["n"] for r in counts.where("kind > 1").groupBy("kind", "a").agg(F.sum("b").alias("n")).collect()}
    pairs = None
    if len(big) and order > 1:
        summed = counts.where(F.col("kind") == SPLIT).groupBy("a", "b").agg(F.sum("c").alias("c"), F.collect_set("part").alias("parts")).where("c > 0")
        pairs = _landed(summed, "pairs")
        for r in range(1, katz.K + 2):
            n_of[2, r] = n_of.get((2, r), 0) + pairs.where(F.col("c") == r).count()
    found += [katz.discounts({r: n_of.get((level, r), 0) for r in range(1, katz.K + 2)}) for level in range(2, order + 1)]

    said = counts.where(F.col("kind") == RARE).select("part", "a", F.col("b").alias("key")).join(words.select("key", p_word.alias("p")), "key")
    said = said.groupBy("part", "a").agg(F.sum("p").alias("v")).select("part", F.lit(RARE).alias("kind"), "a", F.lit(0).cast("long").alias("b"), "v")
    if pairs is not None:
        mass = katz._discounted(F.col("c"), found[2])
        known_pairs = _landed(pairs.join(words.select(F.col("key").alias("b"), p_word.alias("p")), "b"), "known_pairs")
        sums = known_pairs.groupBy("a").agg(F.sum(mass).alias("mass"), F.sum("c").alias("total"), F.sum("p").alias("p"))
        share, total = F.col("mass") / F.col("total"), F.col("total")
        rated = sums.select("a", "total", F.least(F.lit(1.0), (1 - 1 / (total + 1)) / share).alias("scale"), share.alias("share"), "p")
        rated = F.broadcast(rated.select("a", "total", "scale", ((1 - F.col("scale") * F.col("share")) / (1 - F.col("p"))).alias("alpha")))
        each = known_pairs.drop("p").join(rated, "a").select(F.explode("parts").alias("part"), F.lit(SPLIT).alias("kind"), "a", "b", (F.col("scale") * mass / total).alias("v"))
        spread = {k: (int(katz.mix(*[np.array([k], dtype=np.uint64)] * 2)[0] % np.uint64(parts)), int(m)) for k, m in zip(split[0].tolist(), split[1].tolist(), strict=True)}
        homes = spark.createDataFrame([((home + i) % parts, katz._signed(k)) for k, (home, m) in spread.items() for i in range(min(m, parts))], "part int, a long")
        alphas = homes.join(rated, "a").select("part", F.lit(EVENTS).alias("kind"), "a", F.lit(0).cast("long").alias("b"), F.col("alpha").alias("v"))
        said = said.unionByName(each).unionByName(alphas)

    said = _landed(said, "said")

    kind = id_type(docs, id_col)
    id_of = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    out = f"doc_id {kind}, key long, tokens long, known long, base double, model double, asked long"
    blobs = counts.where(F.col("kind") == EVENTS).select(F.col("part").alias("home"), "blob")
    sums = _landed(blobs.groupBy("home").cogroup(said.groupBy("part")).applyInArrow(_scorer(shared, order, found, id_of), out), "sums")
    release(spark)
    drop(counts, said, *([pairs, known_pairs] if pairs is not None else []))
    rare = sums.where(F.col("key").isNotNull()).join(words, "key", "left").select(
        "doc_id",
        "tokens",
        F.when(F.col("c").isNotNull(), F.col("tokens")).otherwise(0).alias("known"),
        (F.col("tokens") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(N + V + 1)))).alias("base"),
        (F.col("asked") * F.log10(F.coalesce(p_word, F.lit(p_unknown)))).alias("model"),
    )
    both = sums.where(F.col("key").isNull()).select("doc_id", "tokens", "known", "base", "model").unionByName(rare)
    got = both.groupBy("doc_id").agg(F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score"))
    held_out: Column = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out")
    return got.select("doc_id", held_out, "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score")
