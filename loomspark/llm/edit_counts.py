"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern; each is encoded by itself, so a text's count is the sum over
its pre-tokens. A segment tree per document keeps, for blocks of LEAF pre-tokens, their text, lengths and counts, and for
each inner node the sums of characters and tokens. An edit finds its block by descending the sums; pre-tokens are formed
anew from two before the edit (a match depends on its own characters, the rest of a white-space run and one more) until a
boundary behind the edit falls on an old one with two pre-tokens after it; only those are encoded, and the sums on the
blocks' paths are updated.

Defined results: null text counts as empty; edits are applied in order of seq, positions refer to the text after the
edits before, and are clamped to it; null edit positions count as 0 and null new text as empty; edits of unknown
documents do nothing; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import small_batches

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 64
#: Pre-tokens whose counts a worker keeps, in two generations.
KEPT = 200_000
OUTPUT = "doc_id long, n_tokens long, n_tokens_after long, n_pretokens long, n_pretokens_after long, n_reencoded long, chars_after long"
EDITS = "array<struct<seq:long,start:long,stop:long,new:string>>"


class Encoder:
    """Counts the tokens of a pre-token, remembering what it has counted."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.single = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(pattern).findall
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def miss(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.single(piece.encode()))
        if len(piece) <= 64:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        get, miss = self.young.get, self.miss
        return [get(p) or miss(p) for p in pieces]


class CountTree:
    """Segment tree over blocks of pre-tokens."""

    def __init__(self, encoder: Encoder, text: str) -> None:
        self.encoder, self.reencoded = encoder, 0
        pieces = encoder.split(text)
        self._fill(pieces, encoder.counts(pieces))

    def _fill(self, pieces: list[str], counts: list[int]) -> None:
        self.blocks = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens, self.pieces = ([0] * (2 * self.width) for _ in range(3))
        for k in range(len(self.blocks)):
            self._leaf(k)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _leaf(self, k: int) -> None:
        pieces, counts = self.blocks[k]
        i = self.width + k
        self.chars[i], self.tokens[i], self.pieces[i] = sum(map(len, pieces)), sum(counts), len(pieces)

    def _sum(self, i: int) -> None:
        for x in (self.chars, self.tokens, self.pieces):
            x[i] = x[2 * i] + x[2 * i + 1]

    def _update(self, first: int, last: int) -> None:
        for k in range(first, last + 1):
            self._leaf(k)
        lo, hi = (self.width + first) // 2, (self.width + last) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._sum(i)
            lo, hi = lo // 2, hi // 2

    def _at(self, offset: int) -> tuple[int, int]:
        """The block that holds the character at offset (the last one for the end), and where the block starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if offset >= start + self.chars[i] and start + self.chars[i] < self.chars[1]:
                start += self.chars[i]
                i += 1
        return min(i - self.width, len(self.blocks) - 1), start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from start to before stop."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        first, base = self._at(max(start - 1, 0))
        last, position, lead = first, base, 0
        flat: list[tuple[str, int]] = list(zip(*self.blocks[first], strict=True))
        while lead < len(flat) and position + len(flat[lead][0]) < start:
            position += len(flat[lead][0])
            lead += 1
        # From two pre-tokens before the one that holds the character before the edit.
        while lead < 2 and first:
            first -= 1
            base -= self.chars[self.width + first]
            lead += len(self.blocks[first][0])
            flat = [*zip(*self.blocks[first], strict=True), *flat]
        lead = max(0, lead - 2)
        position = base + sum(len(p) for p, _ in flat[:lead])
        while True:
            text = "".join(p for p, _ in flat[lead:])
            covered = position + len(text)
            if covered < stop or (covered < size and len(flat) - lead < 8):
                if last + 1 < len(self.blocks):
                    last += 1
                    flat += zip(*self.blocks[last], strict=True)
                    continue
            fresh = self.encoder.split(text[: start - position] + new + text[stop - position :])
            whole = last + 1 == len(self.blocks)
            shift = len(new) - (stop - start)
            old_ends, at = {position: lead}, position
            for k in range(lead, len(flat)):
                at += len(flat[k][0])
                old_ends[at] = k + 1
            sync, at = None, position
            for k, p in enumerate(fresh):
                at += len(p)
                if at >= start + len(new) and (back := old_ends.get(at - shift)) is not None and at - shift >= stop and (whole or k + 3 <= len(fresh)):
                    sync = (k + 1, back)
                    break
            if sync is None and not fresh and whole:
                sync = (0, len(flat))
            if sync is not None:
                break
            last += 1
            flat += zip(*self.blocks[last], strict=True)
        made = fresh[: sync[0]]
        self.reencoded += len(made)
        flat[lead : sync[1]] = zip(made, self.encoder.counts(made), strict=True)
        n = last - first + 1
        each = -(-len(flat) // n)
        if each > 4 * LEAF:
            before, after = self.blocks[:first], self.blocks[last + 1 :]
            every = [*(x for b in before for x in zip(*b, strict=True)), *flat, *(x for b in after for x in zip(*b, strict=True))]
            self._fill([p for p, _ in every], [c for _, c in every])
            return
        for j in range(n):
            part = flat[j * each : (j + 1) * each]
            self.blocks[first + j] = ([p for p, _ in part], [c for _, c in part])
        self._update(first, last)

    def text(self) -> str:
        return "".join(p for pieces, _ in self.blocks for p in pieces)


_loaded: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    ranks, pattern = shared.value
    key = hash((ranks, pattern))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(ranks, pattern)
    return _loaded[key]


def _share(df: DataFrame, path: str | None, pattern: str | None):  # noqa: ANN202
    import public_tokenizers

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))


def _row(tree: CountTree, before: tuple[int, int]) -> tuple[int, ...]:
    return (before[0], tree.tokens[1], before[1], tree.pieces[1], tree.reencoded, tree.chars[1])


def _result(ids: list, rows: list[tuple[int, ...]]) -> pa.RecordBatch:
    found = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(found[:, k]) for k in range(6))], names=["doc_id", "n_tokens", "n_tokens_after", "n_pretokens", "n_pretokens_after", "n_reencoded", "chars_after"])


def counts_with_edits(docs: DataFrame, edits: str = "edits", path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts before and after, for docs whose column ``edits`` holds each row's own edits (type EDITS)."""
    small_batches(docs.sparkSession)
    shared = _share(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            rows = []
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = CountTree(encoder, text or "")
                before = (tree.tokens[1], tree.pieces[1])
                for e in sorted(changes or [], key=lambda e: e["seq"] or 0):
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                rows.append(_row(tree, before))
            yield _result(batch.column(0).to_pylist(), rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits).cast(EDITS).alias("edits")).mapInArrow(run, OUTPUT)


def edited_token_counts(docs: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for edits that come as rows (doc_id, seq, start, stop, new).

    Documents and edits are sorted together by (doc_id, seq) and streamed, so that one tree and one Arrow batch of edits
    are in memory, however many edits a document has. Repeated document rows: the edits go to the first.
    """
    small_batches(docs.sparkSession)
    shared = _share(docs, path, pattern)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    e = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("kind"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("start"), F.coalesce(F.col("stop").cast("long"), F.lit(0)).alias("stop"), F.coalesce("new", F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        now = None
        waiting: list[tuple] = []
        for batch in batches:
            for doc_id, kind, _, start, stop, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if now is not None and now[0] == doc_id:  # a repeated row: counted, without edits
                        tree = CountTree(encoder, t)
                        waiting.append((doc_id, _row(tree, (tree.tokens[1], tree.pieces[1]))))
                        continue
                    if now is not None:
                        waiting.append((now[0], _row(now[1], now[2])))
                    tree = CountTree(encoder, t)
                    now = (doc_id, tree, (tree.tokens[1], tree.pieces[1]))
                elif now is not None and doc_id is not None and now[0] == doc_id:
                    now[1].edit(start, stop, t)
                if len(waiting) >= 1000:
                    yield _result([x[0] for x in waiting], [x[1] for x in waiting])
                    waiting = []
        if now is not None:
            waiting.append((now[0], _row(now[1], now[2])))
        if waiting:
            yield _result([x[0] for x in waiting], [x[1] for x in waiting])

    rows = d.unionByName(e)
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "seq").mapInArrow(run, OUTPUT)
