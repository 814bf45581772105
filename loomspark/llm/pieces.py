"""SentencePiece encoding and decoding with N-best segmentations.

The model's pieces and scores form a lattice over each text. Forward Viterbi gives the best score to reach each
position, an exact heuristic for a backward A* search that yields segmentations best first. No piece of the model runs
over the start of a word or a line break (tested when it is loaded), so the lattice falls apart into segments, whose
N-best lists are kept by text and merged: an N-best segmentation of a document differs from the best one only in the
N - 1 segments whose second choice costs least. A best segmentation is the one with the largest sum of piece scores; for
a model that was built by merges it may differ from what applying the merges in order gives, and decodes to the same text.

Characters in no piece, and a literal U+2581, go through byte pieces. Decoding drops the space that encoding puts first;
decoding an encoding gives the text back, whatever it is.

Defined results: null and empty texts have no ids and score 0; equal scores come in the order in which the search finds
them, the same on every machine; repeated rows each get a row; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import heapq
import re
from bisect import insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import lean, small_batches

MODEL = "piece_bpe_32k.model"
N_BEST = 3
#: Segments that a worker keeps, and their characters; beyond either it starts anew.
KEPT, KEPT_CHARS = 500_000, 20_000_000
#: Segments of at most so many characters are solved together.
LONG = 40
#: Characters of the documents that are encoded together, but for the last one's.
TOGETHER = 1_000_000
SPACE = "▁"
OUTPUT = "doc_id long, n_tokens int, score double, ids array<int>, alternatives array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>, exact boolean"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


class Pieces:
    """Lattice segmentation with the pieces of a model, given as the bytes of its file.

    The best segmentation of short segments is found for many at once in numpy, with the cost of their second choice;
    the A* search runs on the few segments of a document whose second choice is among its cheapest, and on others.
    """

    def __init__(self, model: bytes, n_best: int = N_BEST) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n_best = n_best
        self.bytes_of: list[bytes] = []
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte_id: dict[int, int] = {}
        low = 0.0
        for i in range(sp.get_piece_size()):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(s[3:5], 16)] = i
                self.bytes_of.append(bytes([int(s[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.piece[s] = (i, sp.get_score(i))
                self.bytes_of.append(s.replace(SPACE, " ").encode())
                low = min(low, sp.get_score(i))
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte pieces, so some texts would not decode")
        self.unknown = low - 10.0
        self.longest = max(map(len, self.piece))
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.piece)
        lines = not any("\n" in p and len(p) > 1 for p in self.piece)
        if not apart:
            self.segments = lambda text: [text]
        else:
            self.segments = re.compile(r"\x20+[^\x20\n]*|[^\x20\n]+|\n" if lines else r"\x20+[^\x20]*|[^\x20]+").findall
        self.further: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self._forget()
        self.tables = self._hashed()

    def _hashed(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: hashes, scores and ids of the pieces, and for each 16-bit slot the pieces in it."""
        out = []
        for size in range(1, min(self.longest, LONG) + 1):
            own = [(p, *x) for p, x in self.piece.items() if len(p) == size]
            h = np.zeros(len(own), dtype=np.uint64)
            for k in range(size if own else 0):
                h = h * _BASE + np.array([ord(p[k]) for p, _, _ in own], dtype=np.uint64)
            slot = _slot(h)
            order = np.argsort(slot, kind="stable")
            sizes = np.bincount(slot, minlength=1 << 16)
            place = np.arange(len(own)) - (np.cumsum(sizes) - sizes)[slot[order]]
            slots = np.full((max(1, int(sizes.max(initial=0))), 1 << 16), len(own), dtype=np.int32)
            slots[place, slot[order]] = order
            out.append((np.append(h, np.uint64(0)), np.array([*(x for _, _, x in own), -np.inf]), np.array([*(i for _, i, _ in own), -1], dtype=np.int32), slots))
        return out

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.known = self.chars = 0
        self.kept = [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int32)]

    def solve(self, segments: list[str]) -> list[np.ndarray]:
        """Of each segment the number of ids, the score, the cost of the second choice and whether the ids stand for it;
        then all ids.

        By forward and backward Viterbi: all segments go through the lattice together, position by position; the cost of
        the second choice is the smallest one of a path through an edge that is not on the best path. Long ones and those
        with characters in no piece are searched one by one.
        """
        n = len(segments)
        sizes, tops, gaps, back = np.zeros(n, dtype=np.int64), np.zeros(n), np.full(n, np.inf), np.ones(n, dtype=bool)
        by_size: dict[int, list[int]] = defaultdict(list)
        single = []
        for k, x in enumerate(segments):
            if len(x) <= LONG and SPACE not in x and "\0" not in x:
                by_size[-(-len(x) // 4)].append(k)
            else:
                single.append(k)
        parts = []
        for size, rows in by_size.items():
            at = np.array(rows)
            words = [segments[k] for k in rows]
            found, total, second, paths = self._solve(words, 4 * size)
            single += at[~found].tolist()
            at, paths = at[found], paths[found]
            sizes[at], tops[at], gaps[at] = (paths >= 0).sum(axis=1), total[found], second[found]
            flat = paths[paths >= 0]
            parts.append((at, flat))
            own = [w for w, ok in zip(words, found.tolist(), strict=True) if ok]
            if b"".join(map(self.bytes_of.__getitem__, flat.tolist())) != "".join(own).encode():
                ends = np.cumsum([0, *sizes[at]]).tolist()
                back[at] = [b"".join(map(self.bytes_of.__getitem__, flat[a:b].tolist())) == w.encode() for a, b, w in zip(ends, ends[1:], own, strict=False)]
        for k in single:
            found = self.search(segments[k], 2)
            ids = found[0][1]
            sizes[k], tops[k], gaps[k] = len(ids), found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
            back[k] = b"".join(map(self.bytes_of.__getitem__, ids)) == segments[k].encode()
            parts.append((np.array([k]), np.array(ids, dtype=np.int32)))
        first = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), dtype=np.int32)
        for at, flat in parts:
            n = sizes[at]
            ids[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return [sizes, tops, gaps, back, ids]

    def _solve(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of at most width characters: whether one was solved, score, cost of the second choice, ids after -1."""
        n = len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        chars = np.zeros((width, n), dtype=np.uint64)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        chars[column, row] = flat
        scores, ids = [], []
        h = np.zeros((width, n), dtype=np.uint64)
        for size in range(1, min(len(self.tables), width) + 1):
            h = h[: width - size + 1] * _BASE + chars[size - 1 :]
            hashes, score, own, slots = self.tables[size - 1]
            slot = _slot(h)
            found = np.full(h.shape, len(own) - 1, dtype=np.int32)
            for place in slots:
                at = place[slot]
                found = np.where(hashes[at] == h, at, found)
            scores.append(score[found])
            ids.append(own[found])
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        step = np.zeros((width + 1, n), dtype=np.int64)
        for j in range(1, width + 1):
            ways = np.stack([best[j - s] + scores[s - 1][j - s] for s in range(1, min(j, len(scores)) + 1)])
            step[j] = ways.argmax(axis=0)
            best[j] = ways.max(axis=0)
        every = np.arange(n)
        total = best[sizes, every]
        rest = np.full((width + 1, n), -np.inf)
        for i in range(width, -1, -1):
            for s in range(1, min(width - i, len(scores)) + 1):
                np.maximum(rest[i], scores[s - 1][i] + rest[i + s], out=rest[i])
            rest[i][sizes == i] = 0.0
        on_path = [np.zeros(x.shape, dtype=bool) for x in scores]
        at, taken = sizes.copy(), []
        known = np.isfinite(total)
        while (going := (at > 0) & known).any():
            s = np.where(going, step[at, every], 0)
            start = at - s - 1
            picked = np.full(n, -1, dtype=np.int32)
            for k in np.unique(s[going]):
                mine = np.flatnonzero(going & (s == k))
                picked[mine] = ids[k][start[mine], mine]
                on_path[k][start[mine], mine] = True
            taken.append(picked)
            at = np.where(going, start, at)
        second = np.full(n, -np.inf)
        for s, score in enumerate(scores, 1):
            through = best[: width - s + 1] + score + rest[s:]
            through[on_path[s - 1]] = -np.inf
            np.maximum(second, through.max(axis=0), out=second)
        gaps = np.where(np.isfinite(second), total - np.where(np.isfinite(second), second, 0.0), np.inf)
        return known, total, gaps, np.array(taken[::-1], dtype=np.int32).reshape(-1, n).T

    def search(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a segment, best first: score and ids. Spaces are ordinary characters here."""
        size, piece = len(segment), self.piece
        shown = segment.replace(SPACE, "\0").replace(" ", SPACE)
        best = [0.0] + [-np.inf] * size
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            known = False
            for j in range(i + 1, min(i + self.longest, size) + 1):
                if (got := piece.get(shown[i:j])) is not None:
                    into[j].append((i, got[1], (got[0],)))
                    known = known or j == i + 1
                    if best[i] + got[1] > best[j]:
                        best[j] = best[i] + got[1]
            if not known:
                ids = tuple(self.byte_id[b] for b in segment[i].encode())
                into[i + 1].append((i, self.unknown, ids))
                best[i + 1] = max(best[i + 1], best[i] + self.unknown)
        # A cost is exact, so each open path stands for at least one segmentation of that cost: n of them are enough.
        cost = [-x for x in best]
        heap = [(cost[size], 0, size, 0.0, None)]
        order, found = 0, []
        while heap and len(found) < n:
            _, _, at, tail, path = heap.pop(0)
            if at == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append((tail, tuple(ids)))
                continue
            room = n - len(found)
            for i, score, ids in into[at]:
                order += 1
                c = cost[i] - score - tail
                if len(heap) < room or c < heap[-1][0]:
                    insort(heap, (c, order, i, score + tail, (ids, path)))
                    del heap[room:]
        return found

    def choices(self, segment: str, ids: tuple[int, ...], top: float) -> list[tuple[float, tuple[int, ...]]]:
        """The further segmentations of a segment, as (cost, ids); those of frequent words are asked for again and again."""
        got = self.further.get(segment)
        if got is None:
            got = [(top - s, x) for s, x in self.search(segment, self.n_best) if x != ids][: self.n_best - 1]
            if len(segment) <= LONG:
                if len(self.further) >= KEPT // 20:
                    self.further.clear()
                self.further[segment] = got
        return got

    def encode(self, text: str | None) -> tuple[list[int], float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """Ids and score of the best segmentation; then the next ones, each as a score and edits (at, drop, ids) of the ids."""
        _, ids, scores, others, _ = self.encode_all([text])
        return ids.tolist(), scores[0], others[0]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[float], list[list], list[bool]]:
        """For all texts: where their ids start and end, the ids, scores, next segmentations, and whether ids decode to the text.

        Decoding joins what each id stands for, so it gives a text back if its segments join to it and each comes back.
        """
        if len(self.number) > KEPT or self.chars > KEPT_CHARS:
            self._forget()
        cut = [self.segments(" " + t) if t else [] for t in texts]
        ends = np.cumsum([0, *(len(x) for x in cut)])
        segment = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=ends[-1])
        if len(self.number) > self.known:
            new = list(islice(self.number, self.known, None))
            self.kept = [np.concatenate(x) for x in zip(self.kept, self.solve(new), strict=True)]
            self.known += len(new)
            self.chars += sum(map(len, new))
        sizes, tops, costs, back, flat = self.kept
        first = np.cumsum(sizes) - sizes
        counts = sizes[segment]
        after = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(first[segment] - after[:-1], counts) + np.arange(after[-1])]
        totals = np.concatenate([[0.0], np.cumsum(tops[segment])])
        gaps = costs[segment]
        wrong = np.concatenate([[0], np.cumsum(~back[segment])])
        others, exact = [], []
        for t, parts, lo, hi in zip(texts, cut, ends[:-1], ends[1:], strict=True):
            at = self._cheapest(gaps[lo:hi])
            starts = after[lo : hi + 1] - after[lo]
            own = [(tuple(ids[after[lo + k] : after[lo + k + 1]].tolist()), tops[segment[lo + k]]) for k in at.tolist()]
            others.append(self._others(parts, own, at, starts, totals[hi] - totals[lo]))
            exact.append(bool(wrong[lo] == wrong[hi]) and "".join(parts) == (" " + t if t else ""))
        return after[ends], ids, (totals[ends[1:]] - totals[ends[:-1]]).tolist(), others, exact

    def _cheapest(self, gaps: np.ndarray) -> np.ndarray:
        """The n_best - 1 segments whose second choice costs least, the first ones of equals."""
        n = self.n_best - 1
        if n < len(gaps):
            most = np.partition(gaps, n - 1)[n - 1] if n else -1.0
            at = np.flatnonzero(gaps <= most)
            at = at[np.argsort(gaps[at], kind="stable")][:n]
        else:
            at = np.argsort(gaps, kind="stable")
        return at[gaps[at] < np.inf]

    def _others(self, parts: list[str], own: list[tuple], at: np.ndarray, starts: np.ndarray, score: float) -> list:
        ways: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
        for k, (ids, top) in zip(at.tolist(), own, strict=True):
            ways += [(cost + more, (*chosen, (k, new))) for cost, chosen in ways for more, new in self.choices(parts[k], ids, top)]
            ways = heapq.nsmallest(self.n_best, ways)
        return [(float(score) - cost, sorted((int(starts[k]), int(starts[k + 1] - starts[k]), new) for k, new in chosen)) for cost, chosen in ways[1:]]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def edited(ids: list[int], edits: list) -> list[int]:
    """The ids of an alternative."""
    out, done = [], 0
    for at, drop, new in edits:
        out += [*ids[done:at], *new]
        done = at + drop
    return out + list(ids[done:])


_loaded: dict[tuple[int, int], Pieces] = {}


def _pieces(model: bytes, n_best: int) -> Pieces:
    """One for each model in a worker, whose lists serve all its tasks."""
    key = (hash(model), n_best)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model, n_best)
    return _loaded[key]


def _encoder(model, n_best: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value, n_best)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                chars, hi = 0, lo
                while hi < len(texts) and chars < TOGETHER:
                    chars += len(texts[hi] or "")
                    hi += 1
                part = texts[lo:hi]
                ends, ids, scores, others, exact = pieces.encode_all(part)
                more = [[{"score": s, "edits": [{"at": a, "drop": d, "ids": list(x)} for a, d, x in edits]} for s, edits in r] for r in others]
                kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends).astype(np.int32)), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(more, kind), pa.array(exact)],
                    names=["doc_id", "n_tokens", "score", "ids", "alternatives", "exact"],
                )
                lo = hi

    return run


def encode_documents(docs: DataFrame, path: str | None = None, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, score, ids, alternatives (the next n_best - 1), exact (decodes to the text)."""
    small_batches(docs.sparkSession)
    with open(path or model_path(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_encoder(model, n_best)), OUTPUT)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    with open(path or model_path(), "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value, N_BEST)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
