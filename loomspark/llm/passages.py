"""Near-duplicate passages by compact windows.

The hashes of a text's 5-word shingles form, under each of FUNCTIONS hash functions, a Cartesian tree: the subtree of a
shingle c is the widest range in which c has the smallest hash, so all subsequences of the range that hold c share their
min-hash. Ranges of WIDTH shingles or more are the text's compact windows, about 2n / WIDTH of them. A passage of 50
words or more that two texts share gives both a window with the same shingle under every function. Windows are grouped by
(function, shingle) and carry the words around them, so that a group's windows are compared where they meet (_linked): first
all with its first window, then with further ones, and in the end each two that no chain of equal passages joins yet. Two
windows are compared if, laid on each other at the shingle, they overlap in WIDTH shingles (the interval join) and some
shingle further on agrees (PLACES); then by the words around, 16 bits each: 50 words in a row must
have shingles with a Jaccard index of LEAST, where a shingle agrees on any of the diagonals up to DRIFT beside, so that an
inserted or deleted word parts no passage; and what agrees must reach over 50 words in both texts. The similarity of a passage is that
of its most similar 50 words. Windows that go on alike where what they share with one window ends meet again among themselves.

Texts that are copies of each other go through once; the copies are joined to their first document as whole passages.
A link of two documents is a row of the two, or shows through rows that join both to further documents at the same shingle,
so the rows grow with the number of windows, not of pairs.

Defined results: words are runs of other characters than ASCII white space, in lower case; texts under 50 words (null and
empty ones too) have no passages; rows with one doc_id and different texts count as texts of that document; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import bounded, checkpoint, drop, lean, release, small_batches, written

WORDS = 50
SHINGLE = 5
WIDTH = WORDS - SHINGLE + 1
FUNCTIONS = 3
#: Jaccard index of the shingles of two stretches of 50 words: 41 of 46 in common, or 42 of 46 and 47 after an insertion.
LEAST = 0.8
#: Shingles of WIDTH that agree at least where none is on a diagonal beside.
MOST = 41
#: Words by which insertions and deletions near a window may shift one text against the other.
DRIFT = 4
#: Of windows of one pair of documents on one diagonal, one in each BLOCK words is looked at.
BLOCK = 30
#: Words before and behind a shingle's start that are compared: those of any 50 words that hold a shingle of its block.
REACH = WORDS + BLOCK - 1
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Places, seen from a window's shingle, whose shingles are compared first, by 16 bits each, and the smallest shingles on the
#: way to them, which stay the same if a word beyond is added or dropped; one of the two has to agree. Of 46 shingles in a row that hold it, the 22 to its right or the 22 to its left are others.
PLACES = (22, -22, 11, -11)
#: Windows that all of their group are compared with, one after the other, before what is left of it is compared in tiles.
ROUNDS = 8
TILE = 1_000
#: Pairs that are compared at a time; windows of a group of which more are dealt out in tiles of two such parts; places
#: between windows of a run.
PAIRS, HOT = 2_000, 150_000
#: Pairs whose words are laid on each other at a time, so that what this takes stays in a core's cache.
TOGETHER = 250
STEP = 40
#: Bits of the filter of shared shingles: for each of these, and in all.
FILTER, FILTER_BITS = 8, 28
WINDOW = "key long, doc_id long, c int, l byte, r byte, near long, side long, words binary"
STRETCH = "doc_id long, class_doc long, s long, e long, class_s long, class_e long, alike double"
_INDEX = np.uint64((1 << 24) - 1)
#: Words around a window's shingle.
SIZE = 2 * REACH + SHINGLE

class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


_hashes = _Hashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    if len(_hashes) > 300_000:
        _hashes.clear()
    words = (text or b"").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return out


def _thinned(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places ``at`` without those inside of a stretch of h that repeats with a period of up to STEP / 2, but for one in two STEP.

    A passage in two such stretches that goes on beyond one end of both has the last, or the first, place in both; one that lies
    inside of both is whole where the first place of one is laid on the first or the second place of the other. So the two
    first and the two last places of a stretch stand for all, and the words around those between them, which overlap, for what lies between.
    """
    gap = np.diff(at)
    gap[(gap > STEP // 2) | (h[at[1:]] != h[at[:-1]])] = 0
    inner = np.flatnonzero((gap[:-3] > 0) & (gap[:-3] == gap[1:-2]) & (gap[1:-2] == gap[2:-1]) & (gap[2:-1] == gap[3:])) + 2
    out, more = np.ones(len(at), dtype=bool), []
    for d in np.unique(gap[inner]):
        mine = inner[gap[inner] == d]
        apart = np.flatnonzero(h[d:] != h[:-d])
        place = np.searchsorted(apart, at[mine])
        start, end = np.append(-1, apart)[place] + 1, np.append(apart, len(h) - d)[place]
        inside = (start <= at[mine] - 2 * d) & (end >= at[mine] + d)
        mine, start, end = mine[inside], start[inside], end[inside]
        out[mine[(at[mine] - start) // d % (2 * STEP // d) > 0]] = False
        last = at[mine] + (end + d - 1 - at[mine]) // d * d
        more += [last, last - d]
    return np.unique(np.concatenate([at[out], *more]))


def _minima(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose value is the smallest of WIDTH in a row, some for each run or repetition of it, and the bare values.

    values: hashes with 24 low bits free; a zero parts one text from the next.
    """
    n, h = len(values), values & ~_INDEX
    if n < WIDTH:
        return np.zeros(0, dtype=np.int64), h
    v = np.where(values > 0, h | np.arange(n, dtype=np.uint64), 0)
    low = _least_of(v, WIDTH)
    at = low[np.append(True, low[1:] != low[:-1])]
    at = np.unique(at[at > 0] & _INDEX).astype(np.int64)
    # Of a run of one value its first, its last and one in each STEP stand for all: runs in two texts are laid on each other
    # at their starts or ends.
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    run = np.searchsorted(starts, at, side="right") - 1
    last = np.append(starts[1:], n)[run] - 1
    return _thinned(np.unique(np.concatenate([starts[run], last, at[(at - starts[run]) % STEP == 0]])), h), h


def _sides(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """How far (at most REACH) the values before and behind each place are no smaller than its own."""
    padded = np.concatenate([np.zeros(REACH, dtype=np.uint64), h, np.zeros(REACH, dtype=np.uint64)])
    around, sides = np.lib.stride_tricks.sliding_window_view(padded, REACH), [np.zeros(len(at), dtype=np.int64) for _ in range(2)]
    for i in range(0, len(at), 1_000):
        p = at[i : i + 1_000]
        for side, smaller in zip(sides, (around[p][:, ::-1] < h[p][:, None], around[p + REACH + 1] < h[p][:, None]), strict=True):
            side[i : i + 1_000] = np.where(smaller.any(axis=1), smaller.argmax(axis=1), REACH)
    return sides


def compact_windows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of _minima and how far these stay the smallest on both sides (_sides)."""
    at, h = _minima(values)
    return at, *_sides(h, at)


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    if len(values) < width:
        return values[:0]
    low, span = values, 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - span :])


def _filter_places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _filter_words(bits: int) -> Callable:
    """Rows (key): (w, b), the bits of the keys' places in the filter's 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_filter_places(batch.column(0).to_numpy().view(np.uint64), bits))
            if len(at):
                w, start = np.unique(at >> np.uint64(6), return_index=True)
                b = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(b.view(np.int64))], names=["w", "b"])

    return run


def _windows(shared=None) -> Callable:  # noqa: ANN001
    """Rows (doc_id, text): (key, doc_id) of every compact window under every function; with the filter of shared keys
    (bits, words) rows (WINDOW) of those that it lets through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                size, hi = 0, lo
                while hi < len(texts) and size < 4_000_000:
                    size += len(texts[hi] or b"")
                    hi += 1
                yield from windows(ids[lo:hi], [word_hashes(t) for t in texts[lo:hi]])
                lo = hi

    def windows(ids: np.ndarray, words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = [np.append(shingles(w), np.uint64(0)) for w in words]
        flat = np.concatenate(held)
        sizes = np.array([len(p) for p in held])
        real = np.ones(len(flat), dtype=bool)
        starts = np.cumsum(sizes) - sizes
        real[starts + sizes - 1] = False
        if shared is not None:
            bits, let = shared.value
            beside = {w: _least_of(flat, w) for w in {abs(p) for p in PLACES}}
            # 16 bits of each word, never zero, and zeros around each text.
            before, after = np.zeros(REACH, np.uint16), np.zeros(REACH + SHINGLE, np.uint16)
            packed = np.concatenate([x for w in words for x in (before, (w >> np.uint64(48)).astype(np.uint16) | np.uint16(1), after)])
            texts = np.array([len(w) + len(before) + len(after) for w in words])
            home = np.cumsum(texts) - texts
        for k in range(FUNCTIONS):
            mixed = (flat ^ np.uint64(SEEDS[k])) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
            values = np.where(real, (mixed ^ (mixed >> np.uint64(29))) | (_INDEX + np.uint64(1)), 0)
            for s in range(0, len(values), 1 << 23):
                at, h = _minima(values[max(0, s - REACH) : s + (1 << 23) + REACH])
                at = at + max(0, s - REACH)
                own = (at >= s) & (at < s + (1 << 23))
                key = flat[at] * np.uint64(2 * k + 1) + np.uint64(SEEDS[k])
                if shared is not None:
                    place = _filter_places(key, bits)
                    own &= (let[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
                at, key = at[own], key[own]
                of = np.searchsorted(starts, at, side="right") - 1
                if shared is None:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[of])], names=["key", "doc_id"])
                    continue
                left, right = _sides(h, at - max(0, s - REACH))
                near, side = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
                for bit, place in enumerate(PLACES):
                    there = at + place
                    inside = (there >= starts[of]) & (there < starts[of] + sizes[of] - 1)
                    if inside.any():
                        low = beside[abs(place)][np.where(inside, at + 1 if place > 0 else there, 0)]
                        side |= np.where(inside, low & np.uint64(0xFFFF) | np.uint64(1), 0).astype(np.uint64) << np.uint64(16 * bit)
                        near |= np.where(inside, (flat[np.where(inside, there, 0)] >> np.uint64(48)) | np.uint64(1), 0).astype(np.uint64) << np.uint64(16 * bit)
                c = at - starts[of]
                for i in range(0, len(at), 20_000):
                    j = slice(i, i + 20_000)
                    around = packed[(home[of[j]] + c[j])[:, None] + np.arange(SIZE)[None, :]]
                    columns = [key[j].view(np.int64), ids[of[j]], c[j].astype(np.int32), left[j].astype(np.int8), right[j].astype(np.int8), near[j].view(np.int64), side[j].view(np.int64)]
                    words_at = pa.Array.from_buffers(pa.binary(), len(around), [None, pa.py_buffer(np.arange(len(around) + 1, dtype=np.int32) * np.int32(2 * SIZE)), pa.py_buffer(np.ascontiguousarray(around))])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), words_at], names=[x.split()[0] for x in WINDOW.split(", ")])

    return run


def _stretches(ok: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last shingle that agrees within the stretches that are ok."""
    n = same.shape[1]
    first, last = ok.argmax(axis=1), ok.shape[1] - 1 - ok[:, ::-1].argmax(axis=1) + WIDTH
    place = np.arange(n, dtype=np.int16)[None, :]
    within = same & (place >= first.astype(np.int16)[:, None]) & (place < last.astype(np.int16)[:, None])
    return within.argmax(axis=1), n - 1 - within[:, ::-1].argmax(axis=1)


def _sums(same: np.ndarray) -> np.ndarray:
    """How many of WIDTH shingles in a row agree, from each on whose stretch holds a shingle of this one's block."""
    sums = np.zeros((len(same), same.shape[1] + 1), np.int16)
    np.cumsum(same, axis=1, dtype=np.int16, out=sums[:, 1:])
    return (sums[:, WIDTH:] - sums[:, :-WIDTH])[:, : REACH + BLOCK]


def _straight(same: np.ndarray) -> list[np.ndarray]:
    """Whether a stretch agrees on the diagonal alone, its start and end in both texts, its similarity."""
    agree = _sums(same)
    most = agree.max(axis=1).astype(np.int64)
    alike = most / (2 * WIDTH - most)
    head, tail = _stretches(agree >= MOST, same)
    s, e = head, tail + SHINGLE
    return [(alike >= LEAST) & (e - s >= WORDS), s, e, s, e, alike]


def _spans(drift: np.ndarray) -> list[np.ndarray]:
    """Whether a stretch agrees by the diagonals up to DRIFT beside, its start and end in both texts, its similarity."""
    m, n = drift.shape
    same = drift <= DRIFT
    agree = _sums(same)
    k = agree.shape[1]
    place, row = np.arange(n)[None, :], np.arange(m)[:, None]
    behind = np.maximum.accumulate(np.where(same, place, -1), axis=1)[:, WIDTH - 1 :][:, :k]
    ahead = np.minimum.accumulate(np.where(same, place, n)[:, ::-1], axis=1)[:, ::-1][:, :k]
    longer = np.where(agree > 0, drift[row, np.maximum(behind, 0)] - drift[row, np.minimum(ahead, n - 1)], 0)
    agree = np.minimum(agree, WIDTH + longer)
    alike = agree / (2 * WIDTH + longer - agree)
    ok = alike >= LEAST
    (head, tail), row = _stretches(ok, same), row[:, 0]
    s, e, class_s, class_e = head, tail + SHINGLE, head + drift[row, head], tail + SHINGLE + drift[row, tail]
    return [ok.any(axis=1) & (e - s >= WORDS) & (class_e - class_s >= WORDS), s, e, class_s, class_e, np.where(ok, alike, 0).max(axis=1)]


def _alike(x: dict[str, np.ndarray], u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For windows u and v, laid on each other: which of the pairs have a stretch around their shingle in which 50 words in
    a row agree enough, and its start and end among the words around both, its similarity.

    A shingle agrees if the other text has it on the same diagonal or one up to DRIFT beside it. The other text's stretch
    runs from the partner of the first shingle to that of the last, and the two are compared as sets.
    """
    for lo in range(0, len(u), TOGETHER):
        a, b = x["words"][u[lo : lo + TOGETHER]], x["words"][v[lo : lo + TOGETHER]]
        m, n = len(a), SIZE - SHINGLE + 1
        padded = np.zeros((m, SIZE + 2 * DRIFT), dtype=np.uint16)
        padded[:, DRIFT : DRIFT + SIZE] = b
        some, drift, beside = a > 0, np.full((m, n), DRIFT + 1, dtype=np.int8), np.zeros(m, dtype=bool)
        for d in sorted(range(-DRIFT, DRIFT + 1), key=abs, reverse=True):
            word = (a == padded[:, DRIFT + d : DRIFT + d + SIZE]) & some
            two = word[:, 1:] & word[:, :-1]
            same = two[:, 2:-1] & two[:, :-3] & word[:, SHINGLE - 1 :]
            if d:
                hit = same.any(axis=1)
                if hit.any():
                    beside |= hit
                    np.copyto(drift, np.int8(d), where=same)
        one = _straight(same)
        found = [(np.arange(m), one)]
        beside = np.flatnonzero(beside)
        if len(beside):
            # Where chance repeats beside the diagonal spoil the joined stretch, the diagonal alone counts.
            drift = drift[beside]
            drift[same[beside]] = 0
            wide = _spans(drift.astype(np.int64))
            found.append((beside, wide))
            one[0][beside] &= ~(wide[0] & (wide[1] <= one[1][beside]) & (wide[2] >= one[2][beside]))
        for rows, (hit, *ends) in found:
            at = np.flatnonzero(hit)
            yield rows[at] + lo, [e[at] for e in ends]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, class_doc, stretches): passages, which are stretches that overlap in both texts on near diagonals."""
    for batch in batches:
        out = []
        for doc_id, class_doc, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            going: list[list] = []
            for x in sorted((y["s"], y["e"], y["class_s"], y["class_e"], y["alike"]) for y in held):
                going, done = [g for g in going if g[1] >= x[0]], [g for g in going if g[1] < x[0]]
                out += [(doc_id, class_doc, *g) for g in done]
                near = [g for g in going if g[2] <= x[3] and x[2] <= g[3] and min(abs(x[2] - x[0] - g[2] + g[0]), abs(x[2] - x[0] - g[3] + g[1])) <= DRIFT]
                if near:
                    g = near[0]
                    if x[1] > g[1]:
                        g[1], g[3] = x[1], max(g[3], x[3])
                    g[2], g[4] = min(g[2], x[2]), max(g[4], x[4])
                else:
                    going.append(list(x))
            out += [(doc_id, class_doc, *g) for g in going]
        kinds = [pa.int64()] * 6 + [pa.float64()]
        columns = zip(*out, strict=True) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "class_doc", "s", "e", "class_s", "class_e", "alike"])


def _fits(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the windows i and j of one group overlap in WIDTH shingles and enough further on agrees.

    By LEAST a stretch has one changed place. On the side of the shingle without it the stretch is the same to its end: in
    the next 11 shingles, if it goes so far; else it goes 35 beyond on the other side, which then holds the change.
    """
    left, right = np.minimum(x["l"][i], x["l"][j]), np.minimum(x["r"][i], x["r"][j])
    same = {by: [(x[by][k][i] == x[by][k][j]) & (x[by][k][i] > 0) for k in range(len(PLACES))] for by in ("near", "side")}
    near, side = same["near"], same["side"]
    agrees = near[0] | near[1] | (near[2] & near[3]) | side[0] | side[1] | (side[2] & side[3])
    enough = (near[2] & side[2]) | (near[3] & side[3]) | ((near[0] | side[0]) & (right >= WIDTH - 11)) | ((near[1] | side[1]) & (left >= WIDTH - 11))
    return (left.astype(np.int16) + right + 1 >= WIDTH) & agrees & enough


class _Links:
    """Pairs of windows (u, v) with v's document before u's, and their stretches among the words around both."""

    def __init__(self, x: dict[str, np.ndarray]) -> None:
        self.x, self.found = x, []

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of windows i and j, of two documents each, are alike; these are kept, with j as the one met."""
        swap = self.x["doc_id"][i] < self.x["doc_id"][j]
        u, v = np.where(swap, j, i), np.where(swap, i, j)
        hit = np.zeros(len(i), dtype=bool)
        for at, ends in _alike(self.x, u, v):
            hit[at] = True
            self.found.append((u[at], v[at], *ends, j[at]))
        return hit


def _root(up: dict[int, int], c: int) -> int:
    while c in up:
        c = up[c]
    return c


def _rounds(links: _Links, rows: np.ndarray, comp: np.ndarray, led: np.ndarray, at: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Let windows of each group meet, one after the other, all that no chain joins to them; comp and led are kept up.

    at, label: places in rows and their groups, in the order of these. Those of groups that aren't settled come back.
    """
    x, met = links.x, np.zeros(len(rows), dtype=bool)
    for step in range(ROUNDS + 1):
        if not len(at):
            break
        cuts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        doc, c, rest = x["doc_id"][rows[at]], comp[at], ~led[at]
        going = (np.minimum.reduceat(c, cuts) < np.maximum.reduceat(c, cuts)) & np.logical_or.reduceat(rest, cuts) & (np.minimum.reduceat(doc, cuts) < np.maximum.reduceat(doc, cuts))
        sizes = np.diff(np.append(cuts, len(at)))
        kept = np.repeat(going, sizes)
        at, label, sizes = at[kept], label[kept], sizes[going]
        if step == ROUNDS or not len(at):
            break
        m = len(at)
        head = at[np.minimum.reduceat(np.arange(m) + m * (met[at] + 2 * led[at].astype(np.int64)), np.cumsum(sizes) - sizes) % m]
        led[head] = True
        of = np.repeat(head, sizes)
        pick = (comp[at] != comp[of]) & ~led[at] & (x["doc_id"][rows[at]] != x["doc_id"][rows[of]])
        a, of = at[pick], of[pick]
        _compare(links, rows, comp, met, a, of)
    return at, label


def _compare(links: _Links, rows: np.ndarray, comp: np.ndarray, met: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    fit = _fits(links.x, rows[a], rows[b])
    a, b = a[fit], b[fit]
    hit = links.compare(rows[a], rows[b])
    met[a[hit]] = True
    up: dict[int, int] = {}
    for c, d in set(zip(comp[a[hit]].tolist(), comp[b[hit]].tolist(), strict=True)):
        c, d = _root(up, c), _root(up, d)
        if c != d:
            up[c] = d
    if up:
        into = np.arange(len(comp))
        into[list(up)] = [_root(up, c) for c in up]
        comp[:] = into[comp]


def _linked(links: _Links, rows: np.ndarray, group: np.ndarray) -> None:
    """Compare windows ``rows`` of groups, both in the order of groups and documents, until each two of a group that are
    alike are joined by a chain of pairs.

    What ROUNDS of windows don't settle meets in the parts of a group that agree at one of the places that _fits asks for, in
    rounds again and then in tiles.
    """
    x, comp, led, met = links.x, np.arange(len(rows)), np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
    at, label = _rounds(links, rows, comp, led, np.arange(len(rows)), group)
    if not len(at):
        return
    label = np.cumsum(np.append(False, label[1:] != label[:-1]))
    near, side = ([x[by][k][rows[at]].astype(np.int64) for k in range(len(PLACES))] for by in ("near", "side"))
    for value in (near[0], near[1], side[0], side[1], near[2] * side[2], near[3] * side[3]):
        by = np.flatnonzero(value > 0)
        by = by[np.lexsort([by, value[by], label[by]])]
        own, part = at[by], np.cumsum(np.append(False, (value[by[1:]] != value[by[:-1]]) | (label[by[1:]] != label[by[:-1]])))[: len(by)]
        done = led.copy()
        own, part = _rounds(links, rows, comp, done, own, part)
        for left in np.split(own, np.flatnonzero(part[1:] != part[:-1]) + 1):
            left = left[~done[left]]
            for i in range(0, len(left), TILE):
                for j in range(0, i + TILE, TILE):
                    p, q = left[i : i + TILE, None], left[None, j : j + TILE]
                    a, b = np.nonzero((comp[p] != comp[q]) & (p > q) & (x["doc_id"][rows[p]] != x["doc_id"][rows[q]]) & _fits(x, rows[p], rows[q]))
                    order = np.argsort(b, kind="stable")
                    a, b = left[i + a[order]], left[j + b[order]]
                    for k in range(0, len(a), PAIRS):
                        u, v = a[k : k + PAIRS], b[k : k + PAIRS]
                        apart = comp[u] != comp[v]
                        _compare(links, rows, comp, met, u[apart], v[apart])


def _further(links: _Links, since: int, beyond: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that go on alike, before or behind what they share with the same other window: (rows, group), as _linked takes them.

    beyond: for each window how far a stretch has reached on either side; a window meets again only after a longer one.
    """
    x, rows, signs = links.x, [], []
    for u, v, s, e, class_s, class_e, _, head in links.found[since:]:
        other, s, e = np.where(head == u, v, u), np.where(head == u, class_s, s), np.where(head == u, class_e, e)
        for side, at, start, reaches in (("e", e, e, e > beyond["e"][other]), ("s", s, s - SHINGLE, s < beyond["s"][other])):
            on = np.flatnonzero(reaches & (start >= 2 * SHINGLE) & (start + 3 * SHINGLE <= SIZE))
            words = x["words"][other[on][:, None], start[on][:, None] + np.arange(SHINGLE)]
            on, words = on[(words > 0).all(axis=1)], words[(words > 0).all(axis=1)]
            sign = x["key"][other[on]].view(np.uint64) + head[on].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + at[on].astype(np.uint64) * np.uint64(2 + (side == "e"))
            for k in range(SHINGLE):
                sign = (sign ^ (sign >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[:, k]
            rows.append(other[on])
            signs.append(sign)
    for u, v, s, e, class_s, class_e, _, _ in links.found[since:]:
        for w, first, last in ((u, s, e), (v, class_s, class_e)):
            np.maximum.at(beyond["e"], w, last)
            np.minimum.at(beyond["s"], w, first)
    rows, signs = (np.concatenate(z) if z else np.zeros(0, dtype=np.int64) for z in (rows, signs))
    by = np.lexsort([rows, signs])
    rows, signs = rows[by], signs[by]
    new = np.append(True, (signs[1:] != signs[:-1]) | (rows[1:] != rows[:-1]))[: len(rows)]
    rows, signs = rows[new], signs[new]
    _, of, count = np.unique(signs, return_inverse=True, return_counts=True)
    return rows[count[of] > 1], of[count[of] > 1]


def _copies(links: _Links, rows: np.ndarray) -> np.ndarray:
    """Whether windows (in the order of groups and documents) stand for those of their group with the same words around.

    The others have a row with the first or the second, which is the first of another document, and what is alike to them
    is alike to these two.
    """
    x, m = links.x, len(rows)
    sign, by = x["key"][rows].view(np.uint64).copy(), np.random.default_rng(1).integers(1 << 62, size=SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for i in range(0, m, 2_000):
        sign[i : i + 2_000] += (x["words"][rows[i : i + 2_000]] * by).sum(axis=1, dtype=np.uint64)
    order = np.argsort(sign, kind="stable")
    starts = np.flatnonzero(np.append(True, sign[order[1:]] != sign[order[:-1]]))
    doc, sizes = x["doc_id"][rows[order]], np.diff(np.append(starts, m))
    first = np.repeat(starts, sizes)
    second = np.repeat(np.minimum.reduceat(np.where(doc != doc[first], np.arange(m), m), starts), sizes)
    own = np.flatnonzero((np.arange(m) != first) & (np.arange(m) != second) & (second < m))
    of = np.where(doc[own] != doc[first[own]], first[own], second[own])
    a, b = rows[order[own]], rows[order[of]]
    stands = np.ones(m, dtype=bool)
    for i in range(0, len(a), 2_000):
        j = slice(i, i + 2_000)
        same = (x["key"][a[j]] == x["key"][b[j]]) & (x["words"][a[j]] == x["words"][b[j]]).all(axis=1) & _fits(x, a[j], b[j])
        hit = np.flatnonzero(same)
        stands[order[own[j][hit[links.compare(a[j][hit], b[j][hit])]]]] = False
    return stands


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (WINDOW), in the order of key, doc_id and c: stretches (STRETCH) of windows of one group."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        x = {n: table.column(n).to_numpy() for n in ("key", "doc_id", "c", "l", "r")}
        for by in ("near", "side"):
            x[by] = list(np.ascontiguousarray(table.column(by).to_numpy()).view(np.uint16).reshape(-1, len(PLACES)).T)
        words = [c.cast(pa.binary(2 * SIZE)) for c in table.column("words").chunks]
        x["words"] = np.concatenate([np.frombuffer(c.buffers()[1], dtype=np.uint16)[c.offset * SIZE : (c.offset + len(c)) * SIZE] for c in words]).reshape(-1, SIZE)
        del words
        links = _Links(x)
        rows = np.arange(len(x["key"]))
        rows = rows[_copies(links, rows)]
        group = x["key"][rows]
        beyond = {"e": np.full(len(x["key"]), -1), "s": np.full(len(x["key"]), SIZE + 1)}
        while len(rows):
            since = len(links.found)
            _linked(links, rows, group)
            rows, group = _further(links, since, beyond)
        for u, v, s, e, class_s, class_e, alike, _ in links.found:
            c, class_c = (x["c"][w].astype(np.int64) - REACH for w in (u, v))
            columns = [x["doc_id"][u], x["doc_id"][v], c + s, c + e, class_c + class_s, class_c + class_e, alike]
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in columns], names=["doc_id", "class_doc", "s", "e", "class_s", "class_e", "alike"])

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= 50_000:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from pairs(table.slice(0, cut))
            rest = table.slice(cut)
            held, rows = rest.to_batches(), 0 if rest.num_rows >= 50_000 else rest.num_rows
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _shared(single: DataFrame) -> DataFrame:
    """Windows (WINDOW) whose shingle another document has too, and few more; those of a group of over HOT are there once for
    each tile of two of its parts, under a key of the tile's.
    """
    spark = single.sparkSession
    ends = single.mapInArrow(lean(_windows()), "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z")
    ends = written(ends.select("key", "n"), "ends")
    release(spark)
    bits = min(FILTER_BITS, max(12, (FILTER * ends.count()).bit_length()))
    found = ends.select("key").mapInArrow(_filter_words(bits), "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    let = np.zeros(1 << (bits - 6), dtype=np.uint64)
    let[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    rows = single.mapInArrow(lean(_windows(spark.sparkContext.broadcast((bits, let)))), WINDOW)
    hot = checkpoint(ends.where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("k")))
    if hot.count():
        rows = rows.join(F.broadcast(hot), "key", "left").withColumn("p", F.pmod(F.xxhash64("doc_id"), "k"))
        rows = rows.withColumn("q", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))))
        tile = F.when(F.col("k").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")))
        rows = rows.select(tile.alias("key"), *[x.split()[0] for x in WINDOW.split(", ")[1:]])
    drop(ends)
    return rows


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, class_doc, class_start, similarity): passages of docs that another document repeats.

    Both sides of a link are there: the class document's own passage has its own place as class_start.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("b")).where("doc_id is not null and b is not null")
    ids = checkpoint(rows.select("doc_id", F.sha2("b", 256).alias("sha")))
    groups = checkpoint(ids.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    copies = ids.join(bounded(checkpoint(groups.where("n > 1")), 300_000), "sha").select("doc_id", "first", "n")
    copies = checkpoint(copies)
    gone = bounded(checkpoint(copies.where("doc_id <> first").select("doc_id").distinct()))
    single = rows.join(gone, "doc_id", "left_anti")
    stretches = written(_shared(single).repartition("key").sortWithinPartitions("key", "doc_id", "c").mapInArrow(lean(_met), STRETCH), "stretches")
    release(spark)
    found = stretches.groupBy("doc_id", "class_doc").agg(F.collect_set(F.struct("s", "e", "class_s", "class_e", "alike")).alias("x"))
    merged = found.select("doc_id", "class_doc", "x").mapInArrow(_joined, STRETCH)
    merged = checkpoint(merged.select("doc_id", "class_doc", F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("class_s").alias("class_start"), F.col("class_e").alias("class_end"), F.round("alike", 4).alias("similarity")))
    drop(stretches)
    own = merged.groupBy("class_doc", "class_start").agg(F.max("class_end").alias("end_word"))
    own = own.select(F.col("class_doc").alias("doc_id"), "class_doc", F.col("class_start").alias("start_word"), "end_word", "class_start", F.lit(1.0).alias("similarity"))
    merged = merged.drop("class_end")
    long = F.regexp_count(F.decode("b", "UTF-8"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    whole = rows.join(bounded(copies.distinct()), "doc_id").select("doc_id", F.col("first").alias("class_doc"), F.lit(0).cast("long").alias("start_word"), long.alias("end_word"), F.lit(0).cast("long").alias("class_start"), F.lit(1.0).alias("similarity")).where(F.col("end_word") >= WORDS)
    out = merged.unionByName(own).unionByName(whole).distinct()
    return out.select("doc_id", "start_word", "end_word", "class_doc", "class_start", "similarity")
