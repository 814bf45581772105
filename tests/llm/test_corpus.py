"""Language model, passages, URL lists and the pipeline against plain versions."""

from __future__ import annotations

import datetime
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import decontaminate, exact_dedup, katz, langid, passages, pieces, simhash, url_lists
from loomspark.llm.queries import ORACLE_SQL, QUERIES

CLASHES = ("key", "value", "h", "w", "c", "base", "model", "known", "sha", "first", "n", "shift")


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({x: F.lit("clash") for x in CLASHES if x not in df.columns})


# Katz


def plain_words(text):
    return (text or "").encode().lower().split()


class PlainKatz:
    """The recursion as it stands: p(w | h), or alpha(h) * p(w | h without its first word)."""

    def __init__(self, texts, order=katz.ORDER):
        self.order = order
        self.grams = {n: defaultdict(Counter) for n in range(1, order + 1)}
        for t in texts:
            said = [*["START"] * (order - 1), *plain_words(t), "END"]
            for i in range(order - 1, len(said)):
                for n in range(1, order + 1):
                    self.grams[n][tuple(said[i - n + 1 : i])][said[i]] += 1
        self.words = self.grams[1][()]
        self.N, self.V = sum(self.words.values()), len(self.words)
        self.d = {n: katz.discounts(Counter(c for of in self.grams[n].values() for c in of.values())) for n in self.grams}
        left = sum(self.mass(1, c) for c in self.words.values())
        scale = min(1, self.N / (left * (1 + 1 / self.N)))
        self.p1 = {w: scale * self.mass(1, c) / self.N for w, c in self.words.items()}
        self.unknown = 1 - sum(self.p1.values())
        self.known = {}

    def mass(self, n, c):
        return (self.d[n][c] if c <= katz.K else 1) * c

    def history(self, h):
        """(scale / total, alpha) of a history that was seen."""
        if h not in self.known:
            n, of = len(h) + 1, self.grams[len(h) + 1][h]
            total = sum(of.values())
            share = sum(self.mass(n, c) for c in of.values()) / total
            s = min(1, (1 - 1 / (total + 1)) / share)
            self.known[h] = s / total, (1 - s * share) / (1 - sum(self.p(h[1:], w) for w in of))
        return self.known[h]

    def p(self, h, w):
        if not h:
            return self.p1.get(w, self.unknown)
        of = self.grams[len(h) + 1].get(h)
        if not of:
            return self.p(h[1:], w)
        per, alpha = self.history(h)
        return per * self.mass(len(h) + 1, of[w]) if w in of else alpha * self.p(h[1:], w)

    def score(self, text):
        said = [*["START"] * (self.order - 1), *plain_words(text), "END"]
        return sum(math.log10(self.p(tuple(said[i - self.order + 1 : i]), said[i])) for i in range(self.order - 1, len(said)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "FREQUENT_WORDS", 5)
    monkeypatch.setattr(katz, "FREQUENT_GRAMS", 9)
    rnd = random.Random(10)
    vocabulary = [f"v{k}" for k in range(60)]
    docs = [(i, " ".join(rnd.choice(vocabulary[: 3 + i % 57]) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "unseen words HERE v1"), (203, "V1 \t v2\n"), (204, "v3 " * 3000)]
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    plain = PlainKatz(train, order)
    for n in range(2, order + 1):
        for h in [*list(plain.grams[n])[:10], ("nothing",) * (n - 1)]:
            assert math.isclose(sum(plain.p(h, w) for w in [*plain.words, "zz"]), 1, rel_tol=1e-9)
    got = {r.doc_id: r for r in katz.scored(frame(spark, docs), order=order).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        r, said = got[i], [*plain_words(t), "END"]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(said), sum(w in plain.words for w in said), plain.N)
        assert math.isclose(r.base_score, sum(math.log10((plain.words[w] + 1) / (plain.N + plain.V + 1)) for w in said), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, plain.score(t), rel_tol=1e-9, abs_tol=1e-9)


def test_katz_keeps_what_is_seen_once(spark):
    rnd = random.Random(14)
    docs = [(i, " ".join(f"v{int(40 * rnd.random() ** 2)}" for _ in range(25))) for i in range(40)]
    plain = PlainKatz([t for _, t in docs], 2)
    model = katz.Model(frame(spark, docs), order=2)
    n = Counter(c for of in plain.grams[2].values() for c in of.values())
    assert n[1] > 50 and model.weights.where("known = 0").count() == sum(map(len, plain.grams[2].values()))
    rest = (katz.K + 1) * n[katz.K + 1] / n[1]
    assert math.isclose(model.discounts[2][1], (2 * n[2] / n[1] - rest) / (1 - rest), rel_tol=1e-12) and 0 < model.discounts[2][1] < 1


def test_katz_of_odd_tables(spark):
    assert katz.scored(frame(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = katz.scored(frame(spark, [(held, "a b")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in only] == [(3, 0, 0, 0.0, 0.0)]
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    got = {r.doc_id: r for r in katz.scored(frame(spark, [(free, "a a a a a a a a"), (free, "b"), (None, "a zz")])).collect()}
    assert got[free].n_tokens == 11 and got[None].n_tokens == 3 and got[None].n_known == 2
    assert all(math.isfinite(r.score) for r in got.values())


# Passages


def test_compact_windows_cover_every_range():
    import numpy as np

    rnd = np.random.default_rng(2)
    for n in (10, passages.WIDTH, 300):
        values = (rnd.integers(1, 1 << 38, n, dtype=np.uint64) << np.uint64(24)) | (passages._INDEX + np.uint64(1))
        at, left, right = passages.compact_windows(values)
        for s in range(n - passages.WIDTH + 1):
            c = s + int(np.argmin(values[s : s + passages.WIDTH]))
            k = np.flatnonzero(at == c)
            assert len(k) == 1 and c - left[k[0]] <= s and c + right[k[0]] >= s + passages.WIDTH - 1


def test_compact_windows_of_a_run():
    """Of a run of one value the ends and one place in each STEP stay, with the reach of the value on both sides."""
    import numpy as np

    rnd = np.random.default_rng(3)
    values = (rnd.integers(1 << 30, 1 << 38, 300, dtype=np.uint64) << np.uint64(24)) | (passages._INDEX + np.uint64(1))
    values[100:200] = np.uint64(1 << 25 | (1 << 24) - 1)
    at, left, right = passages.compact_windows(values)
    inside = (at >= 100) & (at < 200)
    assert at[inside].tolist() == [100, 140, 180, 199]
    assert set(left[inside].tolist()) == set(right[inside].tolist()) == {passages.REACH}


def test_passages(spark):
    rnd = random.Random(11)
    fresh = iter(range(10**6))

    def new(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    shared = [new(n) for n in (51, 60, 120, 49, 30)]
    near = list(shared[2])
    near[60] = "changed"
    line = new(12)
    docs = {
        1: new(100) + shared[0] + new(50), 2: shared[0] + new(300), 3: new(20) + shared[1], 4: shared[1] + new(1), 5: new(5) + shared[2] + new(5),
        6: new(9) + near, 7: shared[3] + new(60), 8: new(60) + shared[3], 9: shared[4] + new(100), 10: shared[4] + new(80), 11: new(500),
        **{20 + k: new(40) + line + new(40) for k in range(30)},
    }
    docs[12] = docs[13] = docs[11]
    rows = [(i, (" " if i % 2 else "\n").join(w).upper()) for i, w in docs.items()] + [(50, None), (51, ""), (52, "short text"), (53, "short text")]
    rows[12] = (13, rows[10][1])
    rows[11] = (12, rows[10][1])
    rnd.shuffle(rows)
    found = [r.asDict() for r in passages.repeated_passages(frame(spark, rows)).collect()]
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["class_doc"], r["class_start"]) for r in found}
    for a, b, passage in ((1, 2, shared[0]), (3, 4, shared[1])):
        s, e = docs[a].index(passage[0]), docs[b].index(passage[0])
        assert {(a, s, s + len(passage), a, s), (b, e, e + len(passage), a, s)} <= got
    assert {(5, 5, 125, 5, 5), (6, 9, 129, 5, 5)} <= got
    assert {(i, 0, 500, 11, 0) for i in (11, 12, 13)} <= got
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4, 5, 6, 11, 12, 13}
    assert all(r["similarity"] >= passages.LEAST for r in found)
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_passages_of_middle_documents(spark):
    """Passages that hold a frequent run of words, whose every window meets documents that have the run without the passage."""
    rnd = random.Random(12)

    def new(n):
        return [f"x{rnd.getrandbits(40)}" for _ in range(n)]

    want, docs = {}, {}
    for case in range(25):
        passage, low = new(60), 100 * case
        runs = [passage[k : k + 30] for k in (0, 15, 30)]
        for k in range(5):
            docs[low + k] = new(70) + runs[k % 3] + new(70) + runs[(k + 1) % 3] + new(70) + runs[(k + 2) % 3] + new(70)
            docs[low + 90 + k] = new(70) + runs[k % 3] + new(70) + runs[(k + 1) % 3] + new(70) + runs[(k + 2) % 3] + new(70)
        for k in (50, 51):
            docs[low + k] = new(80 + k) + passage + new(80)
            want[low + k] = 80 + k
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    rnd.shuffle(rows)
    found = passages.repeated_passages(frame(spark, rows)).collect()
    for i, s in want.items():
        assert any(r.doc_id == i and r.start_word <= s and r.end_word >= s + 60 for r in found), i
    assert {r.doc_id for r in found} == set(want)


def test_near_copies_of_middle_documents(spark):
    """Copies with a changed word, so without 50 equal words, whose every run of 30 words first and last documents have."""
    rnd = random.Random(14)

    def new(n):
        return [f"z{rnd.getrandbits(40)}" for _ in range(n)]

    want, docs = {}, {}
    for case in range(20):
        passage, low = new(80), 100 * case
        near = [*passage[:40], *new(1), *passage[41:]]
        runs = [x[k : k + 30] for x in (passage, near) for k in (0, 10, 20, 30, 40, 50)]
        for k in range(5):
            for at in (0, 90):
                docs[low + at + k] = [w for r in runs[k:] + runs[:k] for w in (*r, *new(60))]
        for k, x in ((50, passage), (51, near)):
            docs[low + k] = new(80 + k) + x + new(80)
            want[low + k] = 80 + k
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    rnd.shuffle(rows)
    found = passages.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in found} == set(want)
    for i, s in want.items():
        assert any(r.doc_id == i and r.class_doc == i - i % 100 + 50 and r.start_word <= s and r.end_word >= s + 80 for r in found), i


def test_passages_with_words_added_or_dropped(spark):
    rnd = random.Random(13)

    def new(n):
        return [f"y{rnd.getrandbits(40)}" for _ in range(n)]

    docs, want = {}, {}
    for case in range(24):
        passage, a, b = new(98 if case % 3 else 400), 10 * case, 10 * case + 1
        other = list(passage)
        for k in reversed(range(49, len(passage), 98) if len(passage) == 98 else range(45, len(passage), 45)):
            if case % 2:
                other.insert(k, *new(1))
            else:
                del other[k]
        docs[a], docs[b] = new(30) + passage + new(20), new(60) + other + new(10)
        want[a, b] = (30, 30 + len(passage), 60, 60 + len(other))
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    # A passage parted by more words than LEAST allows stays two pieces of under 50 words.
    short = new(80)
    rows += [(1000, " ".join(short)), (1001, " ".join(short[:40] + new(15) + short[40:]))]
    found = passages.repeated_passages(frame(spark, rows)).collect()
    got = {(r.doc_id, r.start_word, r.end_word, r.class_doc, r.class_start) for r in found}
    for (a, b), (s, e, t, f) in want.items():
        assert {(a, s, e, a, s), (b, t, f, a, s)} <= got, (a, [x for x in got if x[0] in (a, b)])
    assert {r.doc_id for r in found} == {i for pair in want for i in pair}
    assert all(r.similarity >= passages.LEAST for r in found)


# URL lists


def test_url_lists(spark):
    day = datetime.date
    entries = [("l", "Bad.com", day(2024, 1, 10), "add"), ("l", "bad.com", day(2024, 3, 1), "remove"), ("l", "bad.com", day(2024, 9, 1), "add"), ("m", "x.bad.com", day(2024, 2, 1), "add"), ("l", "same.org", day(2024, 1, 1), "add"), ("l", "same.org", day(2024, 1, 1), "remove"), (None, "good.com", day(2024, 1, 1), "add"), ("l", "good.com", None, "add"), ("l", "good.com", day(2024, 1, 1), "other"), ("l", "bad.com", day(2024, 1, 10), "add")]
    captures = [(1, "http://bad.com/x", day(2024, 1, 9)), (2, "https://user@WWW.bad.com:80/", day(2024, 1, 10)), (3, "http://x.bad.com", day(2024, 2, 29)), (4, "http://x.bad.com", day(2024, 3, 1)), (5, "http://bad.com", day(2025, 6, 1)), (6, "http://notbad.com", day(2024, 2, 1)), (7, None, day(2024, 2, 1)), (8, "http://bad.com", None), (9, "http://same.org", day(2024, 2, 1)), (10, "good.com", day(2024, 2, 1)), (1, "http://bad.com/x", day(2024, 1, 9)), (None, "http://bad.com", day(2024, 2, 1))]
    c = frame(spark, captures, "page_id long, url string, fetched_at date")
    e = frame(spark, entries, "list string, value string, at date, action string")
    got = {r.page_id: (r.n_active, r.blocked, r.lists, r["values"]) for r in url_lists.active_entries(c, e).collect()}
    assert len(got) == 11
    hit = {2: (1, True, "l", "bad.com"), 3: (2, True, "l,m", "bad.com,x.bad.com"), 4: (1, True, "m", "x.bad.com"), 5: (1, True, "l", "bad.com"), None: (1, True, "l", "bad.com")}
    assert got == {i: hit.get(i, (0, False, "", "")) for i in got}
    at = datetime.datetime
    hours = frame(spark, [("l", "h.com", at(2024, 1, 1, 9), "add"), ("l", "h.com", at(2024, 1, 1, 17), "remove"), ("l", "h.com", at(2024, 1, 1, 18), "add")], "list string, value string, at timestamp, action string")
    seen = frame(spark, [(i, "http://h.com", at(2024, 1, 1, i)) for i in (8, 9, 12, 17, 18)], "page_id long, url string, fetched_at timestamp")
    assert {r.page_id: r.blocked for r in url_lists.active_entries(seen, hours).collect()} == {8: False, 9: True, 12: True, 17: False, 18: True}
    none = frame(spark, [], "list string, value string, at date, action string")
    assert url_lists.active_entries(c, none).where("blocked").count() == 0
    assert url_lists.active_entries(frame(spark, [], "page_id long, url string, fetched_at date"), e).count() == 0


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_pipeline(spark, small, tmp_path):
    """Each stage, written and read again, keeps what its operator says; the last one encodes what is left."""
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({c: F.lit("clash") for c in ("fp", "lang_pred", "keep_id", "ids", "h")})
    start, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            known = {r.doc_id for r in langid.language_of(before).where("lang_pred <> 'und' and score >= 0.5 and known >= 0.5").collect()}
            assert ids == known
        elif name == "exact_dedup":
            assert ids == {r.doc_id for r in exact_dedup.exact_groups(before).where("kept").collect()}
            assert len(ids) == len({start[i] for i in ids})
        elif name == "simhash":
            assert ids == {r.doc_id for r in simhash.simhash_components(before).where("doc_id = component_id").collect()}
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
            assert bad and not ids & bad and ids | bad == {r.doc_id for r in before.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    back = {r.doc_id: r.text for r in pieces.decode_documents(docs).collect()}
    assert back == {i: start[i] for i in ids}


def test_pipeline_of_nothing(spark, tmp_path, small):
    empty = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert empty.count() == 0
