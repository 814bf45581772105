"""Language ID, personal data, decontamination, pieces and edit-aware counts against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, edit_counts, langid, pieces, pii

CLASHES = ("id", "h", "keys", "key", "held_out", "score", "email", "edits", "item", "n", "q", "ids")


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


# Language ID


def test_languages_on_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in langid.language_of(docs.withColumn("score", F.lit(1))).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)


def test_languages_of_odd_rows(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(9)] + [(i, "der Hund und die Katze", "de") for i in range(9, 18)]
    rows += [(18, None, "en"), (19, "", "de"), (20, "123 !!", None), (None, "the dog", "en"), (21, "und die", None), (21, "und die", None), (22, "the and " * 300_000, None)]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.lang_pred, r.score) for r in langid.language_of(frame(spark, rows, "doc_id long, text string, lang string")).collect())
    assert len(got) == len(rows)
    found = {i: (x, s) for i, x, s in got}
    assert found[18] == found[19] == found[20] == ("und", 0.0)
    assert found[21][0] == "de" and found[22][0] == "en" and found[-1][0] == "en"
    assert all(0 <= s <= 1 for _, _, s in got)
    kept = langid.keep_languages(frame(spark, rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([*range(18), 21, 21, 22])
    assert langid.language_of(frame(spark, [], "doc_id long, text string, lang string")).count() == 0
    alone = langid.language_of(frame(spark, [(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]


def test_plain_naive_bayes(spark, small):
    """The same languages and scores from counts in dictionaries."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None]
    counts, total = defaultdict(Counter), Counter(r.lang for r in rows)
    for r in rows:
        for part in langid.grams(r.text):
            counts[r.lang].update(part.tolist())
    sums = {x: sum(c.values()) for x, c in counts.items()}

    def plain(text):
        found = Counter(g for part in langid.grams(text) for g in part.tolist())
        if not found:
            return "und", 0.0
        logs = {x: math.log(total[x] / sum(total.values())) + sum(n * math.log((c[g] + langid.SMOOTHING) / (sums[x] + langid.SMOOTHING * langid.BUCKETS)) for g, n in found.items()) for x, c in sorted(counts.items())}
        best = max(logs, key=logs.get)
        return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())

    short = [(i, t) for i, t in enumerate(["th", "der", "que le", "ing ei", "la", "x", "", None, "un de la ou", "an", "a-b", "é"])]
    odd = frame(spark, short, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).select("doc_id", "text", "lang")
    for found in (langid.language_of(docs), langid.language_of(docs.select("doc_id", "text", "lang").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100_000)))):
        texts = {r.doc_id: r.text for r in docs.collect()} | {i + 100_000: t for i, t in short}
        for r in found.collect():
            lang, score = plain(texts[r.doc_id])
            assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-3, abs_tol=1e-9)


def test_a_language_that_was_not_learned_goes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    foreign = frame(spark, [(900_001, "Съешь же ещё этих мягких французских булок"), (900_002, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία"), (900_003, "xkcd qwrtpsdf zxcvbnm lkjhgfds"), (900_004, None)]).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    kept = {r.doc_id for r in langid.keep_languages(docs.unionByName(foreign)).collect()}
    assert not kept & {900_001, 900_002, 900_003, 900_004}
    assert kept == {r.doc_id for r in docs.collect()}


def test_parts_of_the_matrix_change_nothing(monkeypatch):
    langs, model = ["a", "b"], np.log(np.random.default_rng(1).random((langid.BUCKETS + 1, 2))).astype(np.float32)
    texts = ["abc def ghij " * 50, None, "", "x", "lorem ipsum " * 9]
    whole = langid.predict(texts, langs, model)
    monkeypatch.setattr(langid, "VALUES", 14)
    monkeypatch.setattr(langid, "TOGETHER", 30)
    monkeypatch.setattr(langid, "PIECE", 37)
    again = langid.predict(texts, langs, model)
    assert again[0] == whole[0] and np.allclose(again[1], whole[1]) and np.allclose(again[2], whole[2])


def test_ids_of_text(spark):
    rows = spark.createDataFrame([("abc", "the cat 1.2.3.4", "en"), ("abd", "the cat 1.2.3.4", "en"), (None, "x", None)], "doc_id string, text string, lang string")
    assert {r.doc_id: r.n_ip for r in pii.digest(pii.personal_data(rows)).collect()} == {"abc": 1, "abd": 1, None: 0}
    assert {r.doc_id for r in langid.language_of(rows).collect()} == {"abc", "abd", None}


def test_pieces_of_a_long_text_are_counted_once(monkeypatch):
    text = "abc def ghij " * 50
    whole = sorted(x for part in langid.grams(text) for x in part.tolist())
    monkeypatch.setattr(langid, "PIECE", 37)
    assert sorted(x for part in langid.grams(text) for x in part.tolist()) == whole


# Personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def digest(base):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()


def test_personal_data(spark, small):
    rnd = random.Random(4)
    bits = ["a@b.co", "x_y@d.e.f", "@", "1.2.3.4", "256.1.1.1", "001.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", " ", "é", "😀", "4", "-", ".", "5500005555555559", "%", "a" * 30, "12 3"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for i in range(400)]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, "a" * 200_000), (5003, "1" * 100_000), (5003, "1" * 100_000), (5004, "a@b.c_d@e.f g@h"), (None, "a@b.co")]
    got = {(r.doc_id, r.base_sha256): r for r in pii.digest(pii.personal_data(frame(spark, rows))).collect()}
    for i, t in rows:
        base = plain_base(t)
        r = got[i, digest(base)]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in PLAIN)
        assert [x for x in r.spans.split(",") if x and x.split(":")[0] in PLAIN] == [f"{k}:{s}:{e}" for k, s, e in base]
    assert pii.digest(pii.personal_data(frame(spark, []))).count() == 0


def test_many_spans_in_one_text(spark):
    """Places and contexts over many blocks and pieces; twice the matches take about twice the time."""
    rnd = random.Random(12)
    text = "".join(rnd.choice(["a@b.co ", "1.2.3.4 ", "call +49 30 1234567 ", "é😀 ", "x" * rnd.randint(1, 90) + " ", "4111 1111 1111 1111, "]) for _ in range(9_000))
    base = plain_base(text)
    got = pii.digest(pii.personal_data(frame(spark, [(1, text)]))).first()
    assert len(base) > 4_000 and got.base_sha256 == digest(base)
    phones = [x for x in got.scores.split(",") if x.startswith("phone")]
    assert phones == [f"phone:{s}:{e}:{80 if re.search(pii.CONTEXT['phone'], (text[max(0, s - 40) : s] + ' ' + text[e : e + 20]).lower()) else 50}" for k, s, e in base if k == "phone"]
    times = []
    for n in (8_000, 16_000):
        rows = frame(spark, [(1, "a@b.co 1.2.3.4 " * n)])
        began = time.monotonic()
        assert pii.digest(pii.personal_data(rows)).first().n_ip == n
        times.append(time.monotonic() - began)
    assert times[1] < 3 * times[0] + 5


def test_added_kinds_and_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "DE88 3704 0044 0532 0130 00"), (3, "ssn 123-45-6789"), (4, "123-45-6789"), (5, "call +49 30 1234567"), (6, "xx +49 30 1234567")]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.digest(pii.personal_data(frame(spark, rows))).collect()}
    assert got[1][0] == "iban:5:32" and got[1][1] == "iban:5:32:95"
    assert got[2][0] == "" and got[4][0] == ""
    assert got[3][0] == "ssn:4:15"
    assert got[5][1].endswith(":80") and got[6][1].endswith(":50")


# Decontamination


@pytest.mark.parametrize("n", range(10, 22))
def test_masks_meet_any_fifth_of_substitutions(n):
    offsets = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS[10]]
    for gone in itertools.combinations(range(n), n // 5):
        assert any(all(s + x not in gone for x in o) for o in offsets for s in range(n - o[-1]))


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_contaminated(docs, items):
    out = set()
    for (d, t), (i, b) in itertools.product(docs, items):
        x, y = plain_words(t), plain_words(b)
        if not y:
            continue
        wide = min(len(y), decontaminate.WINDOW)
        for m in decontaminate.masks_of(len(y)):
            ones = [k for k, c in enumerate(m) if c == "1"]
            for q in range(len(y) - len(m) + 1):
                for p in range(len(x) - len(m) + 1):
                    if all(x[p + k] == y[q + k] for k in ones):
                        block = q // decontaminate.WINDOW * decontaminate.WINDOW
                        first, last = max(0, block - decontaminate.WINDOW + 1), min(len(y), block + 2 * decontaminate.WINDOW - 1)
                        same = [any(0 <= p - q + j + k < len(x) and first - 2 <= j + k < last + 2 and x[p - q + j + k] == y[j] for k in range(-2, 3)) for j in range(first, last)]
                        if max(sum(same[k : k + wide]) for k in range(len(same) - wide + 1)) >= decontaminate.LEAST * wide:
                            out.add((d, i))
    return out


def test_decontamination(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 12, 20, 45, 80])))) for i in range(14)]
    items[0], items[1] = (0, "W1 alone9"), (1, "w2 w3 w4 four9")
    docs = []
    for d in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if d % 2:
            part = rnd.choice(items)[1].split()
            for _ in range(rnd.choice([0, 1, len(part) // 5, len(part) // 3])):
                part[rnd.randrange(len(part))] = "other"
            at = rnd.randint(0, len(words))
            words[at:at] = part
        docs.append((d, ", ".join(words).upper()))
    long = [f"u{k}" for k in range(59)]
    items += [(50, None), (51, ""), (52, " ".join(long)), (53, "answer is forty two"), (54, "lone7")]
    part = [w if k not in (5, 9, 13, 17) else "gone" for k, w in enumerate(long)][3:28]
    docs += [(100, None), (101, ""), (102, items[4][1]), (102, items[4][1]), (103, " ".join(part)), (104, "so the answer is forty two ."), (105, "the answer is forty or two"), (106, "a lone7 word"), (107, "x " * 100_000 + " ".join(long[:40]))]
    found = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_contaminated(docs, items)
    assert {(103, 52), (104, 53), (106, 54), (107, 52)} <= set(got) and (105, 53) not in got
    nameless = decontaminate.drop_contaminated(frame(spark, [(None, "so the answer is forty two"), (None, "clean"), (7, "clean"), (7, "lone7")]), frame(spark, items, "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in nameless.collect()) == [(0, "clean"), (7, "clean")]
    stay = decontaminate.drop_contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert {r.doc_id for r in stay.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert stay.columns == frame(spark, docs).columns
    assert decontaminate.contaminated(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), frame(spark, [], "item_id long, text string")).count() == 0


def test_blocks_of_the_benchmark_change_nothing(spark, small, monkeypatch):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 900)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == whole
    exact = docs.crossJoin(items.select("item_id", F.col("text").alias("x"))).where(F.contains("text", "x")).select("doc_id", "item_id").collect()
    assert exact and {tuple(r) for r in exact} <= {r[:2] for r in whole}


# Pieces


@pytest.fixture(scope="module")
def model():
    with open(pieces.model_path(), "rb") as f:
        return pieces.Pieces(f.read(), 4)


def every_segmentation(model, text):
    shown = text.replace(pieces.SPACE, "\0").replace(" ", pieces.SPACE)

    def go(i):
        if i == len(shown):
            yield 0.0, ()
            return
        known = False
        for j in range(i + 1, len(shown) + 1):
            if (got := model.piece.get(shown[i:j])) is not None:
                known = known or j == i + 1
                for s, ids in go(j):
                    yield got[1] + s, (got[0], *ids)
        if not known:
            ids = tuple(model.byte_id[b] for b in text[i].encode())
            for s, more in go(i + 1):
                yield model.unknown + s, ids + more

    return sorted(go(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["hello world", "a", "  x", "\n", "ab\ncd  é", "😀▁ ok", "the cat!", "ünter de", "\0 a"])
def test_n_best(model, text):
    want = every_segmentation(model, " " + text)
    ids, score, others = model.encode(text)
    scores = dict((x, s) for s, x in want)
    assert [score, *(s for s, _ in others)] == [s for s, _ in want[:4]]
    assert scores[tuple(ids)] == score
    assert all(scores[tuple(pieces.edited(ids, e))] == s for s, e in others)
    assert len({tuple(ids), *(tuple(pieces.edited(ids, e)) for _, e in others)}) == 1 + len(others)
    assert all(model.decode(x) == text for x in (ids, *(pieces.edited(ids, e) for _, e in others)))


def test_pieces_of_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "x" * 30_000), (-3, "x" * 30_000), (-4, "▁▁ \t\r\n　 ﬁ é")]
    encoded = pieces.encode_documents(frame(spark, rows))
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.exact and r.n_tokens == len(r.ids) for r in got)
    back = {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert pieces.encode_documents(frame(spark, [])).count() == 0


def test_search_and_joint_solution_agree(model):
    rnd = random.Random(8)
    words = {"".join(rnd.choice("aeinrst éü.") for _ in range(rnd.randint(1, 20))) for _ in range(400)}
    words = [" " + w.replace(" ", "") for w in words]
    sizes, scores, gaps, back, ids = model.solve(words)
    assert back.all() and sizes.sum() == len(ids)
    for w, score, gap in zip(words, scores, gaps, strict=True):
        found = model.search(w, 2)
        assert score == found[0][0]
        assert gap == (found[0][0] - found[1][0] if len(found) > 1 else float("inf"))


# Edit-aware counts


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    with open(public_tokenizers.path(edit_counts.RANKS), "rb") as f:
        return edit_counts.Encoder(f.read(), public_tokenizers.PATTERN)


def test_edits_give_what_counting_anew_gives(encoder):
    rnd = random.Random(9)
    bits = ["a", "foo", " ", "  ", "\n", "\n\n  ", "'s", "'", " the", "12", "é", "!!", " bar'll", "\t", "😀"]
    for trial in range(300):
        text = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 3, 50, 600])))
        tree = edit_counts.CountTree(encoder, text)
        for _ in range(6):
            a = rnd.randint(0, len(text))
            b = min(len(text), a + rnd.choice([0, 0, 1, 2, 5, 60, 300]))
            new = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 2, 5, 400 if trial % 20 == 0 else 3])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            want = encoder.split(text)
            assert tree.text() == text and [p for x, _ in tree.blocks for p in x] == want
            assert (tree.chars[1], tree.tokens[1], tree.pieces[1]) == (len(text), sum(encoder.counts(want)), len(want))


def test_edits_touch_little(encoder):
    tree = edit_counts.CountTree(encoder, "word " * 20_000)
    tree.edit(50_000, 50_005, "other ")
    assert tree.reencoded < 12


def test_edited_documents(spark, encoder):
    docs = [(1, "Hello world, it's me"), (2, None), (3, ""), (4, "same"), (4, "same"), (5, "a b c " * 5000)]
    edits = [(1, 1, 0, 5, "Bye"), (1, 0, 5, 6, "  "), (2, 0, 0, 0, "new text"), (3, 0, None, 9, None), (9, 0, 0, 1, "x"), (5, 0, 3, 3, "Z"), (5, 1, 29_000, 40_000, "")]
    got = edit_counts.edited_token_counts(frame(spark, docs), spark.createDataFrame(edits, "doc_id long, seq long, start long, stop long, new string")).collect()
    assert len(got) == len(docs)
    after = {1: "Bye  world, it's me", 2: "new text", 3: "", 4: "same", 5: ("a b" + "Z" + " c " + "a b c " * 4999)[:29_000]}
    for r in got:
        want = encoder.split(after[r.doc_id])
        assert (r.n_tokens_after, r.n_pretokens_after, r.chars_after) == (sum(encoder.counts(want)), len(want), len(after[r.doc_id]))
    assert edit_counts.edited_token_counts(frame(spark, []), spark.createDataFrame([], "doc_id long, seq long, start long, stop long, new string")).count() == 0
