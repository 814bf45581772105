"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; runs of other characters than letters become one space; its character 2- and 3-grams are hashed
into BUCKETS counts. Training counts come from at most TRAIN_DOCS documents of each language in expectation (a bounded
sample by a hash of doc_id; whole texts). The log-probability matrix, BUCKETS x languages of 4 bytes, is broadcast;
its size is checked against MODEL_BYTES, by the number of languages before any is collected. A batch of texts is a sparse
matrix of texts by buckets, whose product with the model is formed a few thousand entries at a time.

The posterior is over the learned languages alone, so a text in another language gets one of them as well. The filter
therefore also asks for evidence: at least KNOWN of a text's n-grams have to be seen in its language.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0; so is every text if nothing
could be learned. Rows without lang or doc_id are scored but not learned from; a null doc_id isn't held out. Ties go to
the language that sorts first. Repeated rows each count and each get a row; ids are handed on as they are. Further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import crc_mod, id_type, lean, small_batches, trim

BUCKETS = 1 << 16
TRAIN_DOCS = 4_000
SMOOTHING = 0.5
MODEL_BYTES = 256 << 20
UNKNOWN = "und"
#: Share of the n-grams of a text that must have been seen in its language for the filter to keep it.
KNOWN = 0.5
#: Values of the product of texts and model that are held at once, and bytes of the texts that are scored together.
VALUES = 1 << 18
TOGETHER = 1 << 18
#: Characters handled at once; longer texts go piece by piece, with the overlap that 3-grams need.
PIECE = 1 << 20

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the text's 2- and 3-grams, piece by piece; nothing if it has no letter."""
    if not text:
        return
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter()[points]
    if not letter.any():
        return
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.where(letter, points, np.uint32(32))[keep]
    x = np.concatenate([np.array([32], dtype=np.uint32), x])
    for i in range(0, len(x) - 1, PIECE):
        part = x[i : i + PIECE + 2]
        a, b = part[:-1], part[1:]
        two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + part[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
        if i + PIECE + 2 <= len(x):
            two = two[:-1]
        for h in (two, three):
            yield ((h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text): counts by language and bucket."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in grams(text):
                if lang not in held:
                    if len(held) >= 100:
                        yield from out()
                    held[lang] = np.zeros(BUCKETS, dtype=np.int64)
                held[lang] += np.bincount(part, minlength=BUCKETS)
    yield from out()


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, per_lang: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bucket, the last row being the prior. key: chooses the sample."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col(lang_col).isNotNull())
    most = MODEL_BYTES // (4 * BUCKETS)
    found = rows.groupBy(lang_col).count().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages: the matrix would exceed {MODEL_BYTES} bytes")
    sizes = {r[0]: r[1] for r in found}
    chosen = F.pmod(F.xxhash64(F.lit("sample"), key if key is not None else F.col("doc_id")), F.lit(1 << 20))
    shares = [F.lit(x) for lang, n in sizes.items() for x in (lang, -(-(per_lang << 20) // n))]
    share = F.try_element_at(F.create_map(*shares), F.col(lang_col)) if shares else F.lit(0)
    sample = rows.where(chosen < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = sample.mapInArrow(lean(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        counts[counted["bucket"], np.searchsorted(langs, counted["lang"])] = counted["n"]
    model = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS))
    prior = np.log(np.array([sizes[x] for x in langs], dtype=float) / max(1, sum(sizes[x] for x in langs)))
    return langs, np.vstack([model, prior]).astype(np.float32)


def entries(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, n): the sparse matrix of some texts, in parts; a text of over TOGETHER bytes goes piece by piece."""
    rows, held, size = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.repeat(np.array(rows, dtype=np.int64), [len(x) for x in held]) * BUCKETS + np.concatenate(held)
        key, n = np.unique(flat, return_counts=True)
        return key // BUCKETS, key % BUCKETS, n

    for i, text in enumerate(texts):
        for part in grams(text):
            rows.append(i)
            held.append(part.astype(np.int64))
            size += len(part)
            if size >= TOGETHER:
                yield out()
                rows, held, size = [], [], 0
    if held:
        yield out()


def predict(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and share of known n-grams of each text."""
    m, n_langs = len(texts), len(langs)
    total, sizes, known = np.zeros((m, n_langs)), np.zeros(m), np.zeros((m, n_langs))
    if not langs:
        return [UNKNOWN] * m, np.zeros(m), np.zeros(m)
    matrix, prior = model[:-1], model[-1]
    unseen = matrix.min(axis=0)
    step = max(1, VALUES // n_langs)
    for row, bucket, n in entries(texts):
        sizes += np.bincount(row, n, m)
        for i in range(0, len(row), step):
            at, part, count = row[i : i + step], matrix[bucket[i : i + step]], n[i : i + step, None]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            total[at[first]] += np.add.reduceat(part.astype(np.float64) * count, first, axis=0)
            known[at[first]] += np.add.reduceat((part > unseen) * count, first, axis=0)
    total += prior
    best = total.argmax(axis=1)
    every = np.arange(m)
    score = 1 / np.exp(total - total[every, best][:, None]).sum(axis=1)
    said = sizes > 0
    return [langs[b] if s else UNKNOWN for b, s in zip(best, said, strict=True)], np.where(said, score, 0.0), np.where(said, known[every, best] / np.maximum(sizes, 1), 0.0)


def _scorer(held) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = held.value
        for batch in batches:
            found, scores, known = predict(batch.column(2).to_pylist(), langs, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores), pa.array(known)], names=["doc_id", "held_out", "lang_pred", "score", "known"])

    return score


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, known) of every row; learned from rows whose crc32(doc_id) mod folds isn't held."""
    fold = crc_mod(id_col, folds)
    langs, model = train(docs.where(fold != held), lang_col, text_col, F.col(id_col))
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_scorer(shared)), f"doc_id {id_type(docs, id_col)}, held_out boolean, lang_pred string, score double, known double")


def keep_languages(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", known: float = KNOWN) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known: with a probability of ``least`` or more, and
    with at least ``known`` of the text's n-grams seen in that language."""
    langs, model = train(docs.where(crc_mod(id_col, 3) != 1), lang_col, text_col, F.col(id_col))
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    @F.pandas_udf("boolean")
    def fits(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        found, scores, seen = predict(list(texts), *shared.value)
        trim()
        return pd.Series((scores >= least) & (seen >= known) & np.array([x != UNKNOWN for x in found], dtype=bool), index=texts.index)

    return docs.where(fits(F.col(text_col).cast("string")))
