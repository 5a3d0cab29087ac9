"""Language identification by bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of the n-grams typical of it. The filters share their
hashes and are stored sliced: a slot holds one bit a language, so ANDing the few slots of an
n-gram returns the mask of all languages that contain it. A text's n-grams are counted per
language; each count is corrected for the share of false positives that the filter's fill
predicts; the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash63, kept, settle, share_bound, trim, trimmed

NGRAM = 4
SLOTS = 1 << 20
HASHES = 3
#: Labelled rows of each language that the filters are fitted on: about so many, by hash of the id.
TRAIN_ROWS = 2000
#: An n-gram is typical of a language if it is this frequent in it, which also bounds the n-grams
#: of a language to the inverse, and not much rarer than in any other language.
MIN_SHARE = 1e-5
MIN_RATIO = 0.3
#: Characters handled at a time, which bounds the memory of a very long text.
BLOCK = 1 << 18

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xFF51AFD7ED558CCD)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _hashed(points: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of a row of letters and blanks."""
    mixed = points[: len(points) - NGRAM + 1].copy()
    for k in range(1, NGRAM):
        mixed = mixed * _MULTIPLY + points[k : len(points) - NGRAM + 1 + k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _FOLD
    return mixed ^ (mixed >> np.uint64(32))


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams; runs of anything but letters count as one blank.

    A text is taken in blocks. What an n-gram needs of the block before is carried over, so
    the n-grams don't depend on where blocks end.
    """
    text = text.lower()
    blank = np.full(1, 32, np.uint64)
    carried, after_letter, found = blank, False, False
    for start in range(0, len(text), BLOCK):
        points = np.frombuffer(text[start : start + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[points]
        kept = letter | np.append(after_letter, letter[:-1])
        after_letter, found = bool(letter[-1]), found or bool(letter.any())
        row = np.concatenate((carried, np.where(letter, points, 32)[kept].astype(np.uint64)))
        carried = row[1 - NGRAM :]
        if len(row) >= NGRAM:
            yield _hashed(row)
    if found:
        yield _hashed(np.concatenate((carried, np.repeat(blank, NGRAM - 1))))


def _slots(hashes: np.ndarray, slots: int, n: int) -> Iterator[np.ndarray]:
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    for k in range(n):
        yield ((low + np.uint64(k) * high) & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class Filters:
    """Bit-sliced filters: ``table[slot]`` has a bit for each language, 8 to a byte."""

    languages: list[str]
    prior: int = 0
    slots: int = SLOTS
    hashes: int = HASHES
    table: np.ndarray = field(default=None)
    false: np.ndarray = field(default=None)

    def build(self, grams: np.ndarray, language: np.ndarray) -> Filters:
        self.table = np.zeros((self.slots, -(-max(1, len(self.languages)) // 8)), np.uint8)
        for at in _slots(grams, self.slots, self.hashes):
            np.bitwise_or.at(self.table, (at, language // 8), (1 << (language % 8)).astype(np.uint8))
        fill = self._per_language(self.table) / self.slots
        self.false = fill**self.hashes
        return self

    def _per_language(self, masks: np.ndarray) -> np.ndarray:
        """How many of the masks have each language's bit."""
        counts = [np.bincount(column, minlength=256) @ _BITS for column in masks.T]
        return np.concatenate(counts)[: len(self.languages)]

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """The number of n-grams, and how many of them each language's filter contains."""
        total, found = 0, np.zeros(len(self.languages), np.int64)
        for grams in ngrams(text):
            masks = None
            for at in _slots(grams, self.slots, self.hashes):
                masks = self.table[at] if masks is None else masks & self.table[at]
            total += len(grams)
            found += self._per_language(masks)
        return total, found

    def predict(self, text: str | None) -> tuple[str, float]:
        total, found = self.counts(text) if text else (0, None)
        if not total:
            return "und", 0.0
        share = np.clip((found / total - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        best = int(share.argmax())
        if share[best] == 0:
            return self.languages[self.prior], 0.0
        return self.languages[best], float(share[best] / share.sum())


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Filters:
    """Filters from labelled rows with a text; the caller leaves held-out rows out.

    About ``TRAIN_ROWS`` rows of each language are taken by hash of the id. Their n-grams are
    counted and chosen on Spark; at most ``1 / MIN_SHARE`` a language come to the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    sizes = sorted((r.lang, r["count"]) for r in known.groupBy("lang").count().collect())
    languages = [lang for lang, _ in sizes]
    if not languages:
        return Filters([])
    bounds = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, share_bound(TRAIN_ROWS, n))))
    sample = known.where(hash63("id") < bounds[F.col("lang")])
    number = {lang: i for i, lang in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("languages", lambda: None)
        for b in batches:
            held: dict[int, list] = {}
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                for grams in ngrams(text.as_py()):
                    held.setdefault(number[lang.as_py()], []).append(np.unique(grams, return_counts=True))
            for lang, parts in held.items():
                grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
                arrays = [np.full(len(grams), lang, np.int32), grams.view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["lang", "gram", "n"])

    grams = sample.select("lang", "text").mapInArrow(trimmed(counted), "lang int, gram long, n long")
    grams = settle(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals = F.create_map(*(F.lit(x) for lang, n in total.items() for x in (lang, float(n)))) if total else None
    if totals is None:
        return Filters(languages, max(range(len(sizes)), key=lambda i: sizes[i][1])).build(
            np.zeros(0, np.uint64), np.zeros(0, np.int64)
        )
    shares = grams.withColumn("share", F.col("n") / totals[F.col("lang")])
    frequent = shares.where(F.col("share") >= MIN_SHARE)
    most = frequent.groupBy("gram").agg(F.max("share").alias("most"))
    typical = frequent.join(most, "gram").where(F.col("share") >= MIN_RATIO * F.col("most"))
    chosen = typical.select("gram", "lang").toArrow()
    prior = max(range(len(sizes)), key=lambda i: sizes[i][1])
    return Filters(languages, prior).build(
        chosen["gram"].to_numpy().view(np.uint64), chosen["lang"].to_numpy().astype(np.int64)
    )


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row, from its whole text.

    A null text, or one without a letter, is ``und`` with score 0; a text none of whose
    n-grams is known gets the most frequent language with score 0; ties go to the language
    first in order. The columns ``lang_pred`` and ``score`` of ``docs``, if any, are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if not filters.languages:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))

    @F.pandas_udf("lang_pred string, score double")
    def guessed(texts):
        import pandas as pd

        kept("languages", lambda: None)
        found = pd.DataFrame([filters.predict(t) for t in texts], columns=["lang_pred", "score"])
        trim()
        return found

    # The name is free, as the column was dropped.
    guess = docs.withColumn("lang_pred", guessed(F.col(text_col).cast("string")))
    return guess.select(*docs.columns, "lang_pred.lang_pred", "lang_pred.score")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 0 by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all documents, learned from those not held out.

    A null id is not held out; it is not learned from either.
    """
    filters = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, filters).select("doc_id", "held_out", "lang_pred", "score")
