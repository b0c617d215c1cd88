"""Language identification by rank-order profiles.

A profile is the PROFILE most frequent letter n-grams (1 to 3 letters, words padded by one blank on each side) of all training texts of a
language, in order. A text's own most frequent n-grams are compared with each profile by the out-of-place distance: the difference of
ranks, or PROFILE for an n-gram that the profile lacks. The language with the least distance wins; ties go to the first by name.

Training counts n-grams per language in map tasks and sums them by key, so a language that holds most of the input is spread over tasks;
profiles have at most PROFILE rows a language and are broadcast below a checked number of languages. Prediction is one narrow pass.

Defined results: und with score 0 where the text is null or has no letter, and everywhere when nothing could be learned; null languages
teach nothing; repeated rows count and are predicted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricetide.llm.common import fold, table

PROFILE = 300
#: Languages that one broadcast may hold.
LANGUAGES = 4_096
#: Letters are code points; this one stands for the blank between words.
BLANK = 1
BITS = 21
_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the letters of a text in lower case, runs of anything else as one blank, a blank at each end; empty without letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _LETTERS[0][codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[BLANK], np.where(letter, codes, BLANK), [BLANK]])
    return codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of letters(text); a key packs up to three code points."""
    alphabet, at = np.unique(codes, return_inverse=True)
    n = len(alphabet)
    keys, counts = [], []
    for size in (1, 2, 3):
        if len(at) < size:
            break
        own = at[: len(at) - size + 1].copy()
        for k in range(1, size):
            own = own * n + at[k : len(at) - size + 1 + k]
        if n**size <= 8 * len(own) + 4096:
            total = np.bincount(own, minlength=n**size)
            found = np.flatnonzero(total)
            total = total[found]
        else:
            found, total = np.unique(own, return_counts=True)
        key = np.zeros(len(found), np.int64)
        for k in range(size):
            key |= alphabet[found // n**k % n] << (BITS * k)
        real = key != BLANK
        keys.append(key[real])
        counts.append(total[real])
    return np.concatenate(keys), np.concatenate(counts)


def top(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys in order; ties by key."""
    if len(keys) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:most]


def profiles(training: DataFrame) -> DataFrame:
    """lang, key and place (from 1) of the profile of each language of (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lang: str, keys: np.ndarray, counts: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))], names=["lang", "key", "n"])

        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts.setdefault(lang, []).append(letters(text))
            for lang, own in texts.items():
                joined = np.concatenate([x[1:] if i else x for i, x in enumerate(y for y in own if len(y))] or [np.zeros(0, np.int64)])
                if len(joined):
                    keys, counts = grams(joined)
                    if lang in sums:
                        keys, at = np.unique(np.concatenate([sums[lang][0], keys]), return_inverse=True)
                        counts = np.bincount(at, np.concatenate([sums[lang][1], counts])).astype(np.int64)
                    sums[lang] = keys, counts
            for lang in [x for x in sums if len(sums[x][0]) > 1_000_000]:
                yield out(lang, *sums.pop(lang))
        for lang, (keys, counts) in sums.items():
            yield out(lang, keys, counts)

    rows = training.where("lang is not null and text is not null").select("lang", "text").mapInArrow(counted, "lang string, key long, n long")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n")).withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "key", "place")


class Ranks:
    """Profiles as one table of keys (rows) and languages (columns): places, or none."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.names = sorted({r[0] for r in rows})
        self.keys = np.unique(np.array([r[1] for r in rows], np.int64))
        self.places = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        column = {x: i for i, x in enumerate(self.names)}
        for lang, key, place in rows:
            self.places[np.searchsorted(self.keys, key), column[lang]] = place - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = letters(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        mine = top(*grams(codes))
        at = np.searchsorted(self.keys, mine)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != mine)] = len(self.keys)
        places = self.places[at]
        distance = np.where(places < 0, PROFILE, np.abs(places - np.arange(len(mine))[:, None])).sum(0)
        best = int(distance.argmin())
        return self.names[best], 1 - float(distance[best]) / (PROFILE * len(mine))


def predict(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score of each row of (doc_id, text)."""
    if profile.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"profiles of more than {LANGUAGES} languages are too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in profile.collect()])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(shared.value)
        for batch in batches:
            found = [ranks.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = predict(docs, profiles(docs.where(~held_out).select("lang", "text")).cache())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
