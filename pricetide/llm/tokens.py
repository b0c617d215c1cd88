"""Token counts by a map-side two-tier lookup.

The vocabulary has no piece in which anything stands before a space mark or beside a line feed, so a text's count is the sum of the
counts of its pre-tokens: a run of space marks with what follows, the start of a line, or one line feed. The lengths of frequent
pre-tokens are broadcast as a table of bounded size; what it misses is encoded once and kept in a cache of the worker. Counting is one
narrow pass; only the table's bounded sample is ever grouped.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
PRE_TOKENS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
LIMIT = 4096
#: The frequent table: entries, letters in an entry, and documents (by hash, about so many at any size) from which it is made.
ENTRIES, LETTERS, SAMPLE = 32_768, 32, 4_000
#: Entries in a worker's cache of misses, letters in an entry.
CACHED, CACHED_LETTERS = 200_000, 64


class Counts:
    """Counts by pre-token: the frequent table first, then this worker's cache, then the tokenizer."""

    def __init__(self, model: str, frequent: dict[str, int]):
        import public_tokenizers
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.frequent, self.cache = frequent, {}

    def encode(self, unit: str) -> int:
        if unit == MARK:
            return 1
        if unit[0] == MARK:
            return len(self.pieces.encode(unit[1:], num_threads=1))
        return len(self.pieces.encode("\n" + unit, num_threads=1)) - 2  # the mark put before any text, and the line feed

    def missed(self, unit: str) -> int:
        if (n := self.cache.get(unit)) is None:
            n = self.encode(unit)
            if len(unit) <= CACHED_LETTERS:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[unit] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        units = PRE_TOKENS.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.frequent.get, units))
        if None in found:
            missed = self.missed
            return sum(missed(unit) if n is None else n for unit, n in zip(units, found, strict=True))
        return sum(found)


def frequent_lengths(docs: DataFrame, model: str = MODEL, entries: int = ENTRIES, sample: int = SAMPLE) -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample with their token counts; it decides speed alone, never a result."""
    rows = docs.count()
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 48)) < int((1 << 48) * min(1.0, sample / max(rows, 1)))).select("text")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(x for x in PRE_TOKENS.findall(MARK + text.replace(" ", MARK)) if len(x) <= LETTERS)
        for at in range(0, len(seen), 1 << 16):
            part = list(seen.items())[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part], pa.int64())], names=["unit", "n"])

    top = few.mapInArrow(units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(entries)
    counts = Counts(model, {})
    return {row.unit: counts.encode(row.unit) for row in top.collect()}


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """n_bytes, n_tokens and over_limit of each row of (doc_id, text)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(model, frequent.value)
        for batch in batches:
            n = pa.array([counts.text(x) for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes, "text")
    return kept.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
