"""What the corpus operators share: reading tables, cutting lineage, words and stable row keys."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Rows in one Arrow batch sent to a Python worker; documents can be long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers get its rows in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: the session's setting; where there is none, a local master gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            folder = tempfile.mkdtemp(prefix="checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def fold(key: Column, parts: int) -> Column:
    """The fold of a row: crc32 of the key's text, modulo parts; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def word_count(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampled(docs: DataFrame, labels: DataFrame, train: Column, of: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of about of[label] training documents for each label; labels has doc_id and label, one row each."""
    mine = labels.where(train)
    counts = {row.label: row["count"] for row in mine.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 40))
    few = None
    for label, wanted in of.items():
        part = mine.where((F.col("label") == label) & (place < int((1 << 40) * min(1.0, wanted / max(1, counts.get(label, 0)))))).limit(2 * wanted)
        few = part if few is None else few.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most twice the sample's rows


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One row of doc_id and label (0 or 1) for each labelled id."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
