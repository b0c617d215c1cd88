"""Incremental delivery: run-and-stop ingestion, re-delivery collapse, and episodes kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricetide.operators.episodes import MAX_GAP_DAYS, Fold, State
from pricetide.plans.versions import VersionedTable

EPISODES = "product_id long, start_day date, start_seq long, price double, end_day date, observations_count long, is_trusted boolean, is_outlier boolean"
_STATE = "price double, end int, trusted boolean, outlier boolean, start_day int, start_seq long, n long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = pa.schema([("day", pa.date32()), ("end_day", pa.date32()), ("from_day", pa.date32()), ("seq", pa.int64()), ("price", pa.float64()), ("trusted", pa.bool_()), ("outlier", pa.bool_())])


def ingest(spark: SparkSession, landing: str, schema: str, checkpoint: str,
           merge: Callable[[DataFrame, int], None]):
    """Pick up new payload files, hand each micro-batch to a keyed merge, and stop when caught up."""
    src = spark.readStream.schema(schema).json(landing)
    return (
        src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_into(table: VersionedTable, landing: str, schema: str, checkpoint: str, stream: str,
                merge: Callable[[DataFrame, DataFrame], DataFrame], empty: str):
    """Pick up new payload files and merge each micro-batch into a table exactly once, however often it is delivered; stop when caught up."""
    return ingest(table.spark, landing, schema, checkpoint, lambda batch, i: table.merge_batch(batch, stream, i, merge, empty))


def collapse_redelivered(deals: DataFrame, event_time: str = "recorded_at", delay: str = "14 days") -> DataFrame:
    """Tiles delivered again within the delay pass once."""
    return deals.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["flyer_id", "product_id", "raw_deal_id"])


class RunningEpisode(StatefulProcessor):
    """A product's current episode as value state; a micro-batch's rows of the product go on from it in one step."""

    def __init__(self, max_gap_days: int):
        self.max_gap = max_gap_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("episode", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        whole = pa.Table.from_pandas(batch[_ROWS.names], _ROWS, preserve_index=False).sort_by([("day", "ascending"), ("seq", "ascending")])
        before, n_before = None, 0
        if self.state.exists():
            price, end, trusted, outlier, day, seq, n_before = self.state.get()
            before = State(price, end, trusted, outlier, True, day, seq)
        fold = Fold(whole.combine_chunks().to_batches()[0], [], self.max_gap)
        n = whole.num_rows
        marks = fold.run(0, n, before)
        last = np.flatnonzero(np.append(marks["first"][1:] != marks["first"][:-1], True))  # the last row of each episode in the batch
        counts = np.diff(last, prepend=-1)
        ends = [(fold.after(0, int(i) + 1, before, {k: v[: i + 1] for k, v in marks.items()}), int(c) + (n_before if marks["first"][i] < 0 else 0)) for i, c in zip(last, counts, strict=True)]
        state, total = ends[-1]
        self.state.update((state.price, state.end, state.trusted, state.outlier, state.start_day, state.start_seq, total))
        day = lambda x: np.datetime64(x, "D").astype(object)
        yield pd.DataFrame([(key[0], day(s.start_day), s.start_seq, s.price, day(s.end), c, s.trusted, s.outlier) for s, c in ends], columns=[x.split()[0] for x in EPISODES.split(", ")])

    def close(self) -> None:
        pass


def running_episodes(obs: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """Episodes per product as observations arrive, by the rules of ``cluster_episodes``: sticky trust and doorbuster marks, ends that are kept.

    Input: the columns of ``history_rows`` with product_id; a product's batches come in order of time.  Every batch emits the episodes it touched
    as they are after it, so the last row of (product, start day, start id) is current.  Needs the RocksDB state store, which is set for the session.
    """
    obs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return obs.select("product_id", *_ROWS.names).groupBy("product_id").transformWithStateInPandas(RunningEpisode(max_gap_days), EPISODES, "Update", "None")


def session_episodes(obs: DataFrame, event_time: str = "ts", gap: str = "10 days") -> DataFrame:
    """Gap-only episodes: sessions of one product at one price."""
    return obs.withWatermark(event_time, gap).groupBy(
        "product_id", "price", F.session_window(event_time, gap).alias("w")).agg(F.count("*").alias("observations_count")).select(
        "product_id", "price", F.col("w.start").alias("started"), "observations_count")
