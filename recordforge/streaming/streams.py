"""Incremental runs with Structured Streaming."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from recordforge.functions.names import free_names

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_run(source: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Works off what has arrived; a stopped run goes on where it was.

    A batch overwrites its own folder, so that a batch that is tried again
    leaves no second copy.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@contextlib.contextmanager
def running(source: DataFrame, out: str, checkpoint: str) -> Iterator[StreamingQuery]:
    """Keeps appending what a stream gives to `out`, a folder for each batch, until the block ends. A batch
    that is tried again writes over its own folder."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    try:
        yield stream
    finally:
        stream.stop()


class TopicPlaces(StatefulProcessor):
    """Counts the values of each topic; tells each row how many came before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        for frame in rows:
            yield pd.DataFrame({"topic": key[0], "idx": frame["idx"], "value": frame["value"], "earlier": range(n, n + len(frame))})
            n += len(frame)
        self.seen.update((n,))

    def close(self) -> None:
        pass


class TopicMemory(StatefulProcessor):
    """Keeps the values of each topic in slices of `size`; gives each slice that a batch adds to, whole.

    The state is a count and a map from slice to values, so a topic of any length is many small entries,
    and a batch reads the one slice that is not full. Values of one batch are taken in the order of idx.
    """

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.slices = handle.getMapState("slices", "slice long", "history array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        # A topic's rows of one batch, which the stream's own limits bound.
        fresh = pd.concat([frame[["idx", "value"]] for frame in rows]).sort_values("idx", kind="stable")["value"]
        values = [None if pd.isna(v) else v for v in fresh]
        first = n // self.size
        held = list(self.slices.getValue((first,))[0]) if n % self.size else []
        values, n = held + values, n + len(values)
        for lo in range(0, len(values), self.size):
            part = values[lo : lo + self.size]
            self.slices.updateValue((first + lo // self.size,), (part,))
            yield pd.DataFrame({"topic": [key[0]], "slice": [first + lo // self.size], "history": [part]})
        self.count.update((n,))

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """Marks all rows of a key but the first: rows of later batches, and in the first batch those with a larger order."""

    def __init__(self, order: str, columns: Sequence[str], ttl: int | None) -> None:
        self.order, self.columns, self.ttl = order, list(columns), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, best = self.seen.exists(), None
        for frame in rows:
            # Frames come with some names replaced (those that begin with an underscore), and end with the key.
            frame = frame.iloc[:, : len(self.columns)].set_axis(self.columns, axis=1)
            if known:
                yield frame.assign(duplicate=True)
                continue
            # Only the rows that may still be the first are held; the others are told at once.
            unordered = frame[self.order].isna()
            if unordered.any():
                yield frame[unordered].assign(duplicate=False)
            both = frame[~unordered] if best is None else pd.concat([best, frame[~unordered]])
            first = both[self.order] == both[self.order].min()
            best = both[first]
            if not first.all():
                yield both[~first].assign(duplicate=True)
        if not known:
            self.seen.update((True,))
            if best is not None and len(best):
                yield best.assign(duplicate=False)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for streams that are started within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def stream_topic_places(source: DataFrame) -> DataFrame:
    """topic, idx, value and earlier: how many values of the topic had arrived before.

    The state is one number for each topic, whatever its length. All values that
    a row may look back on are the rows of its topic with a smaller `earlier`.
    Start the query within `rocks_db`.
    """
    return source.select("topic", "idx", "value").groupBy("topic").transformWithStateInPandas(TopicPlaces(), "topic string, idx long, value string, earlier long", "Append", "None")


def stream_topic_memory(source: DataFrame, size: int = 1000) -> DataFrame:
    """topic, slice and history: the slices of a topic's values that each batch adds to; the longest of a slice is its last.

    `latest_slices` of all that was given equals `topic_history` where batches come in
    the order of idx. Start the query within `rocks_db`.
    """
    return source.select("topic", "idx", "value").groupBy("topic").transformWithStateInPandas(TopicMemory(size), "topic string, slice long, history array<string>", "Append", "None")


def latest_slices(slices: DataFrame) -> DataFrame:
    """The last state of each slice that `stream_topic_memory` gave."""
    return slices.groupBy("topic", "slice").agg(F.max_by("history", F.size("history")).alias("history"))


def stream_first_rows(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key ever seen; duplicates are left out."""
    return source.dropDuplicates(list(keys))


def stream_mark_duplicates(source: DataFrame, keys: Sequence[str], order: str = "idx", ttl_ms: int | None = None) -> DataFrame:
    """Adds duplicate: the same keys came in an earlier batch, or in this one with a smaller `order`.

    The state is one flag for each 128-bit hash of the keys; with `ttl_ms` it is forgotten after that time
    without the key. No batch looks at what was written before. A hot key is one state and one pass over its rows
    of the batch, of which only those that may be the first are held. Start the query within `rocks_db`.
    """
    (key,) = free_names(source.columns, "_key")
    hashed = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    kept = source.drop("duplicate")
    schema = T.StructType([*kept.schema.fields, T.StructField("duplicate", T.BooleanType())])
    processor = FirstSeen(order, kept.columns, ttl_ms)
    return kept.withColumn(key, hashed).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


def progress(attempts: DataFrame, width: str = "3 seconds", time: str = "ts", status: str = "status", late: str | None = None) -> DataFrame:
    """Counts per window and status; the same for batch and stream (with a watermark `late`)."""
    rows = attempts.withWatermark(time, late) if late else attempts
    window: Column = F.window(time, width)
    return rows.groupBy(window.alias("_w"), status).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("window_start"), status, "n")


def stream_progress(source: DataFrame, out: str, checkpoint: str, **how) -> None:
    """Keeps the counts of `progress` up to date: `out` holds those of all that has arrived."""

    def one(counts: DataFrame, batch_id: int) -> None:
        counts.write.mode("overwrite").parquet(out)

    progress(source, **how).writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
