"""Streaming segmentation: the fold of operators.segment with its state kept per key between micro-batches.

A stream has no end and no order of its own, so control rows travel in it: ``kind`` is data, pause,
resume or eof (see `larkstream.operators.segment`). Within a micro-batch rows are sorted by their order
column; across batches a source must deliver in order. Any split into micro-batches, and any restart
from the checkpoint, gives the batch result. A key's rows of one micro-batch are held at once, so their
number is bounded by the source's maxFilesPerTrigger or maxBytesPerTrigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkstream.operators.segment import Cutter

STATE = "open boolean, silent int, n long, length double, seq long, paused boolean"
OUT = ["seq", "n_units", "length", "reason"]


def unit(row: Row) -> tuple[str, float, list[bool]]:
    """kind, length and verdicts of a row, for `Cutter.take`: a length that is missing is 0, a missing verdict speech."""
    length = 0.0 if row.length is None or row.length != row.length else float(row.length)
    verdicts = () if row.verdicts is None else row.verdicts
    return "data" if row.kind is None else row.kind, length, [v is None or bool(v) for v in verdicts]


def segment_schema(units: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("key", units.schema["key"].dataType), *T.StructType.fromDDL("seq long, n_units long, length double, reason string").fields])


def first_numbers(units: DataFrame, seeds: DataFrame | None) -> GroupedData | None:
    """The greatest number already used by each key, one row a key, as the state that a stream begins with."""
    if seeds is None:
        return None
    key, number = F.col(seeds.columns[0]).cast(units.schema["key"].dataType), F.col(seeds.columns[1]).cast("long")
    return seeds.groupBy(key.alias("key")).agg(F.max(number).alias("max_seq")).where("max_seq is not null").groupBy("key")


class SegmentProcessor(StatefulProcessor):
    """Input: key, ord (one sortable column), length, verdicts, kind."""

    def __init__(self, silence_limit: int, least: float, greatest: float):
        self.limits = silence_limit, least, greatest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("segment", STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """The greatest number that a source has already used."""
        self.state.update((False, 0, 0, 0.0, int(initialState.max_seq), False))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        c, made, out = Cutter(*self.limits), Row("key", *OUT), []
        if (held := self.state.get()) is not None:
            c.open, c.silent, c.n, c.length, c.seq, c.paused = held
        for row in sorted(rows, key=lambda r: (r.ord is None, r.ord)):
            if done := c.take(*unit(row)):
                out.append(made(key[0], *done))
        self.state.update((bool(c.open), int(c.silent), int(c.n), float(c.length), int(c.seq), bool(c.paused)))
        return iter(out)

    def close(self) -> None:
        pass


def segment_stream(units: DataFrame, silence_limit: int, least: float, greatest: float, seeds: DataFrame | None = None) -> DataFrame:
    """units (key, ord, length, verdicts or speech, kind) as a stream of closed segments.

    `seeds` (key, max_seq) is a batch table of numbers already used, as `operators.queue.seed_numbers`
    gives it; a source goes on from its own. Start the query within `rocksdb_state`, as `run_to_end` does.
    """
    if "speech" in units.columns:
        units = units.withColumn("verdicts", F.array("speech")).drop("speech")
    given = units.select("key", "ord", F.col("length").cast("double").alias("length"), "verdicts", "kind")
    return given.groupBy("key").transformWithState(SegmentProcessor(silence_limit, least, greatest), segment_schema(units), "append", "none", first_numbers(units, seeds))


@contextmanager
def rocksdb_state(spark: SparkSession, timers_only_with_data: bool = False):
    """Queries started within keep their state in RocksDB, which keyed state needs; the session's settings come back after.

    A query with timers in processing time goes on with batches without data for ever, which one that is to end
    at the end of its data must not.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if timers_only_with_data:
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def replay(spark: SparkSession, folder: str, schema: str | T.StructType, files_per_batch: int | None = 1) -> DataFrame:
    """A recorded stream: Parquet files in order of their writing; without a number all new files are one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Writes all there is to a Parquet sink (exactly once by its checkpoint) and reads it back.

    A stopped or failed query goes on from the same checkpoint: what it had not committed is done again.
    """
    with rocksdb_state(stream.sparkSession, timers_only_with_data=True):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def fed(spark: SparkSession, parts: list[DataFrame], made: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What a stream gives of parts that come one after another, each a micro-batch of as many files as tasks have written.

    The query ends after each part and goes on from its checkpoint with the next.
    """
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        found = run_to_end(made(replay(spark, f"{folder}/in", part.schema, None)), f"{folder}/out", f"{folder}/checkpoint")
    return found


def every(stream: DataFrame, seconds: float, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A running query that hands what has arrived to `act` every so many seconds; stop() ends it between two batches."""
    with rocksdb_state(stream.sparkSession):
        return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def append_once(batch: DataFrame, batch_id: int, folder: str) -> None:
    """A foreachBatch writer that a repeated batch cannot double: each batch has its own folder, replaced whole."""
    batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that hands each batch to the first sink, which must succeed, and to views, whose errors are dropped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sinks[0](batch, batch_id)
        for view in sinks[1:]:
            try:
                view(batch, batch_id)
            except Exception:  # a view that is gone must not stop the stream
                continue

    return write


def backlog_then_live(backlog: DataFrame, live: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of both with `phase` (0: backlog, 1: live) and `place`, their rank by phase and order.

    Every backlog row comes before every live one. In a stream the same is a first batch: write the backlog
    to the folder that `replay` reads before the live rows.
    """
    from larkstream.operators.order import global_rank

    both = backlog.withColumn("phase", F.lit(0)).unionByName(live.withColumn("phase", F.lit(1)))
    return global_rank(both, F.col("phase"), *order, name="place")
