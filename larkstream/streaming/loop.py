"""The whole loop as streaming jobs: chunks from the queue are cut into segments, segments recognised, texts appended, files deleted.

`record` follows the queue of chunks: each source's state holds the samples of its open segment, what does not fill
a frame yet and the cut's own state; closed segments become WAV files through the sink, with the checkpoint
exactly once. A source that is silent for `idle_ms` has its segment closed.

`recognise` is one step over the folder of files: those whose id is not in the transcript go through gate and
recogniser, the entries are appended at once, and then the files that are done with are deleted. Each step begins
by deleting the files whose entry is there already: they are what a crash between append and deletion leaves. So
every segment has one entry, and no file stays for ever; a file of a failed recognition stays, and is tried again in the
next run. `follow` repeats the step at an interval.

A stop leaves what is open in the state and what is not recognised in the folder; a restart goes on with both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkstream.functions import audio, text
from larkstream.operators import queue
from larkstream.operators.frames import Classifier, Framer
from larkstream.operators.gate import GATE
from larkstream.operators.segment import Cutter
from larkstream.plans.process import process_segments
from larkstream.session import cut
from larkstream.sources import files, transcript, wav
from larkstream.streaming.segments import rocksdb_state

STATE = "open boolean, silent int, n long, length double, seq long, left binary, quiet long"


class Recorder(StatefulProcessor):
    """Input: source_id, chunk_seq, samples. Output: seg_id, samples."""

    def __init__(self, load: Callable[[], Classifier], limits: tuple[int, float, float], idle: int | None):
        self.load, self.limits, self.idle = load, limits, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.classifier = self.load()
        self.state = handle.getValueState("segment", STATE)
        self.held = handle.getListState("samples", "pcm binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The greatest number that a source has already used."""
        self.state.update((False, 0, 0, 0.0, int(initialState["max_seq"].max()), b"", 0))

    def _segment(self, key, seq: int, samples: np.ndarray) -> tuple[str, list[int]]:
        return f"src{key[0]}_{seq:06d}", samples.tolist()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cutter, framer, quiet = self._load()
        out, begun, fresh = [], True, []  # fresh: samples since the last cut, after those that the state holds where begun
        for chunk in pd.concat(list(rows)).sort_values("chunk_seq", kind="stable")["samples"]:
            x = np.asarray(chunk, "<i2")
            fresh.append(x)
            if done := cutter.add(len(x) / audio.SAMPLE_RATE, framer.hear(x)):
                before = self._samples() if begun else []
                out.append(self._segment(key, done[0], np.concatenate([*before, *fresh])))
                begun, fresh = False, []
        if not begun:
            self.held.clear()
        if fresh:
            self.held.appendValue((np.concatenate(fresh).tobytes(),))
        if self.idle is not None:
            if quiet:
                self.handle.deleteTimer(quiet)
            quiet = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(quiet)
        self._store(cutter, framer, quiet)
        yield pd.DataFrame(out, columns=["seg_id", "samples"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cutter, framer, quiet = self._load()
        out = []
        if expiredTimerInfo.getExpiryTimeInMs() == quiet:
            if done := cutter.tail():
                out.append(self._segment(key, done[0], np.concatenate(self._samples())))
            self.held.clear()
            self._store(cutter, framer, 0)
        yield pd.DataFrame(out, columns=["seg_id", "samples"])

    def _samples(self) -> list[np.ndarray]:
        return [np.frombuffer(x[0], "<i2") for x in self.held.get()] if self.held.exists() else []

    def _load(self) -> tuple[Cutter, Framer, int]:
        cutter, left, quiet = Cutter(*self.limits), b"", 0
        if self.state.exists():
            cutter.open, cutter.silent, cutter.n, cutter.length, cutter.seq, left, quiet = self.state.get()
        return cutter, Framer(self.classifier, np.frombuffer(bytes(left), "<i2")), quiet

    def _store(self, c: Cutter, framer: Framer, quiet: int) -> None:
        self.state.update((bool(c.open), int(c.silent), int(c.n), float(c.length), int(c.seq), np.asarray(framer.left, "<i2").tobytes(), int(quiet)))

    def close(self) -> None:
        pass


def recorded(chunks: DataFrame, load: Callable[[], Classifier], silence_limit: int, least: float, greatest: float, idle_ms: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """chunks (source_id, chunk_seq, samples) in order as a stream of closed segments (seg_id, samples). The classifier judges each frame alone; its own state does not outlive a batch."""
    first = seeds.select(F.col(seeds.columns[0]).cast("smallint").alias("source_id"), F.col(seeds.columns[1]).cast("long").alias("max_seq")).groupBy("source_id") if seeds is not None else None
    return chunks.groupBy("source_id").transformWithStateInPandas(Recorder(load, (silence_limit, least, greatest), idle_ms), "seg_id string, samples array<smallint>", "append", "processingTime" if idle_ms is not None else "none", first)


def record(segments: DataFrame, folder: str, checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
    """A running query that writes what `recorded` gives as files."""
    wav.register(segments.sparkSession)
    with rocksdb_state(segments.sparkSession):
        return segments.writeStream.format("segments").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def recognise(spark: SparkSession, folder: str, path: str, is_speech: Callable[[Column], Column], transcribe: Callable[[Column], Column], now: Column, gate: float = GATE, after_append: Callable[[], None] | None = None) -> int:
    """One step over the files in `folder`; how many were pending. is_speech judges a frame (an array of samples) for the gate."""
    listed = cut(files.segment_files(files.listing(spark, folder, "*.wav")).select("seg_id", "source_id", "path", "name", "length"))
    entries = transcript.read_entries(spark, path).select("seg_id")
    files.delete_files(listed.join(entries, "seg_id", "left_semi")).foreach(lambda row: None)
    pending = cut(queue.unprocessed(listed, entries))
    n = pending.count()
    if not n:
        return 0
    whole = wav.samples(pending, 1 << 24, 1 << 24).where("error is null")  # a segment has its greatest length, so it is one row
    samples = whole.select(text.stem(F.col("name")).alias("seg_id"), "samples").withColumn("flags", audio.frame_flags(F.col("samples"), is_speech))
    segments = pending.select("seg_id", F.col("source_id").cast("smallint").alias("source_id")).join(samples, "seg_id")
    done = cut(process_segments(segments, transcribe, now, gate))  # recognised once, read by the append and by the deletion
    kept = done.where("reason = 'kept'").select("seg_id", "source_id", "text", "duration_sec", "timestamp")
    if not kept.isEmpty():
        transcript.append(kept, path)
    if after_append:
        after_append()
    files.delete_files(queue.acknowledged(done, pending)).foreach(lambda row: None)
    return n


def follow(spark: SparkSession, checkpoint: str, seconds: float, step: Callable[[], object]) -> StreamingQuery:
    """A running query that takes a step every so many seconds."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, batch_id: step()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
