"""WAV files of any size, read in ranges by many tasks, and a sink that publishes segments as files when all are written.

Reading begins with a listing (`files.listing`, or any table with path, name and length), so whatever filters it
decides what is opened. `headers` reads a few bytes of each file. `samples` gives each file as rows of `width`
samples, however large it is: a file is dealt as byte ranges that begin and end between samples, each read by
whichever task gets it.

Writing is a data source, ``df.write.format("segments")`` and its stream form (call `register` once a session):
tasks write each segment (seg_id, samples) into a hidden folder beside the others; only when all tasks have ended the
files get their names, and where the job fails, or a task failed or had a twin, what it left is deleted.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from larkstream.sources.files import store, wav_bytes

WIDTH = 1 << 20  # samples of a row
RANGE = 1 << 23  # samples of a range: 16 MB


@dataclass
class Header:
    """Where the samples of a mono 16-bit file are, or why there are none."""

    rate: int | None = None
    start: int = 0
    samples: int = 0
    error: str | None = None


def read_header(file, length: int) -> Header:
    """Walks the chunks of a RIFF file with small reads; the samples themselves are not read."""
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return Header(error="no WAVE file")
    at, fmt, data = 12, None, None
    while at + 8 <= length:
        file.seek(at)
        tag, n = struct.unpack("<4sI", file.read(8))
        if tag == b"fmt " and n >= 16:
            held = file.read(16)
            fmt = struct.unpack("<HHIIHH", held) if len(held) == 16 else None
        elif tag == b"data":
            data = at + 8, max(0, min(n, length - at - 8))
        at += 8 + n + n % 2
    if not fmt or data is None:
        return Header(error="no format or data")
    if fmt[1] != 1 or fmt[5] != 16:
        return Header(rate=fmt[2], error=f"{fmt[1]} channels of {fmt[5]} bits")
    return Header(fmt[2], data[0], data[1] // 2)


def _opened(path: str):
    system, bare = store(path)
    return system.open_input_file(bare)


def headers(files: DataFrame) -> DataFrame:
    """path, name, rate, n_samples, seconds (null where the rate is 0) and error of each file, by its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                with _opened(path) as file:
                    found.append(read_header(file, file.size()))
            ok = [h if h.error is None else None for h in found]
            seconds = [h.samples / h.rate if h and h.rate else None for h in ok]
            columns = [pa.array([h.rate for h in found], pa.int64()), pa.array([h and h.samples for h in ok], pa.int64()), pa.array(seconds, pa.float64()), pa.array([h.error for h in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], ["path", "name", "rate", "n_samples", "seconds", "error"])

    return files.select("path", "name").mapInArrow(run, "path string, name string, rate long, n_samples long, seconds double, error string")


def samples(files: DataFrame, width: int = WIDTH, per_range: int = RANGE, partitions: int | None = None) -> DataFrame:
    """name, rate, first (the place of a row's first sample), samples and error of files (path, name, length).

    A file without samples is one row with none; one that cannot be read is one row with its error. Ranges are whole
    numbers of rows, and are dealt over partitions one by one.
    """
    per_range = max(1, per_range // width) * width
    ranges = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(length - 1) div (2 * {per_range})")))
    dealt = files.select("path", "name", F.explode(ranges).alias("k"))
    spread = F.xxhash64("path", "k")
    dealt = dealt.repartition(partitions, spread) if partitions else dealt.repartition(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _opened(path) as file:
                    h = read_header(file, file.size())
                    begin, end = k * per_range, min((k + 1) * per_range, h.samples)
                    if h.error is not None or not h.samples:
                        if not k:
                            yield _row(name, h.rate, 0, None if h.error else np.zeros(0, "<i2"), h.error)
                        continue
                    for at in range(begin, end, width):
                        file.seek(h.start + 2 * at)
                        yield _row(name, h.rate, at, np.frombuffer(file.read(2 * min(width, end - at)), "<i2"), None)

    return dealt.mapInArrow(run, "name string, rate long, first long, samples array<smallint>, error string")


def _row(name: str, rate: int | None, first: int, x: np.ndarray | None, error: str | None) -> pa.RecordBatch:
    held = pa.array([None], pa.list_(pa.int16())) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int16()))
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int64()), pa.array([first], pa.int64()), held, pa.array([error], pa.string())], ["name", "rate", "first", "samples", "error"])


# ---- the sink


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: names without and with their temporary ending."""

    files: list[tuple[str, str]]


class _Writer:
    """Both forms of the sink: `write` runs in tasks, the rest where the job is planned."""

    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex
        store(self.folder)[0].create_dir(self._parts(), recursive=True)

    def _parts(self) -> str:
        """Where this job's tasks write: beside the segments, hidden from readers, on the same file system."""
        return f"{store(self.folder)[1]}/_parts/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.folder)
        attempt, files = uuid.uuid4().hex, []
        try:
            for b in iterator:
                for seg_id, x in zip(b["seg_id"].to_pylist(), b["samples"], strict=True):
                    if not x.is_valid or not len(x):
                        continue
                    part = f"{self._parts()}/{seg_id}.{attempt}.part"
                    files.append((f"{root}/{seg_id}.wav", part))
                    with system.open_output_stream(part) as file:
                        file.write(wav_bytes(x.values.to_numpy(zero_copy_only=False)))
        except BaseException:
            _each(lambda f: _delete(system, f[1]), files)
            raise
        return Written(files)

    def _publish(self, messages: list[Written | None]) -> None:
        system, _ = store(self.folder)
        files = dict(f for m in messages if m for f in m.files)  # one segment, one file
        _each(lambda f: system.move(f[1], f[0]), list(files.items()))

    def _close(self) -> None:
        """Deletes the job's folder with what tasks that were lost, twins and failed ones have left. A task that is still
        running cannot write any more: files are opened in a folder that is there, and no task makes one."""
        system, _ = store(self.folder)
        for last in (False, True):
            try:
                system.delete_dir(self._parts())
                return
            except FileNotFoundError:
                return
            except OSError:  # a file came between listing and deletion
                if last:
                    raise


def _each(act, things: list) -> None:
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(act, things))


def _delete(system, path: str) -> None:
    try:
        system.delete_file(path)
    except FileNotFoundError:
        pass


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._publish(messages)
        self._close()

    def abort(self, messages: list[Written | None]) -> None:
        self._close()


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A batch that is repeated after a crash writes the same segments under the same names."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        """The folder stays for the next batch, without what twins have left."""
        self._publish(messages)
        store(self.folder)[0].delete_dir_contents(self._parts(), missing_dir_ok=True)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._close()  # the query ends


class SegmentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return "seg_id string, samples array<smallint>"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSink)


def write_segments(segments: DataFrame, folder: str) -> None:
    """Writes segments (seg_id, samples) as files <seg_id>.wav: all of them, or none; those without samples leave no file."""
    register(segments.sparkSession)
    segments.select("seg_id", F.col("samples").cast("array<smallint>").alias("samples")).write.format("segments").mode("append").save(folder)
