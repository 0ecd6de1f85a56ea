"""A folder of recorded chunks as a stream: ``spark.readStream.format("chunk_queue")``, after `register`.

A recorder puts files ``<source>-<first>-<count>.pcm`` there, whole, by a rename: `count` chunks of `WIDTH` samples from
the number `first` on, 16 bits each, little-endian (`put`, or `enqueue` for a table). Offsets are the next number of each
source. A batch's files are its partitions; a batch that is done again after a crash reads the same numbers from
the same files, for files are deleted only when the batch that read their last chunk is committed.

What lies there when a query starts is its backlog: it is delivered before anything that comes later, by any
source, and at most `files_per_batch` files make a batch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from larkstream.schemas import CHUNKS
from larkstream.sources.files import store

WIDTH = 512
_NAME = re.compile(r"([0-9]+)-([0-9]+)-([0-9]+)\.pcm")


@dataclass(frozen=True)
class QueueFile(InputPartition):
    """Chunks `begin` to `end` (not included) of a file whose first one is `first`."""

    path: str
    source: int
    first: int
    begin: int
    end: int


def put(folder: str, source: int, first: int, samples: np.ndarray, width: int = WIDTH) -> None:
    """Adds a file; what does not fill a chunk is left out. A file that is there already is replaced by the same."""
    system, root = store(folder)
    count = len(samples) // width
    part = f"{root}/.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as file:
        file.write(np.asarray(samples[: count * width], "<i2").tobytes())
    system.move(part, f"{root}/{source}-{first:020d}-{count}.pcm")


def enqueue(chunks: DataFrame, folder: str, per_file: int = 1000, width: int = WIDTH) -> int:
    """Writes a table of chunks (source_id, chunk_seq, samples of `width`) as files; the number of chunks."""
    store(folder)[0].create_dir(store(folder)[1], recursive=True)
    rows = chunks.select("source_id", "chunk_seq", "samples").repartition("source_id").sortWithinPartitions("source_id", "chunk_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        source, first, n = None, 0, 0

        def flush() -> None:
            if held:
                put(folder, source, first, np.concatenate(held), width)
                held.clear()

        for b in batches:
            for s, k, x in zip(b[0].to_pylist(), b[1].to_pylist(), b[2], strict=True):
                if s != source or k != first + len(held) or len(held) >= per_file:
                    flush()
                    source, first = s, k
                held.append(x.values.to_numpy(zero_copy_only=False))
                n += 1
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class QueueReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.width = int(options.get("width", WIDTH))
        self.most = int(options.get("files_per_batch", 1000))
        self.given: dict[int, int] = {}  # up to where numbers have been handed out by this query
        self.backlog = {f.path for f in self._files()}

    def _files(self) -> list[QueueFile]:
        """All files, oldest numbers first within a source."""
        from pyarrow import fs

        system, root = store(self.folder)
        out = []
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if m := _NAME.fullmatch(f.base_name):
                source, first, count = map(int, m.groups())
                out.append(QueueFile(f.path, source, first, first, first + count))
        return sorted(out, key=lambda f: (f.first, f.source))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """As far as the next `most` files reach; those of the backlog come first."""
        new = [f for f in self._files() if f.end > self.given.get(f.source, 0)]
        old = [f for f in new if f.path in self.backlog]
        for f in (old or new)[: self.most]:
            self.given[f.source] = max(self.given.get(f.source, 0), f.end)
        return {str(s): n for s, n in self.given.items()}

    def partitions(self, start: dict, end: dict) -> list[QueueFile]:
        for s, n in end.items():  # after a restart the offsets of the log are the first that are known
            self.given[int(s)] = max(self.given.get(int(s), 0), n)
        out = []
        for f in self._files():
            begin, stop = max(f.first, start.get(str(f.source), 0)), min(f.end, end.get(str(f.source), 0))
            if begin < stop:
                out.append(QueueFile(f.path, f.source, f.first, begin, stop))
        return out

    def read(self, partition: QueueFile) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.folder)
        step = max(1, (1 << 22) // self.width)
        with system.open_input_file(partition.path) as file:
            for k in range(partition.begin, partition.end, step):
                n = min(step, partition.end - k)
                file.seek((k - partition.first) * self.width * 2)
                x = np.frombuffer(file.read(n * self.width * 2), "<i2")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.source] * n, pa.int16()), pa.array(np.arange(k, k + n), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.width, pa.int32()), pa.array(x, pa.int16()))],
                    ["source_id", "chunk_seq", "samples"],
                )

    def commit(self, end: dict) -> None:
        """Deletes files that committed batches have read to their end."""
        system, _ = store(self.folder)
        for f in self._files():
            if f.end <= end.get(str(f.source), 0):
                try:
                    system.delete_file(f.path)
                except FileNotFoundError:
                    continue


class ChunkQueue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_queue"

    def schema(self) -> str:
        return CHUNKS

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkQueue)


def chunks(spark: SparkSession, folder: str, width: int = WIDTH, files_per_batch: int = 1000) -> DataFrame:
    """The queue as a stream of source_id, chunk_seq and samples."""
    register(spark)
    return spark.readStream.format("chunk_queue").option("path", folder).option("width", width).option("files_per_batch", files_per_batch).load()
