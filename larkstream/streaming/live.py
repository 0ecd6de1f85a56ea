"""Live views of streams: tables with one row a key that each micro-batch brings up to date, in versions.

`LatestTable` keeps the value that arrived last for each key, as `views.latest` gives it for a batch. A micro-batch is
first reduced to one row a key, then merged with the version before it into a new one: a folder ``v=<batch>``,
which counts once its ``_SUCCESS`` is written. A batch that is done again finds the same version before it and
writes the same rows again, so nothing is doubled; readers see whole versions only. The last `KEEP` versions stay for readers
that have begun, older ones are deleted.

Arrival is an order that rows carry (its columns, greatest last), so neither the split into batches nor their order
changes what is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEEP = 3


class LatestTable:
    """One row a key: the keys, `value` and `at` (the arrival columns as a struct), in `folder`."""

    def __init__(self, folder: str, keys: list[str], value: str, arrival: list[str], keep: int = KEEP):
        self.folder, self.keys, self.value, self.arrival, self.keep = folder.rstrip("/"), keys, value, arrival, keep

    def _place(self, spark: SparkSession, name: str = ""):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self, spark: SparkSession) -> list[int]:
        system, top = self._place(spark)
        if not system.exists(top):
            return []
        names = [f.getPath().getName() for f in system.listStatus(top)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and system.exists(self._place(spark, f"{n}/_SUCCESS")[1]))

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The rows of a version, else of the last one; None before the first."""
        known = self.versions(spark)
        if not known:
            return None
        return spark.read.parquet(f"{self.folder}/v={known[-1] if version is None else version}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch writer."""
        spark = batch.sparkSession
        at = F.struct(*self.arrival)
        new = batch.groupBy(*self.keys).agg(F.max(F.struct(at.alias("at"), F.col(self.value).alias("value"))).alias("_m"))
        earlier = [v for v in self.versions(spark) if v < batch_id]
        if earlier:
            old = self.read(spark, earlier[-1]).select(*self.keys, F.struct(F.col("at"), F.col(self.value).alias("value")).alias("_m"))
            new = new.unionByName(old).groupBy(*self.keys).agg(F.max("_m").alias("_m"))
        rows = new.select(*self.keys, F.col("_m.value").alias(self.value), F.col("_m.at").alias("at"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/v={batch_id}")
        for v in earlier[: max(0, len(earlier) + 1 - self.keep)]:
            system, where = self._place(spark, f"v={v}")
            system.delete(where, True)

    def follow(self, stream: DataFrame, checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
        """A running query that brings the table up to date every so many seconds."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def live_queue_stats(files: DataFrame, entries: DataFrame, folder: str, checkpoint: str, size: Column | None = None) -> tuple[LatestTable, DataFrame]:
    """Queue statistics over two streams: files (seg_id, length) as they come and entries (seg_id) as they are written.

    Both are one stream of marks a segment, summed into a table of segments, from which `queue_totals` counts. Returns that
    table and the stream to follow.
    """
    length = size if size is not None else F.col("length")
    none = F.lit(None).cast("bigint")
    came = files.select("seg_id", length.cast("bigint").alias("length"), F.lit(0).alias("done"))
    gone = entries.select("seg_id", none.alias("length"), F.lit(1).alias("done"))
    marks = came.unionByName(gone).select("seg_id", F.struct("length", "done").alias("mark"), "done", F.coalesce("length", F.lit(0).cast("bigint")).alias("size"))
    return LatestTable(folder, ["seg_id", "done"], "mark", ["size"]), marks


def queue_totals(table: DataFrame) -> DataFrame:
    """pending, pending_mb and total_mb, as `queue.queue_stats` gives them, of a table that `live_queue_stats` keeps."""
    by_segment = table.groupBy("seg_id").agg(F.max("mark.length").alias("length"), F.max("done").alias("done"))
    there = by_segment.where("length is not null")
    mb = lambda c: F.coalesce(F.sum(c), F.lit(0)) / 1048576.0
    return there.agg(F.count_if(F.col("done") == 0).alias("pending"), mb(F.when(F.col("done") == 0, F.col("length"))).alias("pending_mb"), mb(F.col("length")).alias("total_mb"))
