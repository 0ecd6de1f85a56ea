"""The durable queue: which segments are still to be processed, and how much that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkstream.functions import audio, text


def processed_ids(entries: DataFrame, key: str = "seg_id") -> DataFrame:
    return entries.select(key).distinct()


def unprocessed(files: DataFrame, entries: DataFrame, key: str = "seg_id") -> DataFrame:
    """Files whose id no entry has. An anti-join needs no distinct ids, and keeps files with a null id."""
    return files.join(entries.select(key), key, "left_anti")


def recovery_order(seg_id: Column) -> list[Column]:
    """Sort columns: by source, then number; ids that cannot be read come last."""
    k = text.seg_key_strict(seg_id)
    return [F.coalesce(k["source"], F.lit(text.U8)), F.coalesce(k["seq"], F.lit(text.U32))]


def queue_stats(files: DataFrame, entries: DataFrame, key: str = "seg_id", size: str = "length") -> DataFrame:
    """One row: pending files, their MB, and MB of all files."""
    done = processed_ids(entries, key).withColumn("_done", F.lit(True))
    open_ = F.col("_done").isNull()
    return files.join(done, key, "left").agg(
        F.count_if(open_).alias("pending"),
        audio.mebibytes(F.coalesce(F.sum(F.when(open_, F.col(size))), F.lit(0))).alias("pending_mb"),
        audio.mebibytes(F.coalesce(F.sum(size), F.lit(0))).alias("total_mb"),
    )


def max_seq(files: DataFrame, source: str, seq: Column) -> DataFrame:
    """The greatest number of each source, 0 where none can be read."""
    return files.groupBy(source).agg(F.coalesce(F.max(seq), F.lit(0)).cast("long").alias("max_seq"))


def orphans(files: DataFrame, name: str = "name") -> DataFrame:
    return files.where(F.col(name).endswith(".part"))


def dead_letters(processed: DataFrame, before: DataFrame | None = None, most: int = 3) -> DataFrame:
    """Segments that failed, with attempts so far and whether to try again. One aggregation with what failed before."""
    failed = processed.where("reason = 'error'").select("seg_id", F.lit(1).alias("attempts"))
    if before is not None:
        failed = failed.unionByName(before.select("seg_id", F.col("attempts").cast("int").alias("attempts")))
    return failed.groupBy("seg_id").agg(F.sum("attempts").cast("int").alias("attempts")).withColumn("again", F.col("attempts") < most)


def to_retry(letters: DataFrame, files: DataFrame) -> DataFrame:
    """The files of failed segments that are to be tried again, with their attempts: the next run's input."""
    return files.join(letters.where("again").select("seg_id", "attempts"), "seg_id")


def still_there(pending: DataFrame, files: DataFrame, key: str = "seg_id") -> DataFrame:
    """Pending segments whose file has not vanished since; a semi-join with a new listing."""
    return pending.join(files.select(key), key, "left_semi")


def acknowledged(processed: DataFrame, files: DataFrame) -> DataFrame:
    """Files (seg_id, path) of segments that are done with: written to the transcript, or without anything to hear.

    Give them to `sources.files.delete_files` after the transcript is written; those of failed segments stay.
    """
    return files.join(processed.where(F.col("reason").isin("kept", "empty", "silent", "no_text")).select("seg_id"), "seg_id", "left_semi")


def seed_numbers(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Per source the greatest number in file names (name) or transcript entries (seg_id), to go on from.

    Files alone are not enough: processed ones are deleted, and a number used twice would hide new audio
    behind an old entry.
    """
    bare = F.regexp_replace("name", r"\.(wav|part)$", "")
    ids = files.select(bare.alias("seg_id")).unionByName(entries.select("seg_id"))
    keys = ids.select(text.seg_key_strict(F.col("seg_id")).alias("k")).where("k is not null")
    return keys.groupBy(F.col("k.source").alias("source")).agg(F.max("k.seq").alias("max_seq"))
