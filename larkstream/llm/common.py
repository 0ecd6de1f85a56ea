"""What the corpus operators share: fixed patterns, the shared work folder, Arrow batch helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkstream.session import cut, drop_folder, measured_cut, shared_folder

__all__ = ["BLANKS", "WORD", "cut", "drop_folder", "measured_cut", "shared_folder", "sized", "slices", "stored", "small_batches", "table", "text_bytes", "word_count", "written"]

#: Fixed values of the query contracts: six ASCII blanks separate words.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path; the caller drops the folder when it is read. options: of the writer."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder (smaller than a checkpoint where rows hold texts).

    What is returned reads from there lazily, so the folder stays, as a checkpoint does: it goes with the one
    in spark.checkpoint.dir, which is the caller's to clean.
    """
    return stored(df, name)[0]


BROADCAST_ROWS = 300_000  # of narrow rows, some 40 bytes each


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast where it has few enough rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches to Python held to BATCH_BYTES where they are at Spark's default of 64 MB.

    The setting is read when a query runs, so it stays for the session; a size that the caller has set is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, "67108864b") == "67108864b":
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices whose texts in `column` hold about `most` bytes (one longer text is a slice of its own)."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
