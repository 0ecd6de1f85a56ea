"""Views over transcripts, logs and control events: history, scrolling, latest values, running flags, exports.

Running views (`running_height`, `edges`, `while_on`, `configured`) depend on all rows of a key before each row:
a key's rows are sorted in one task, where they spill and are not held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkstream.functions import text
from larkstream.operators.order import global_rank


def last_n(df: DataFrame, arrival: list[str], n: int) -> DataFrame:
    """The n rows that arrived last. A top-k: each task keeps n, and n of each meet once."""
    return df.orderBy(*[F.col(c).desc() for c in arrival]).limit(n)


def shown_logs(logs: DataFrame, verbose: bool, only_verbose: str = "verbose_only") -> DataFrame:
    """Log lines that are shown: all, or those that are not for verbose listeners only."""
    return logs if verbose else logs.where(~F.coalesce(F.col(only_verbose), F.lit(False)))


def multiplexed(sources: dict[int, DataFrame], name: str = "source_id") -> DataFrame:
    """The rows of all sources as one table, with the number of theirs; columns go by name, repeated rows stay."""
    one, *more = [df.withColumn(name, F.lit(n)) for n, df in sources.items()]
    for df in more:
        one = one.unionByName(df)
    return one


def running_height(df: DataFrame, key: str, order: list[str], height: str) -> DataFrame:
    """df with the lines above each row (offset) and the total of its key."""
    w = Window.partitionBy(key)
    upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("offset", F.sum(height).over(upto) - F.col(height)).withColumn("total", F.sum(height).over(w))


def latest(df: DataFrame, keys: list[str], value: str, arrival: list[str]) -> DataFrame:
    """The value that arrived last for each key; an aggregate, so hot keys are summed before they move."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*arrival)).alias(value), F.max(F.struct(*arrival)).alias("at"))


def edges(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Rows at which the flag falls from true to false."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_f", flag).withColumn("_before", F.lag("_f").over(w)).where("_before and not _f").drop("_f", "_before")


def while_on(df: DataFrame, key: str, order: list[str], turns_on: Column, turns_off: Column, at_first: bool) -> DataFrame:
    """Rows, but not the controls themselves, at which the running flag is on."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    control = F.when(turns_on, True).when(turns_off, False)
    state = F.coalesce(F.last(control, ignorenulls=True).over(w), F.lit(at_first))
    return df.withColumn("_on", state).withColumn("_control", control.isNotNull()).where("_on and not _control").drop("_on", "_control")


def younger_than(df: DataFrame, ts: str, now: Column, interval: str) -> DataFrame:
    return df.where(F.col(ts) > now - F.expr(f"interval {interval}"))


def export_order(seg_id: str, timestamp: str, line: str) -> list[Column]:
    """Valid times first, to the nanosecond; ties by key, then by line; invalid times after them by key."""
    ts, key = text.rfc3339(F.col(timestamp)), text.seg_key_lenient(F.col(seg_id))
    return [ts.isNull(), ts, text.rfc3339_nanos(F.col(timestamp)), key["source"], key["seq"], F.col(line)]


def export_sorted(entries: DataFrame, seg_id: str = "seg_id", timestamp: str = "timestamp", line: str = "line_no") -> DataFrame:
    """entries with their rank in the export; a range exchange, no single task."""
    return global_rank(entries, *export_order(seg_id, timestamp, line))


def page(df: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    """n rows from a place in the order."""
    return df.orderBy(*order).offset(offset).limit(n)


def scroll_view(heights: DataFrame, key: str, height: str, wanted: Column, rows: int, follow: Column | None = None) -> DataFrame:
    """Per key: total height, greatest offset for a window of `rows`, and the offset shown: `wanted`, no further than that,
    or the greatest where `follow` is true. `wanted` and `follow` are aggregates, or constants, of a key."""
    total = F.coalesce(F.sum(height), F.lit(0)).cast("long")
    sums = heights.groupBy(F.col(key)).agg(total.alias("total"), wanted.cast("long").alias("_wanted"), (follow if follow is not None else F.lit(False)).alias("_follow"))
    sums = sums.withColumn("most", F.greatest(F.col("total") - rows, F.lit(0).cast("long")))
    shown = F.when(F.col("_follow"), F.col("most")).otherwise(F.greatest(F.lit(0).cast("long"), F.least("_wanted", "most")))
    return sums.select(key, "total", "most", shown.alias("offset"))


def throttled(df: DataFrame, keys: list[str], ts: str, value: str, arrival: list[str], millis: int) -> DataFrame:
    """The last value of each key in each slot of `millis`: what a screen that is drawn so often shows."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (millis * 1000)).cast("long")
    return latest(df.withColumn("slot", slot), [*keys, "slot"], value, arrival).drop("at")


def configured(df: DataFrame, key: str, order: list[str], change: Column, setting: Column, at_first: Column) -> DataFrame:
    """Rows, but not the changes themselves, with the setting in force (config) and how many changes came before (generation).

    What was begun under one generation ends where the next one begins, so (key, generation) is a run.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    changed = F.coalesce(change, F.lit(False))
    rows = df.withColumn("config", F.coalesce(F.last(F.when(changed, setting), ignorenulls=True).over(w), at_first)).withColumn("generation", F.count_if(changed).over(w))
    return rows.withColumn("_change", changed).where("not _change").drop("_change")


def replace_snapshot(rows: DataFrame, name: str, path: str) -> DataFrame:
    """The view `name` shows these rows from now on, and no earlier ones: a new folder under `path`, then the view."""
    import uuid

    spark, where = rows.sparkSession, f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    rows.write.parquet(where)
    held = spark.read.schema(rows.schema).parquet(where)
    held.createOrReplaceTempView(name)
    return held
