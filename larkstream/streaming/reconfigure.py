"""Settings that change while a stream runs: control rows reach every key, and each row knows its setting and generation.

A change is a row in the stream (``change`` true, with its ``setting``). `for_every_key` hands changes that name no key
to all of them. Each key's state holds the setting in force and how many changes came before, so rows carry both on,
as `views.configured` gives them for a batch; what was begun under one generation ends where the next begins:
`closing_changes` turns changes into ``eof`` rows for the segmentation, which cut there.

Within a micro-batch rows are sorted by ``ord``; across batches a source must deliver in order, as for
`segments.segment_stream`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOST_KEYS = 100_000


class ConfiguredProcessor(StatefulProcessor):
    """Input: key, ord, id, change, setting."""

    def __init__(self, at_first: float):
        self.at_first = at_first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("config", "setting double, generation long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.state.get()
        setting, generation = before or (self.at_first, 0)
        made, out = Row("key", "ord", "id", "config", "generation"), []
        for row in sorted(rows, key=lambda r: (r.ord is None, r.ord, not r.change)):  # a change counts for rows beside it
            if not row.change:
                out.append(made(key[0], row.ord, row.id, setting, generation))
                continue
            generation += 1
            if row.setting is not None and row.setting == row.setting:
                setting = row.setting
        if before != (setting, generation):
            self.state.update((float(setting), int(generation)))
        return iter(out)

    def close(self) -> None:
        pass


def configured_stream(rows: DataFrame, at_first: float) -> DataFrame:
    """rows (key, ord, id, change, setting) without the changes, with config and generation. A change without a setting keeps the one before. Start it within `segments.rocksdb_state`."""
    given = rows.select("key", "ord", "id", F.coalesce("change", F.lit(False)).alias("change"), F.col("setting").cast("double").alias("setting"))
    out = T.StructType([*[T.StructField(c, given.schema[c].dataType) for c in ("key", "ord", "id")], *T.StructType.fromDDL("config double, generation long").fields])
    return given.groupBy("key").transformWithState(ConfiguredProcessor(float(at_first)), out, "append", "none")


def for_every_key(controls: DataFrame, keys: DataFrame) -> DataFrame:
    """controls (a stream or a table, without a key) once for each of keys (key), which are sources: MOST_KEYS at most."""
    known = keys.select("key").distinct()
    if known.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"a change for more than {MOST_KEYS} keys; give changes by key")
    return controls.crossJoin(F.broadcast(known))  # few rows by few


def closing_changes(kind: Column, change: Column) -> Column:
    """The kind of a unit for segmentation: changes end what is open."""
    return F.when(F.coalesce(change, F.lit(False)), "eof").otherwise(F.coalesce(kind, F.lit("data")))
