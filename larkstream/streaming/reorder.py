"""Streaming segmentation of chunks that arrive in any order, and of sources that fall silent.

Chunks carry their number (``place``), dense from `first` on in each source. What arrives ahead of its turn waits in
a buffer of the key's state; when the missing numbers come, all that is in turn is cut as by
`operators.segment`. Numbers that came before are dropped, so a chunk sent twice counts once. A gap that stays open
for `patience` is given up: the buffer goes on from its least number, and what is missing, should it come later,
is dropped like any number from before.

A source that sends nothing for `idle` has its open segment closed as the tail, once, without a control row. Both
limits are timers in processing time, kept with the state, so a restart goes on with them: a limit that has passed
meanwhile is acted on in the first batch. A stream that is to end at once (``availableNow``) sends eof rows instead.

The buffer of a key holds what lies behind a gap, bounded by `patience` times the source's rate; a key's rows of
one micro-batch are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkstream.operators.segment import Cutter
from larkstream.streaming.segments import OUT

STATE = "open boolean, silent int, n long, length double, seq long, paused boolean, next long, gap long, quiet long"
WAITING = "kind string, length double, verdicts array<boolean>"


class ReorderingProcessor(StatefulProcessor):
    """Input: key, place, kind, length, verdicts. `gap` and `quiet` are the times of the timers that are set, 0 for none."""

    def __init__(self, limits: tuple[int, float, float], patience: int, idle: int | None, first: int):
        self.limits, self.patience, self.idle, self.first = limits, patience, idle, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("segment", STATE)
        self.waiting = handle.getMapState("waiting", "place long", WAITING)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The greatest number that a source has already used."""
        self.state.update((False, 0, 0, 0.0, int(initialState["max_seq"].max()), False, self.first, 0, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cutter, place, gap, quiet = self._load()
        out: list[tuple] = []
        new = {}
        held = pd.concat(list(rows))
        for at, kind, length, verdicts in zip(held["place"], held["kind"], held["length"], held["verdicts"], strict=True):
            if at >= place:
                new[int(at)] = ("data" if kind is None else kind, 0.0 if pd.isna(length) else float(length), [v is None or bool(v) for v in (verdicts if verdicts is not None else ())])
        heard = bool(new)
        place = self._drain(key, cutter, out, place, new)
        for at, row in new.items():  # only what is not in turn yet goes to the buffer
            self.waiting.updateValue((at,), row)
        gap, quiet = self._timers(timerValues.getCurrentProcessingTimeInMs(), cutter, gap, quiet, heard)
        self._store(cutter, place, gap, quiet)
        yield pd.DataFrame(out, columns=["key", *OUT])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cutter, place, gap, quiet = self._load()
        out: list[tuple] = []
        due = expiredTimerInfo.getExpiryTimeInMs()
        if due == gap:
            gap = 0
            if left := [k[0] for k in self.waiting.keys()]:
                place = self._drain(key, cutter, out, min(left), {})
                gap, quiet = self._timers(timerValues.getCurrentProcessingTimeInMs(), cutter, gap, quiet, True)
        if due == quiet:
            quiet = 0
            if not self.waiting.exists() and (done := cutter.tail()):
                out.append((key[0], *done))
        self._store(cutter, place, gap, quiet)
        yield pd.DataFrame(out, columns=["key", *OUT])

    def _load(self) -> tuple[Cutter, int, int, int]:
        cutter = Cutter(*self.limits)
        if not self.state.exists():
            return cutter, self.first, 0, 0
        cutter.open, cutter.silent, cutter.n, cutter.length, cutter.seq, cutter.paused, place, gap, quiet = self.state.get()
        return cutter, place, gap, quiet

    def _store(self, c: Cutter, place: int, gap: int, quiet: int) -> None:
        self.state.update((bool(c.open), int(c.silent), int(c.n), float(c.length), int(c.seq), bool(c.paused), int(place), int(gap), int(quiet)))

    def _drain(self, key, cutter: Cutter, out: list, place: int, new: dict[int, tuple]) -> int:
        """Takes what is in turn from `place` on, out of `new` and the buffer; the first number that is missing."""
        old = {k[0] for k in self.waiting.keys()} if self.waiting.exists() else set()
        while place in new or place in old:
            row = new.pop(place, None)
            if place in old:  # as it came first
                kind, length, verdicts = self.waiting.getValue((place,))
                self.waiting.removeKey((place,))
                row = kind, length, list(verdicts)
            if done := cutter.take(*row):
                out.append((key[0], *done))
            place += 1
        return place

    def _timers(self, now: int, cutter: Cutter, gap: int, quiet: int, heard: bool) -> tuple[int, int]:
        """One timer while something waits, one while a segment is open, set anew whenever something is heard."""
        waits = self.waiting.exists()
        if gap and not waits:
            self.handle.deleteTimer(gap)
            gap = 0
        elif waits and not gap:
            gap = now + self.patience
            self.handle.registerTimer(gap)
        if self.idle is not None and heard:
            if quiet and quiet != gap:
                self.handle.deleteTimer(quiet)
            quiet = now + self.idle if cutter.open or waits else 0
            if quiet:
                self.handle.registerTimer(quiet)
        return gap, quiet

    def close(self) -> None:
        pass


def segment_unordered(units: DataFrame, silence_limit: int, least: float, greatest: float, patience_ms: int, idle_ms: int | None = None, seeds: DataFrame | None = None, first: int = 0) -> DataFrame:
    """units (key, place, length, verdicts, kind), in any order, as a stream of closed segments.

    `seeds` as for `segments.segment_stream`. Start the query within `segments.rocksdb_state`.
    """
    kind = units.schema["key"].dataType.simpleString()
    start = seeds.select(F.col(seeds.columns[0]).cast(kind).alias("key"), F.col(seeds.columns[1]).cast("long").alias("max_seq")).groupBy("key") if seeds is not None else None
    return units.select("key", F.col("place").cast("long").alias("place"), "kind", F.col("length").cast("double").alias("length"), "verdicts").groupBy("key").transformWithStateInPandas(
        ReorderingProcessor((silence_limit, least, greatest), patience_ms, idle_ms, first), f"key {kind}, seq long, n_units long, length double, reason string", "append", "processingTime", start
    )
