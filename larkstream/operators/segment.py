"""Cutting keyed streams into segments by silence, least and greatest length.

Per key, in order, a unit (a chunk of samples, or any row with a length) is added to the open segment;
its verdicts, one per frame that ends in it, set the silence run in their order: speech sets it to 0,
silence adds 1 (a missing verdict is speech), and only the run after the unit's last frame counts. The
segment closes after a unit when that run has reached its limit and the segment its least length, or
when the segment has its greatest length; the closing unit belongs to it, and the next segment is open
at once. The first unit after the start or a pause opens a segment and so can't close it.

Opening a segment consumes a number. ``pause`` drops the open segment for good, so its number is not
used again, and units up to ``resume`` are ignored; ``eof``, or the end of the rows, closes what is open
as the tail, unless it has no units. `seeds` are the greatest numbers already used, by key.

This is a fold with resets, which no window can express. Two batch forms give the same rows; the
stream in `larkstream.streaming.segments` is the third:

* `segment_runs` (the default, `segment`): rows are dealt by key and sorted within partitions, and one
  pass in Arrow batches carries the state on from batch to batch; its memory does not grow with a key.
* `segment_fold`: ``aggregate`` over each key's ordered array, in the JVM, for keys that surely fit one.

A key's units pass through one task in all forms: each cut depends on the one before. Ties of the order
columns are broken by kind, length and verdicts; null lengths are 0, units of a null key are one key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROLS = ("pause", "resume", "eof")


def known_sources(units: DataFrame, source: str = "source_id", most: int = 1) -> DataFrame:
    """The units of sources 0 to `most`; others are dropped."""
    return units.where(F.col(source).between(0, most))


def _rows(units: DataFrame, key: str, order: list[str], length: Column, speech: Column, kind: Column | None, seeds: DataFrame | None) -> DataFrame:
    """Columns _key, _o0.., _kind, _len, _verdicts and _seed of the units."""
    verdicts = speech if isinstance(units.select(speech).schema[0].dataType, T.ArrayType) else F.array(speech)
    rows = units.select(
        F.col(key).alias("_key"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.coalesce(kind if kind is not None else F.lit("data"), F.lit("data")).alias("_kind"),
        F.coalesce(length.cast("double"), F.lit(0.0)).alias("_len"),
        F.transform(F.coalesce(verdicts, F.array().cast("array<boolean>")), lambda v: F.coalesce(v, F.lit(True))).alias("_verdicts"),
    )
    if seeds is None:
        return rows.withColumn("_seed", F.lit(0).cast("long"))
    name, number = seeds.columns
    last = seeds.select(F.col(name).alias("_of"), F.col(number).cast("long").alias("_last"))
    return rows.join(last, F.col("_key").eqNullSafe(F.col("_of")), "left").withColumn("_seed", F.coalesce("_last", F.lit(0).cast("long"))).drop("_of", "_last")


def segment_fold(units: DataFrame, key: str, order: list[str], length: Column, speech: Column, silence_limit: int, least: float, greatest: float, kind: Column | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """One row per segment: key, seq, n_units, length, reason (silence, max or tail)."""
    rows = _rows(units, key, order, length, speech, kind, seeds)
    state = "open boolean, paused boolean, silent int, n bigint, length double, seq bigint, done array<struct<seq:bigint,n_units:bigint,length:double,reason:string>>"
    names = [f.split()[0] for f in state.split(", ")]

    def made(**fields: Column) -> Column:
        return F.struct(*[fields[n].alias(n) for n in names])

    def one(seq: Column, n: Column, total: Column, reason: Column) -> Column:
        return F.array(F.struct(seq.alias("seq"), n.alias("n_units"), total.alias("length"), reason.alias("reason")))

    zero, none, no = F.lit(0).cast("long"), F.lit(0.0), F.lit(False)

    def with_tail(s: Column) -> Column:
        return F.when(s["open"] & (s["n"] > 0), F.concat(s["done"], one(s["seq"], s["n"], s["length"], F.lit("tail")))).otherwise(s["done"])

    def step(s: Column, u: Column) -> Column:
        k = u["_kind"]
        silent = F.aggregate(u["_verdicts"], s["silent"], lambda r, v: F.when(v, 0).otherwise(r + 1))
        total, n = s["length"] + u["_len"], s["n"] + 1
        by_silence = (silent >= silence_limit) & (total >= least)
        cut = s["open"] & (by_silence | (total >= greatest))
        closed = F.concat(s["done"], one(s["seq"], n, total, F.when(by_silence, "silence").otherwise("max")))
        data = made(
            open=F.lit(True), paused=no, silent=F.when(cut, 0).otherwise(silent), n=F.when(cut, zero).otherwise(n), length=F.when(cut, none).otherwise(total),
            seq=s["seq"] + F.when(cut | ~s["open"], 1).otherwise(0), done=F.when(cut, closed).otherwise(s["done"]),
        )
        shut = dict(open=no, silent=F.lit(0), n=zero, length=none, seq=s["seq"])
        paused = made(paused=F.lit(True), done=s["done"], **shut)
        resumed = made(**{n: F.lit(False) if n == "paused" else s[n] for n in names})
        return F.when(k == "pause", paused).when(k == "resume", resumed).when(k == "eof", made(paused=s["paused"], done=with_tail(s), **shut)).when(s["paused"], s).otherwise(data)

    u = F.struct(*[c for c in rows.columns if c not in ("_key", "_seed")])
    start = made(open=no, paused=no, silent=F.lit(0), n=zero, length=none, seq=F.col("_seed"), done=F.array().cast("array<struct<seq:bigint,n_units:bigint,length:double,reason:string>>"))
    grouped = rows.groupBy("_key").agg(F.array_sort(F.collect_list(u)).alias("units"), F.first("_seed").alias("_seed"))
    folded = grouped.select("_key", F.aggregate("units", start, step, with_tail).alias("done"))
    return folded.select(F.col("_key").alias(key), F.explode("done").alias("s")).select(key, "s.seq", "s.n_units", "s.length", "s.reason")


class Cutter:
    """The fold's state for one key at a time, unit by unit."""

    def __init__(self, silence_limit: int, least: float, greatest: float):
        self.limits = silence_limit, least, greatest
        self.begin()

    def begin(self, seq: int = 0) -> None:
        """Forgets all; `seq` is the last number used."""
        self.open, self.paused, self.silent, self.n, self.length, self.seq = False, False, 0, 0, 0.0, seq

    def take(self, kind: str, length: float, verdicts: Iterable[bool]) -> tuple[int, int, float, str] | None:
        """The segment (seq, units, length, reason) that this row closes."""
        if kind == "pause":
            self.pause()
        elif kind == "resume":
            self.paused = False
        elif kind == "eof":
            return self.tail()
        elif not self.paused:
            return self.add(length, verdicts)
        return None

    def add(self, length: float, verdicts: Iterable[bool]) -> tuple[int, int, float, str] | None:
        hush, spoke = 0, False
        for speech in verdicts:
            hush, spoke = (0, True) if speech else (hush + 1, spoke)
        return self.add_run(length, hush, spoke)

    def add_run(self, length: float, hush: int, spoke: bool) -> tuple[int, int, float, str] | None:
        """A unit whose last `hush` frames are silent, after one with speech if it `spoke`."""
        limit, least, greatest = self.limits
        self.silent = hush if spoke else self.silent + hush
        self.n, self.length = self.n + 1, self.length + length
        by_silence = self.silent >= limit and self.length >= least
        if not self.open:
            self.open, self.seq = True, self.seq + 1
            return None
        if not by_silence and self.length < greatest:
            return None
        done = self.seq, self.n, self.length, "silence" if by_silence else "max"
        self.silent, self.n, self.length, self.seq = 0, 0, 0.0, self.seq + 1
        return done

    def _shut(self) -> None:
        self.open, self.silent, self.n, self.length = False, 0, 0, 0.0

    def pause(self) -> None:
        """The open segment goes, and its number with it."""
        self._shut()
        self.paused = True

    def tail(self) -> tuple[int, int, float, str] | None:
        done = (self.seq, self.n, self.length, "tail") if self.open and self.n else None
        self._shut()
        return done


def sorted_by_key(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows dealt by _key and sorted by it and `order` within partitions; an external sort, so it spills."""
    return rows.repartition("_key").sortWithinPartitions("_key", *order)


def segment_runs(units: DataFrame, key: str, order: list[str], length: Column, speech: Column, silence_limit: int, least: float, greatest: float, kind: Column | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """As segment_fold, for keys of any length."""
    rows = _rows(units, key, order, length, speech, kind, seeds)
    by = [c for c in rows.columns if c not in ("_key", "_seed")]
    spoken = F.array_position(F.reverse("_verdicts"), True)  # from the end; 0 where there is none
    hush = F.when(spoken > 0, spoken - 1).otherwise(F.size("_verdicts")).cast("int")
    what = F.when(F.col("_kind") == "data", 0).when(F.col("_kind") == "pause", 1).when(F.col("_kind") == "resume", 2).when(F.col("_kind") == "eof", 3).otherwise(0)
    rows = sorted_by_key(rows, by).select("_key", what.alias("_what"), "_len", hush.alias("_hush"), (spoken > 0).alias("_spoke"), "_seed")
    of = rows.schema["_key"].dataType.simpleString()
    names = ("data", "pause", "resume", "eof")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, at, begun = Cutter(silence_limit, least, greatest), None, False
        key_type = None
        for batch in batches:
            key_type, out = batch.schema.field(0).type, []
            flat = [c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns[1:]]
            for k, what, n, hush, spoke, seed in zip(batch.column(0).to_pylist(), *flat, strict=True):
                if not begun or k != at:
                    if begun and (t := cutter.tail()):
                        out.append((at, *t))
                    cutter.begin(seed)
                    at, begun = k, True
                if what:
                    done = cutter.take(names[what], n, ())
                elif not cutter.paused:
                    done = cutter.add_run(n, hush, spoke)
                else:
                    continue
                if done:
                    out.append((k, *done))
            if out:
                yield _batch(out, key_type)
        if begun and (t := cutter.tail()):
            yield _batch([(at, *t)], key_type)

    return rows.mapInArrow(run, f"`{key}` {of}, seq long, n_units long, length double, reason string")


segment = segment_runs


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [key_type, pa.int64(), pa.int64(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "seq", "n_units", "length", "reason"])


def island_runs(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """df with `run`: how many rows in a row, up to this one, have the flag set (0 where it is not).

    A running window: a key's rows are sorted in one task (they spill, they are not held).
    """
    from pyspark.sql import Window

    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_island", F.count_if(~F.col("_flag")).over(upto))
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("run", F.count_if("_flag").over(inside)).drop("_flag", "_island")
