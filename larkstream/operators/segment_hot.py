"""Segmentation of keys of any size: what `operators.segment` cuts row by row, cut in ranges of rows at once.

Lengths are whole numbers (samples), so prefix sums are exact. After a cut nothing is left of what came before,
so each row has one row at which a segment that begins after it ends. With prefix sums of lengths and
frames and the silence run at each row (all from `operators.scan`), that row is found by binary search: the
first one at which the length has reached its greatest, or the first quiet one at which the least
length and enough silent frames have been gathered since, whichever is earlier.

1. Rows lie in ranges of key and order. In each range, at the same time, every row gets the row that ends a segment
   begun after it, and by pointer doubling the last cut that a chain of cuts through it makes in this range. The
   segment that is open when a range begins ends in its head, the rows before `greatest` more samples have
   passed; of each range only its head and its end are handed on.
2. One task goes over these, range by range in order: the cut that a range leaves behind decides the first cut in the
   head of the next, and that one the last cut there. It holds one head at a time; heads are `greatest` long
   whatever the size of a range, so they are a small share of the rows.
3. With the cut that was made before it, each range emits its segments, again all at the same time.

The largest task reads one range. A range's numbers are held in memory, so ranges have about RANGE_ROWS rows, whatever
the session's number of partitions; `greatest` must be finite, and lengths must not be negative (they count as 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkstream.operators.scan import KEY, PART, Last, Run, breaks, in_order, scan


RANGE_ROWS = 250_000


class Chain:
    """The rows of one group (a key between two pauses) in one range, and where segments end."""

    def __init__(self, units: np.ndarray, total: np.ndarray, frames: np.ndarray, silent: np.ndarray, limits: tuple[int, int, int]):
        """Units, lengths and frames up to each row, counted over the whole key; frames since speech at each row."""
        self.units, self.total, self.frames = units, total, frames
        self.limit, self.least, self.greatest = limits
        self.quiet = np.flatnonzero(silent >= self.limit)

    def ends(self, total: np.ndarray, frames: np.ndarray, earliest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For segments begun after these totals: the row that ends each (as many as there are rows: none here), and whether by silence."""
        n = len(self.total)
        full = np.maximum(np.searchsorted(self.total, total + self.greatest), earliest)
        from_ = np.maximum(np.searchsorted(self.total, total + self.least), np.searchsorted(self.frames, frames + self.limit))
        at = np.searchsorted(self.quiet, np.maximum(from_, earliest))
        hushed = np.append(self.quiet, n)[at]
        return np.minimum(full, hushed), (hushed <= full) & (hushed < n)

    def after_each(self) -> tuple[np.ndarray, np.ndarray]:
        """As `ends`, for segments begun right after each row."""
        return self.ends(self.total, self.frames, np.arange(len(self.total)) + 1)

    def last_cuts(self) -> np.ndarray:
        """The last cut of the chain through each row, if that row is a cut: pointer doubling."""
        n = len(self.total)
        to = np.append(self.after_each()[0], n)
        to = np.where(to < n, to, np.arange(n + 1))
        while True:
            on = to[to]
            if np.array_equal(on, to):
                return to[:n]
            to = on

    def first(self, total: int, frames: int, earliest: int) -> tuple[int, bool]:
        end, silence = self.ends(np.array([total]), np.array([frames]), np.array([earliest]))
        return int(end[0]), bool(silence[0])


NUMBERS = ["_units", "_total", "_frames", "_silent"]


def _ranges(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[tuple[tuple, int, int]], list[np.ndarray], np.ndarray] | None:
    """Of one range: its number, groups (key and run, first row, end), the numbers of its rows, and their lengths and frames."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held).combine_chunks()
    column = lambda name: table[name].chunk(0)
    cuts = [0, *sorted({*breaks(column(KEY)).tolist(), *breaks(column("_run")).tolist()}), table.num_rows]
    groups = [((column(KEY)[i].as_py(), column("_run")[i].as_py()), i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return column(PART)[0].as_py(), groups, [column(c).to_numpy() for c in NUMBERS], np.stack([column("_len").to_numpy(), column("_n").to_numpy()])


def _chain(numbers: list[np.ndarray], i: int, j: int, limits: tuple[int, int, int]) -> Chain:
    return Chain(*[x[i:j] for x in numbers], limits)


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def segment_hot(units: DataFrame, key: str, order: list[str], samples: Column, speech: Column, silence_limit: int, least: int, greatest: int, kind: Column | None = None, seeds: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """One row per segment: key, seq, n_units, length (in samples), reason (silence, max or tail).

    Arguments as of `segment.segment`, with whole lengths. Ties of the order columns are in any order.
    """
    verdicts = speech if isinstance(units.select(speech).schema[0].dataType, T.ArrayType) else F.array(speech)
    verdicts = F.transform(F.coalesce(verdicts, F.array().cast("array<boolean>")), lambda v: F.coalesce(v, F.lit(True)))
    rows = units.select(
        F.col(key).alias("_k"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.coalesce(kind if kind is not None else F.lit("data"), F.lit("data")).alias("_kind"),
        F.greatest(F.coalesce(samples.cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint")).alias("_len"),
        verdicts.alias("_v"),
    )
    spoken = F.array_position(F.reverse("_v"), True)  # from the end; 0 if there is none
    rows = rows.withColumn("_n", F.size("_v").cast("bigint")).withColumn("_speech", spoken > 0).withColumn("_hush", F.when(spoken > 0, spoken - 1).otherwise(F.col("_n")).cast("bigint")).drop("_v")
    if partitions is None:  # a range is held in memory, so the number of ranges grows with the rows
        partitions = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // RANGE_ROWS))
    ranged = in_order(rows, "_k", [f"_o{i}" for i in range(len(order))], partitions)
    if kind is None:
        ranged = ranged.withColumn("_run", F.lit(0).cast("bigint"))
    else:
        paused = F.when(F.col("_kind") == "pause", True).when(F.col("_kind") == "resume", False)
        ranged = scan(ranged, {"_off": Last(paused, "boolean", False), "_run": Run(F.col("_kind").isin("pause", "eof").cast("int"))})
    data = ranged.where("_kind = 'data'" + (" and not _off" if kind is not None else ""))
    data = scan(data, {"_units": Run(F.lit(1)), "_total": Run(F.col("_len")), "_frames": Run(F.col("_n")), "_silent": Run(F.col("_hush"), F.col("_speech"))})
    data = data.select(PART, KEY, "_run", *NUMBERS, "_len", "_n")
    limits = (silence_limit, least, greatest)
    entries = _entries(data, limits)
    cuts = _cuts(data, limits, entries)
    numbered = scan(cuts, {"_seq": Run(F.col("opened"))})
    closed = numbered.where("reason is not null")
    if kind is not None:  # what a pause ends is dropped; a run is ended by the control row that closes it
        ends = ranged.where("_kind = 'pause'").select(F.col(KEY).alias("_of"), (F.col("_run") - 1).alias("_ended"))
        gone = (F.col("reason") == "tail") & F.col(KEY).eqNullSafe(F.col("_of")) & (F.col("_run") == F.col("_ended"))
        closed = closed.join(ends, gone, "left_anti")
    seq = F.col("_seq") - F.when(F.col("reason") == "tail", 0).otherwise(1)  # a cut has opened the next one already
    if seeds is None:
        return closed.select(F.col(KEY).alias(key), seq.alias("seq"), "n_units", "length", "reason")
    name, number = seeds.columns
    last = seeds.select(F.col(name).alias("_of"), F.col(number).cast("bigint").alias("_last"))
    joined = closed.join(last, F.col(KEY).eqNullSafe(F.col("_of")), "left")
    return joined.select(F.col(KEY).alias(key), (seq + F.coalesce("_last", F.lit(0))).alias("seq"), "n_units", "length", "reason")


def _entries(data: DataFrame, limits: tuple[int, int, int]) -> dict[int, tuple]:
    """By range: units, total and frames at the last cut before it, if its first group goes on from there, and whether its last group ends in it."""
    key_type = data.schema[KEY].dataType
    greatest = limits[2]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := _ranges(batches)):
            return
        part, groups, numbers, own = found
        out = []
        for which in sorted({0, len(groups) - 1}):
            (k, run), i, j = groups[which]
            chain = _chain(numbers, i, j, limits)
            before = [int(chain.units[0]) - 1, int(chain.total[0] - own[0][i]), int(chain.frames[0] - own[1][i])]
            last = chain.last_cuts()
            if which:  # begins here: only the cut that it leaves is of interest
                first, _ = chain.first(before[1], before[2], 1)
                out.append((part, which, k, run, len(groups), before, None, None, _leaves(chain, last, first, before)))
            else:
                n = min(int(np.searchsorted(chain.total, before[1] + greatest)) + 2, j - i)
                head = np.stack([chain.total[:n], chain.frames[:n], numbers[3][i : i + n] >= limits[0]])
                to = last[:n]
                left = np.stack([chain.units[to], chain.total[to], chain.frames[to]])
                out.append((part, which, k, run, len(groups), before, _pack(head), _pack(left), None))
        kinds = [pa.int32(), pa.int32(), key_kind, pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    key_kind = _arrow_type(key_type)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("k", key_type), T.StructField("run", T.LongType()), T.StructField("groups", T.IntegerType()), *T.StructType.fromDDL("before array<bigint>, head binary, to binary, left array<bigint>").fields])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, cut_at = [], None, None  # at: the group that the ranges so far have left open, and its last cut
        for b in batches:
            for row in b.to_pylist():
                of = (row["k"], row["run"])
                if row["place"]:
                    at, cut_at = of, row["left"]
                    continue
                goes_on = at == of
                if out:
                    out[-1]["ends"] = not goes_on
                out.append({"part": row["part"], "entry": cut_at if goes_on else None, "ends": True})
                head = np.frombuffer(row["head"], "<i8").reshape(3, -1)
                to = np.frombuffer(row["to"], "<i8").reshape(3, -1)
                chain = Chain(np.zeros(0), head[0], head[1], np.where(head[2] == 1, limits[0], -1), limits)
                start = cut_at if goes_on else row["before"]
                first, _ = chain.first(start[1], start[2], 0 if goes_on else 1)
                at, cut_at = of, (start if first >= head.shape[1] else to[:, first].tolist())
                if len(out) > 1000:
                    yield pa.RecordBatch.from_pylist(out[:-1], kinds)
                    out = out[-1:]
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema([("part", pa.int32()), ("entry", pa.list_(pa.int64())), ("ends", pa.bool_())])
    summary = data.mapInArrow(heads, schema).repartition(1).sortWithinPartitions("part", "place")
    rows = summary.mapInArrow(resolve, "part int, entry array<bigint>, ends boolean").collect()  # one for each range
    return {r["part"]: (list(r["entry"]) if r["entry"] is not None else None, r["ends"]) for r in rows}


def _leaves(chain: Chain, last: np.ndarray, first: int, before: list[int]) -> list[int]:
    """Units, total and frames at the last cut of a group whose first cut is at `first`."""
    if first >= len(last):
        return before
    to = last[first]
    return [int(chain.units[to]), int(chain.total[to]), int(chain.frames[to])]


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _cuts(data: DataFrame, limits: tuple[int, int, int], entries: dict[int, tuple]) -> DataFrame:
    """In order, with _part, _key and _run: a row where a group begins and one for each segment (n_units, length, reason); opened: numbers used up there."""
    key_type = data.schema[KEY].dataType
    key_kind = _arrow_type(key_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := _ranges(batches)):
            return
        part, groups, numbers, own = found
        entry, ends_here = entries[part]
        for which, ((k, group), i, j) in enumerate(groups):
            chain = _chain(numbers, i, j, limits)
            goes_on = which == 0 and entry is not None
            begin = entry if goes_on else [int(chain.units[0]) - 1, int(chain.total[0] - own[0][i]), int(chain.frames[0] - own[1][i])]
            units, total, frames = begin
            at, silence = chain.first(total, frames, 0 if goes_on else 1)
            ends, hushed = chain.after_each()
            rows = [] if goes_on else [(None, None, None, 1)]
            while at < j - i:
                rows.append((int(chain.units[at]) - units, int(chain.total[at]) - total, "silence" if silence else "max", 1))
                units, total = int(chain.units[at]), int(chain.total[at])
                at, silence = int(ends[at]), bool(hushed[at])
            if (which < len(groups) - 1 or ends_here) and int(chain.units[-1]) > units:
                rows.append((int(chain.units[-1]) - units, int(chain.total[-1]) - total, "tail", 0))
            for s in range(0, len(rows), 1 << 16):
                n_units, length, reason, opened = zip(*rows[s : s + (1 << 16)], strict=True)
                n = len(opened)
                columns = [pa.array([part] * n, pa.int32()), pa.array([k] * n, key_kind), pa.array([group] * n, pa.int64()), pa.array(n_units, pa.int64()), pa.array(length, pa.int64()), pa.array(reason, pa.string()), pa.array(opened, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField(KEY, key_type), *T.StructType.fromDDL("_run bigint, n_units bigint, length bigint, reason string, opened int").fields])
    return data.mapInArrow(run, schema)
