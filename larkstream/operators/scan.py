"""Running values over all earlier rows of a key, without a task that reads a whole key.

Rows are dealt by ranges of key and order, so a key with many rows lies in many partitions, one after
another. A scan reads each partition twice, at the same time as all others: first for what its rows do to the
running value (one row for each partition reaches the driver, which adds them up in the order of partitions), then,
with the value that the rows before it have left, for the value at each row. That works for any state whose
steps can be summed up before the state is known: counts, sums, runs that a row sets back, last values.

`in_order` makes the partitions and writes them, so both readings see the same; scans and maps on what it
gives keep partitions and order, so they can follow each other without another shuffle.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkstream.session import cut

PART, KEY = "_part", "_key"


def in_order(df: DataFrame, key: str | Column, order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """df with _part and _key, dealt by ranges of key and order and sorted in them. Rows equal in both lie together.

    Without a number there are as many partitions as the session gives a shuffle.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn(KEY, F.col(key) if isinstance(key, str) else key)
    by = [F.col(KEY), *[F.col(c) if isinstance(c, str) else c for c in order]]
    return cut(keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()))


class Run:
    """A sum of `add` since the last row at which `reset` holds (that row's `add` is the first). Nulls add 0 and do not reset.

    Sums of doubles are added up partition by partition, so their last bits depend on the partitions.
    """

    def __init__(self, add: Column, reset: Column | None = None, kind: str = "bigint"):
        self.inputs = [F.coalesce(add.cast(kind), F.lit(0).cast(kind)), F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)]
        self.kind = self.result = kind

    def start(self) -> tuple:
        return (0, False)

    def join(self, a: tuple, b: tuple) -> tuple:
        """The state after rows that leave a, then rows that leave b."""
        return b if b[1] else (a[0] + b[0], a[1])

    def over(self, columns: list[pa.Array], carry: tuple) -> tuple[pa.Array, tuple]:
        """The value at each row of one key, after rows that left `carry`, and what all of them leave."""
        add, reset = columns[0].to_numpy(zero_copy_only=False), columns[1].to_numpy(zero_copy_only=False)
        upto = np.cumsum(add)
        last = np.maximum.accumulate(np.where(reset, np.arange(len(add)), -1))
        base = np.where(last >= 0, upto[last] - add[last], -carry[0])
        values = upto - base
        return pa.array(values, columns[0].type), (values[-1].item(), bool(carry[1] or last[-1] >= 0))


class Last:
    """The last value that is not null, this row's included; `before` where there is none yet."""

    def __init__(self, value: Column, kind: str, before: Any = None):
        self.inputs, self.result, self.before = [value.cast(kind)], kind, before

    def start(self) -> tuple:
        return (None, False)

    def join(self, a: tuple, b: tuple) -> tuple:
        return b if b[1] else a

    def over(self, columns: list[pa.Array], carry: tuple) -> tuple[pa.Array, tuple]:
        column = columns[0]
        known = column.is_valid().to_numpy(zero_copy_only=False)
        last = np.maximum.accumulate(np.where(known, np.arange(len(column)), -1))
        held = pa.concat_arrays([column, pa.array([carry[0] if carry[1] else self.before], column.type)])
        values = held.take(pa.array(np.where(last >= 0, last, len(column))))
        state = (column[int(last[-1])].as_py(), True) if last[-1] >= 0 else carry
        return values, state


class Before:
    """The value at the row before, null at the first."""

    def __init__(self, value: Column, kind: str):
        self.inputs, self.result = [value.cast(kind)], kind

    def start(self) -> tuple:
        return (None,)

    def join(self, a: tuple, b: tuple) -> tuple:
        return b

    def over(self, columns: list[pa.Array], carry: tuple) -> tuple[pa.Array, tuple]:
        column = columns[0]
        return pa.concat_arrays([pa.array([carry[0]], column.type), column.slice(0, len(column) - 1)]), (column[len(column) - 1].as_py(),)


def breaks(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it (nulls are equal), from the second on."""
    if len(column) < 2:
        return np.zeros(0, np.int64)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(differs) + 1


def _spans(column: pa.Array) -> Iterator[tuple[int, int]]:
    cuts = [0, *breaks(column).tolist(), len(column)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _bare(measures: dict) -> dict:
    """The measures without their columns, which do not go to tasks."""
    out = {}
    for name, m in measures.items():
        out[name] = copy.copy(m)
        out[name].inputs = len(m.inputs)
    return out


def scan(ranged: DataFrame, measures: dict[str, Run | Last | Before]) -> DataFrame:
    """What `in_order` gave, with a column for each measure."""
    flat = [c.alias(f"_in{i}") for i, c in enumerate(c for m in measures.values() for c in m.inputs)]
    held, names = _bare(measures), [f"_in{i}" for i in range(len(flat))]
    given = ranged.select("*", *flat)
    key_type = ranged.schema[KEY].dataType

    def walk(columns: list[pa.Array], key: pa.Array, at: tuple | None):
        """start, end, key, values and states of each run of a key; at: the key and states that the rows before have left."""
        for i, j in _spans(key):
            k = key[i].as_py()
            states = at[1] if at is not None and at[0] == k else [m.start() for m in held.values()]
            after, values, c = [], [], 0
            for m, s in zip(held.values(), states, strict=True):
                v, state = m.over([x.slice(i, j - i) for x in columns[c : c + m.inputs]], s)
                values.append(v)
                after.append(state)
                c += m.inputs
            at = (k, after)
            yield i, j, k, values, after

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, one, at, key_kind = None, None, True, None, None
        for b in batches:
            if not b.num_rows:
                continue
            key_kind = b.schema.field(KEY).type
            columns = [b[c] for c in names]
            part = b[PART][0].as_py()
            for _, _, k, _, after in walk(columns, b[KEY], at):
                if at is None:
                    first = k
                elif at[0] != k:
                    one = False
                at = (k, after)
        if at is not None:
            row = [pa.array([part], pa.int32()), pa.array([first], key_kind), pa.array([at[0]], key_kind), pa.array([one]), pa.array([pickle.dumps(at[1])], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["part", "first", "last", "one", "states"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", key_type), T.StructField("last", key_type), T.StructField("one", T.BooleanType()), T.StructField("states", T.BinaryType())])
    found = given.select(PART, KEY, *names).mapInArrow(summary, schema).toArrow().sort_by("part").to_pylist()  # a row for each partition
    carries = _carries(found, held)
    results = T.StructType([*ranged.schema.fields, *T.StructType.fromDDL(", ".join(f"`{name}` {m.result}" for name, m in measures.items())).fields])
    kept = ranged.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun = None, False
        for b in batches:
            if not b.num_rows:
                continue
            if not begun:
                at, begun = carries.get(b[PART][0].as_py()), True
            out = [[] for _ in held]
            for _, _, k, values, after in walk([b[c] for c in names], b[KEY], at):
                at = (k, after)
                for o, v in zip(out, values, strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], *[pa.concat_arrays(o) for o in out]], [*kept, *held])

    return given.mapInArrow(apply, results)


def _carries(found: list[dict], measures: dict) -> dict[int, tuple]:
    """By partition, the key and states that the partitions before it have left, where its first key goes on."""
    carries, at = {}, None
    for row in found:
        states = pickle.loads(row["states"])
        if at is not None and at[0] == row["first"]:
            carries[row["part"]] = at
            if row["one"]:
                states = [m.join(a, b) for m, a, b in zip(measures.values(), at[1], states, strict=True)]
        at = (row["last"], states)
    return carries


def after_scan(df: DataFrame) -> DataFrame:
    return df.drop(PART, KEY)


def run_lengths(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """df with `run`: how many rows in a row, up to this one, have the flag set (0 where it is not); for keys of any size."""
    on = F.coalesce(flag, F.lit(False))
    return after_scan(scan(in_order(df, key, order), {"run": Run(on.cast("int"), ~on)}))


def while_on(df: DataFrame, key: str, order: list[str], turns_on: Column, turns_off: Column, at_first: bool) -> DataFrame:
    """As `views.while_on`, for keys of any size."""
    control = F.when(turns_on, True).when(turns_off, False)
    rows = scan(in_order(df, key, order).withColumn("_control", control), {"_on": Last(F.col("_control"), "boolean", at_first)})
    return after_scan(rows.where("_on and _control is null").drop("_on", "_control"))


def running_height(df: DataFrame, key: str, order: list[str], height: str) -> DataFrame:
    """As `views.running_height`, for keys of any size: the total of a key is an aggregate that is joined."""
    rows = scan(in_order(df, key, order), {"_upto": Run(F.col(height))})
    totals = rows.groupBy(F.col(KEY).alias("_of")).agg(F.max(F.struct(PART, "_upto")).alias("_m"), F.sum(F.col(height).cast("bigint")).alias("total")).drop("_m")
    return after_scan(rows.join(totals, F.col(KEY).eqNullSafe(F.col("_of")), "left").withColumn("offset", F.col("_upto") - F.coalesce(F.col(height), F.lit(0))).drop("_upto", "_of"))


def edges(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """As `views.edges`, for keys of any size."""
    rows = scan(in_order(df, key, order).withColumn("_f", flag), {"_before": Before(F.col("_f"), "boolean")})
    return after_scan(rows.where("_before and not _f").drop("_f", "_before"))


def configured(df: DataFrame, key: str, order: list[str], change: Column, setting: Column, kind: str, at_first: Any) -> DataFrame:
    """As `views.configured`, for keys of any size."""
    rows = in_order(df, key, order).withColumn("_change", F.coalesce(change, F.lit(False)))
    rows = scan(rows, {"config": Last(F.when(F.col("_change"), setting), kind, at_first), "generation": Run(F.col("_change").cast("int"))})
    return after_scan(rows.where("not _change").drop("_change"))


# ---- windows of a fixed number of rows to either side


def near(ranged: DataFrame, flag: Column, pad: int, name: str) -> DataFrame:
    """What `in_order` gave, with `name`: whether the flag is set in a row of the key at most `pad` rows before or after.

    Each partition gets the flags of the `pad` rows of its first and last key beyond its ends from its neighbours
    (a halo): 2 * pad flags of each partition pass the driver.
    """
    given, kept, key_type = ranged.select("*", F.coalesce(flag, F.lit(False)).alias("_flag")), ranged.columns, ranged.schema[KEY].dataType

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, head, last, tail, one, kind = None, None, [], None, [], True, None
        for b in batches:
            flags = b["_flag"].to_numpy(zero_copy_only=False)
            for i, j in _spans(b[KEY]) if b.num_rows else ():
                k, kind = b[KEY][i].as_py(), b.schema.field(KEY).type
                if part is None:
                    part, first, last = b[PART][0].as_py(), k, k
                if k != last:
                    one, last, tail = False, k, []
                if one and len(head) < pad:
                    head += flags[i : min(j, i + pad - len(head))].tolist()
                tail = (tail + flags[max(i, j - pad) : j].tolist())[-pad:] if pad else []
        if part is not None:
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (first, kind), (head, pa.list_(pa.bool_())), (last, kind), (tail, pa.list_(pa.bool_())), (one, pa.bool_()))]
            yield pa.RecordBatch.from_arrays(row, ["part", "first", "head", "last", "tail", "one"])

    fields = [T.StructField("part", T.IntegerType()), T.StructField("first", key_type), T.StructField("head", T.ArrayType(T.BooleanType())), T.StructField("last", key_type), T.StructField("tail", T.ArrayType(T.BooleanType())), T.StructField("one", T.BooleanType())]
    found = given.select(PART, KEY, "_flag").mapInArrow(summary, T.StructType(fields)).toArrow().sort_by("part").to_pylist()
    halos = _halos(found, pad)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        groups, flags, context, part, at = np.zeros(0, np.int64), np.zeros(0, bool), 0, None, (None, 0)

        def made(n_context: int) -> pa.RecordBatch:
            b = held.pop(0)
            at_rows = np.arange(n_context, n_context + b.num_rows)
            mine = groups[at_rows]
            low = np.maximum(at_rows - pad, np.searchsorted(groups, mine, "left"))
            high = np.minimum(at_rows + pad + 1, np.searchsorted(groups, mine, "right"))
            upto = np.concatenate([[0], np.cumsum(flags)])
            return pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(upto[high] > upto[low])], [*kept, name])

        for b in batches:
            if not b.num_rows:
                continue
            steps = np.zeros(b.num_rows, np.int64)
            steps[breaks(b[KEY])] = 1
            if part is None:
                part = b[PART][0].as_py()
                before = halos[part][0]
                groups, flags, context = np.zeros(len(before), np.int64), np.array(before, bool), len(before)
            elif b[KEY][0].as_py() != at[0]:
                steps[0] = 1
            mine = at[1] + np.cumsum(steps)
            at = (b[KEY][b.num_rows - 1].as_py(), int(mine[-1]))
            groups, flags = np.concatenate([groups, mine]), np.concatenate([flags, b["_flag"].to_numpy(zero_copy_only=False)])
            held.append(b)
            while held and len(groups) - context - held[0].num_rows >= pad:
                n = held[0].num_rows
                yield made(context)
                drop = max(0, context + n - pad)
                groups, flags, context = groups[drop:], flags[drop:], context + n - drop
        if part is not None:
            after = halos[part][1]
            groups, flags = np.concatenate([groups, np.full(len(after), at[1], np.int64)]), np.concatenate([flags, np.array(after, bool)])
            while held:
                n = held[0].num_rows
                yield made(context)
                context += n

    return given.mapInArrow(apply, T.StructType([*ranged.schema.fields, T.StructField(name, T.BooleanType())]))


def _halos(found: list[dict], pad: int) -> dict[int, tuple[list[bool], list[bool]]]:
    """By partition, the flags of the last rows before it of its first key, and of the first rows after it of its last key."""

    def side(rows: list[dict], near_key: str, far_key: str, far_flags: str, joined) -> dict[int, list[bool]]:
        out, key, flags = {}, None, []
        for i, row in enumerate(rows):
            mine = flags if i and key == row[near_key] else []
            out[row["part"]] = mine
            flags = joined(mine, row[far_flags]) if row["one"] else row[far_flags]
            key = row[far_key]
        return out

    before = side(found, "first", "last", "tail", lambda a, b: (a + b)[-pad:] if pad else [])
    after = side(found[::-1], "last", "first", "head", lambda a, b: (b + a)[:pad])
    return {row["part"]: (before[row["part"]], after[row["part"]]) for row in found}


def dilate(frames: DataFrame, key: str, order: list[str], speech: Column, pad: int, compacted: bool = False) -> DataFrame:
    """As `gate.dilate`, for keys of any size; `compacted` as `gate.compact` of that, in the same partitions."""
    rows = near(in_order(frames, key, order), speech, pad, "keep")
    if compacted:
        rows = scan(rows.where("keep"), {"position": Run(F.lit(1))}).withColumn("position", F.col("position") - 1)
    return after_scan(rows)
