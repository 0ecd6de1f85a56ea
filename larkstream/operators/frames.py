"""Samples into chunks and frames, and an ordered classifier of frames.

A source's samples are one line; chunks arrive in any size. `rechunk` cuts the line anew into arrays of
one width (512 samples a chunk, 320 a frame), in the JVM; `frame_verdicts` hears frames one after another
with a classifier that may keep state. What does not fill a frame yet is carried to the next unit, over
segment cuts too; a pause clears it, and the classifier goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkstream.functions.audio import FRAME
from larkstream.operators.segment import sorted_by_key

Classifier = Callable[[np.ndarray], bool]


def rechunk(chunks: DataFrame, key: str, order: list[str], samples: str, width: int, resets: Column | None = None, partial: bool = False) -> DataFrame:
    """key, run, position (from 0 in each run) and samples (arrays of `width`).

    Rows at which `resets` is true begin a new run: what is left over before them is dropped, as is the
    end of each run, unless `partial` keeps it. The running window holds sizes, not samples; samples move
    once, to their new array. Null arrays are empty.
    """
    upto = Window.partitionBy("_key").orderBy(*[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(F.col(samples), F.array().cast(chunks.schema[samples].dataType)).alias("_s"), (F.coalesce(resets, F.lit(False)) if resets is not None else F.lit(False)).alias("_reset"))
    rows = rows.withColumn("_run", F.count_if("_reset").over(upto)).withColumn("_upto", F.sum(F.size("_s").cast("long")).over(upto))
    first = F.min(F.col("_upto") - F.size("_s")).over(Window.partitionBy("_key", "_run"))
    rows = rows.withColumn("_from", F.col("_upto") - F.size("_s") - first)
    # a chunk is cut where arrays end, so that whole pieces move instead of single samples
    pieces = F.transform(
        F.sequence(F.expr(f"_from div {width}"), F.expr(f"(_from + size(_s) - 1) div {width}")),
        lambda b: F.struct(b.alias("b"), F.greatest(b * width, F.col("_from")).alias("at"), F.slice("_s", (F.greatest(b * width - F.col("_from"), F.lit(0)) + 1).cast("int"), F.least((b + 1) * width - F.greatest(b * width, F.col("_from")), F.lit(width)).cast("int")).alias("x")),
    )
    cut = rows.where(F.size("_s") > 0).select("_key", "_run", F.explode(pieces).alias("p")).select("_key", "_run", "p.*")
    whole = cut.groupBy("_key", "_run", "b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])).alias("samples"))
    whole = whole if partial else whole.where(F.size("samples") == width)
    return whole.select(F.col("_key").alias(key), F.col("_run").alias("run"), F.col("b").alias("position"), "samples")


class Framer:
    """The frames of one source: samples in, verdicts of the frames that they complete out."""

    def __init__(self, classifier: Classifier, left: np.ndarray | None = None, width: int = FRAME):
        self.classifier, self.width = classifier, width
        self.left = np.zeros(0, np.int16) if left is None else left

    def hear(self, samples: np.ndarray) -> list[bool]:
        held = np.concatenate([self.left, np.asarray(samples, np.int16)])
        whole = len(held) // self.width * self.width
        self.left = held[whole:]
        return [self._verdict(held[k : k + self.width]) for k in range(0, whole, self.width)]

    def _verdict(self, frame: np.ndarray) -> bool:
        try:
            return bool(self.classifier(frame))
        except Exception:  # a frame that cannot be judged is kept: it counts as speech
            return True

    def pause(self) -> None:
        self.left = self.left[:0]


def frame_verdicts(units: DataFrame, key: str, order: list[str], samples: str, load: Callable[[], Classifier], kind: str | None = None) -> DataFrame:
    """The units with n_samples and verdicts (of the frames that end in each): key, the order columns, kind, n_samples, verdicts.

    `load` makes a classifier for each source, which gets its frames in order. Sorted partitions are read
    in Arrow batches, so memory does not grow with a source. Units while paused have no verdicts.
    """
    kinds = F.coalesce(F.col(kind), F.lit("data")) if kind else F.lit("data")
    rows = units.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], kinds.alias("_kind"), F.col(samples).cast("array<smallint>").alias("_s"))
    names = [f"_o{i}" for i in range(len(order))]
    rows = sorted_by_key(rows, [*names, "_kind"])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        framer, at, begun, paused = None, None, False, False
        for batch in batches:
            n, verdicts = [], []
            for k, what, s in zip(batch["_key"].to_pylist(), batch["_kind"].to_pylist(), batch["_s"], strict=True):
                if not begun or k != at:
                    framer, at, begun, paused = Framer(load()), k, True, False
                data = np.asarray(s.values) if s.is_valid else np.zeros(0, np.int16)
                if what == "pause":
                    framer.pause()
                    paused = True
                elif what == "resume":
                    paused = False
                heard = what == "data" and not paused
                n.append(len(data))
                verdicts.append(framer.hear(data) if heard else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int32()), pa.array(verdicts, pa.list_(pa.bool_()))], ["_key", *names, "_kind", "n_samples", "verdicts"])

    schema = ", ".join(f"{c} {types[c]}" for c in ("_key", *names, "_kind"))
    heard = rows.mapInArrow(run, f"{schema}, n_samples int, verdicts array<boolean>")
    return heard.select(F.col("_key").alias(key), *[F.col(f"_o{i}").alias(c) for i, c in enumerate(order)], F.col("_kind").alias("kind"), "n_samples", "verdicts")
