"""Noise gate, dilation and compaction over frame verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkstream.functions import audio

GATE = 0.15


def gate_action(ratio: Column, gate: float = GATE) -> Column:
    """pass, trim or drop; a gate of 0 or less passes all without measuring."""
    if gate <= 0:
        return F.lit("pass")
    return F.when(ratio == 0, "drop").when(ratio < gate, "trim").otherwise("pass")


def gate_ratio(frames: DataFrame, key: str, speech: Column, gate: float = GATE) -> DataFrame:
    """Per key: n_frames, n_speech, ratio, action. One aggregation with map-side partial sums."""
    counted = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(speech).alias("n_speech"))
    return counted.withColumn("ratio", F.col("n_speech") / F.col("n_frames")).withColumn("action", gate_action(F.col("ratio"), gate))


def any_speech(frames: DataFrame, key: str, speech: Column) -> DataFrame:
    """Per key: any_speech and seconds (of `key`'s rows as samples). One aggregation with map-side partial sums."""
    seconds = F.count(F.lit(1)) / float(audio.SAMPLE_RATE)
    return frames.groupBy(key).agg(F.coalesce(F.bool_or(speech), F.lit(False)).alias("any_speech"), seconds.alias("seconds"))


def dilate(frames: DataFrame, key: str, order: list[str], speech: Column, pad: int) -> DataFrame:
    """frames with `keep`: whether a speech frame lies within `pad` frames. A key's frames are sorted in one task (they spill)."""
    near = Window.partitionBy(key).orderBy(*order).rowsBetween(-pad, pad)
    return frames.withColumn("keep", F.max(speech).over(near))


def compact(frames: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Kept frames with their new position from 0; sorted by key as in `dilate`."""
    return frames.where("keep").withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def whole_frames(samples: DataFrame, key: str, order: list[str], width: int) -> DataFrame:
    """samples with the number of their frame of `width`; a partial last frame is dropped.

    Rows are numbered in a key's order, sorted in one task; the size of the last frame follows from the
    key's count, an aggregate that is summed up before it moves. Rows travel as a struct, so no name but
    `frame` is replaced.
    """
    rows = samples.select(F.struct("*").alias("record"), F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    run = Window.partitionBy("k").orderBy(*[f"o{i}" for i in range(len(order))])
    numbered = rows.withColumn("at", F.row_number().over(run) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    whole = numbered.where(F.expr(f"at < n - n % {width}"))
    return whole.select(*[F.col("record")[c].alias(c) for c in samples.columns if c != "frame"], F.expr(f"at div {width}").alias("frame"))
