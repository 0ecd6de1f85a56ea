"""One segment from samples to transcript entry, as a single plan with a reason for each drop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkstream.functions import audio, text
from larkstream.operators.gate import GATE, gate_action


def process_segments(segments: DataFrame, transcribe: Callable[[Column], Column], now: Column, gate: float = GATE, pad_ms: int = 300) -> DataFrame:
    """segments (seg_id, source_id, samples, flags: a verdict per frame) with reason and, where it is kept, the entry.

    reason: empty, silent, no_text, error or kept. The recogniser sees only segments that pass the gate,
    which a filter below it makes sure of; the others are united with its results.
    """
    ratio = F.when(F.size("samples") < audio.FRAME, F.lit(1.0)).otherwise(audio.speech_ratio(F.col("flags")))
    measured = segments.withColumn("ratio", ratio).withColumn("action", F.when(F.size("samples") == 0, "empty").otherwise(gate_action(F.col("ratio"), gate)))
    trimmed = F.when(F.col("action") == "trim", audio.trim_to_speech(F.col("samples"), F.col("flags"), pad_ms)).otherwise(F.col("samples"))
    heard = measured.where(F.col("action").isin("pass", "trim")).withColumn("samples", trimmed)
    heard = heard.withColumn("asr", transcribe(F.col("samples")))
    blank = lambda kind: F.lit(None).cast(kind)
    lost = measured.where(~F.col("action").isin("pass", "trim")).select("seg_id", "source_id", "ratio", "action", F.when(F.col("action") == "empty", "empty").otherwise("silent").alias("reason"), blank("string").alias("text"), blank("double").alias("duration_sec"), blank("string").alias("timestamp"))
    reason = F.when(F.col("asr.error").isNotNull(), "error").when(F.col("asr.text") == "", "no_text").otherwise("kept")
    done = heard.select("seg_id", "source_id", "ratio", "action", reason.alias("reason"), F.col("asr.text").alias("text"), audio.duration_sec(F.col("samples")).alias("duration_sec"), text.to_rfc3339(now).alias("timestamp"))
    return lost.unionByName(done)
