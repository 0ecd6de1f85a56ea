"""The pluggable recogniser: samples to text, loaded once per Python worker, errors as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Engine(Protocol):
    def name(self) -> str: ...

    def transcribe(self, samples) -> str: ...


class CountingEngine:
    """A deterministic stand-in for tests: names the number of samples, and hears nothing in silence."""

    def name(self) -> str:
        return "counting"

    def transcribe(self, samples) -> str:
        return f"{len(samples)} samples" if np.any(samples) else ""


def heard(engine: Engine, samples: np.ndarray) -> tuple[str | None, str | None]:
    """Text and error; a failed segment is a row for the dead-letter table, not a failed job."""
    try:
        return engine.transcribe(samples).strip(), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def transcriber(load: Callable[[], Engine]) -> Callable[[Column], Column]:
    """A function of a samples column to struct(text, error). Filter before calling it: a condition around it does not spare calls."""

    @F.pandas_udf("text string, error string")
    def transcribe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = load()
        for s in batches:
            yield pd.DataFrame([heard(engine, np.asarray(x)) for x in s], columns=["text", "error"])

    return transcribe


def transcripts(segments: DataFrame, pcm: str, load: Callable[[], Engine]) -> DataFrame:
    """The segments that have a text or an error, with both, in place of `pcm`, little-endian 16-bit samples as bytes.

    A map that drops rows: a filter on the result of a function would be pushed below it, with a second call.
    """
    rest = [c for c in segments.columns if c != pcm]
    rows = segments.select(F.struct(*rest).alias("record"), F.col(pcm).alias("pcm"))
    schema = T.StructType().add("record", rows.schema["record"].dataType).add("text", T.StringType()).add("error", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = load()
        for b in batches:
            found = [heard(engine, np.frombuffer(x.as_buffer(), "<i2")) if x.is_valid else ("", None) for x in b.column(1)]
            kept = pa.array([t != "" for t, _ in found], pa.bool_())
            text, error = (pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else ((), ())))
            yield pa.RecordBatch.from_arrays([b.column(0), text, error], ["record", "text", "error"]).filter(kept)

    return rows.mapInArrow(run, schema).select("record.*", "text", "error")
