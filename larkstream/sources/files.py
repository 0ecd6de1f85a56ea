"""Workspace listing and WAV files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkstream.functions import text


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Files of a folder: path, name, length; the contents are not read. Spark leaves out files without a single byte."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def segment_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("name").endswith(".wav")).withColumn("seg_id", text.stem(F.col("name"))).withColumn("source_id", text.source_of_file(F.col("name")))


def with_samples(files: DataFrame) -> DataFrame:
    """Files longer than a header of 44 bytes."""
    return files.where(F.col("length") > 44)


def wav_bytes(samples: np.ndarray, rate: int = 16_000) -> bytes:
    """A mono 16-bit file."""
    data = np.asarray(samples, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def parse_wav(content: bytes) -> dict:
    """channels, bits, rate and samples of a RIFF file; `error` where it is none or not mono 16-bit."""
    out: dict = {"rate": None, "samples": None, "error": None}
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return out | {"error": "no WAVE file"}
    at, fmt, data = 12, None, None
    while at + 8 <= len(content):
        tag, n = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if tag == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", content, at + 8)
        elif tag == b"data":
            data = content[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if not fmt or data is None:
        return out | {"error": "no format or data"}
    if fmt[1] != 1 or fmt[5] != 16:
        return out | {"rate": fmt[2], "error": f"{fmt[1]} channels of {fmt[5]} bits"}
    return {"rate": fmt[2], "samples": np.frombuffer(data[: len(data) // 2 * 2], "<i2").tolist(), "error": None}


def decode_wav(content: Column) -> Column:
    @F.pandas_udf("rate int, samples array<smallint>, error string")
    def decode(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in contents:
            yield pd.DataFrame([parse_wav(bytes(c)) for c in s], columns=["rate", "samples", "error"])

    return decode(content)


def read_wav(spark: SparkSession, folder: str) -> DataFrame:
    """name, rate, samples, error of each .wav file in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    decoded = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), decode_wav("content").alias("w"))
    return decoded.select("name", "w.*")


def header_duration(content: Column) -> Column:
    """Seconds by the header of a file with the usual 44 bytes of it; null where the rate is 0."""
    rate = F.conv(F.hex(F.reverse(F.substring(content, 25, 4))), 16, 10).cast("long")
    return F.when((rate > 0) & (F.length(content) >= 44), (F.length(content) - 44) / 2 / rate)


def encode_wav(samples: Column) -> Column:
    """Mono 16 kHz files as binary values."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: wav_bytes(np.asarray(x, "<i2")))

    return encode(samples)


def make_folder(spark: SparkSession, folder: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def store(path: str):
    """File system and bare path of a path or URI, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_wavs(segments: DataFrame, folder: str) -> DataFrame:
    """Writes segments (seg_id, samples) as files into a folder or URI that all executors share, each under a temporary
    name first and then renamed, so that a reader or a second attempt never sees half a file; segments without samples
    leave none. Returns the files (seg_id, path) and writes when that is evaluated."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        system, root = store(folder)
        for f in frames:
            out = []
            for seg_id, samples in zip(f["seg_id"], f["samples"], strict=True):
                if samples is not None and len(samples):
                    part = f"{root}/{seg_id}.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(part) as file:
                        file.write(wav_bytes(np.asarray(samples, "<i2")))
                    system.move(part, f"{root}/{seg_id}.wav")
                    out.append((seg_id, f"{folder}/{seg_id}.wav"))
            yield pd.DataFrame(out, columns=["seg_id", "path"])

    return segments.select("seg_id", "samples").mapInPandas(run, "seg_id string, path string")


def delete_files(files: DataFrame) -> DataFrame:
    """Deletes the files at `path`, where the rows are; path, gone and error of each, when that is evaluated.

    A file that is not there any more counts as gone; any other failure is a row, not a failed job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for path in f["path"]:
                try:
                    system, bare = store(path)
                    system.delete_file(bare)
                    out.append((path, True, None))
                except FileNotFoundError:
                    out.append((path, True, None))
                except OSError as e:
                    out.append((path, False, str(e)))
            yield pd.DataFrame(out, columns=["path", "gone", "error"])

    return files.select("path").mapInPandas(run, "path string, gone boolean, error string")


def pcm_bytes(samples: Column) -> Column:
    """16-bit samples as little-endian bytes."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: np.asarray(x, "<i2").tobytes())

    return encode(samples)


def pcm_samples(content: Column) -> Column:
    """Little-endian bytes as 16-bit samples; an odd last byte is dropped."""

    @F.pandas_udf("array<smallint>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: np.frombuffer(b[: len(b) // 2 * 2], "<i2"))

    return decode(content)
