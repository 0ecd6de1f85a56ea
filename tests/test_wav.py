"""WAV files in ranges, by headers, and through the sink: whole jobs or nothing."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkstream.sources import files, wav


def names(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.startswith("."))


def write(folder):
    r = np.random.default_rng(1)
    long = r.integers(-32768, 32767, 5_003).astype("<i2")
    (folder / "long.wav").write_bytes(wav.wav_bytes(long))
    (folder / "empty.wav").write_bytes(wav.wav_bytes([]))
    (folder / "slow.wav").write_bytes(wav.wav_bytes([1, 2, 3], 0))
    (folder / "bad.wav").write_bytes(b"nothing of the kind")
    body = wav.wav_bytes(long[:100])
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"  # an odd chunk is padded
    (folder / "extra.wav").write_bytes(body[:12] + extra + body[12:] + b"tail" + struct.pack("<I", 2) + b"zz")
    (folder / "cut.wav").write_bytes(body[:-31])  # ends in the middle of a sample
    (folder / "stereo.wav").write_bytes(body[:22] + struct.pack("<H", 2) + body[24:])


@pytest.mark.parametrize("width, per_range", [(7, 50), (100, 100), (1 << 20, 1 << 23), (13, 1)])
def test_ranges_equal_whole_files(spark, tmp_path, width, per_range):
    write(tmp_path)
    listed = files.listing(spark, str(tmp_path), "*.wav")
    got, errors = {}, {}
    for row in wav.samples(listed, width, per_range, 5).orderBy("name", "first").collect():
        if row.error is None:
            assert row["first"] == len(got.get(row.name, [])) and len(row.samples) <= width
            got.setdefault(row.name, []).extend(row.samples)
        else:
            errors[row.name] = row.error
    whole = {p.name: files.parse_wav(p.read_bytes()) for p in tmp_path.glob("*.wav")}
    assert got == {n: w["samples"] for n, w in whole.items() if w["error"] is None}
    assert errors == {n: w["error"] for n, w in whole.items() if w["error"] is not None}
    heads = {r.name: (r.n_samples, r.seconds, r.error) for r in wav.headers(listed).collect()}
    assert heads["long.wav"] == (5_003, 5_003 / 16_000, None) and heads["slow.wav"] == (3, None, None) and heads["bad.wav"][:2] == (None, None)
    assert wav.samples(listed.where("false")).count() == 0


def test_one_file_in_many_tasks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.wav_bytes(np.arange(20_000) % 999))
    read = wav.samples(files.listing(spark, str(tmp_path)), 100, 500, 8).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() == 8 and read.agg(F.sum(F.size("samples"))).first()[0] == 20_000


def segments(spark, n=40):
    return spark.range(n).select(F.format_string("src0_%06d", "id").alias("seg_id"), F.when(F.col("id") % 10 > 0, F.array_repeat(F.col("id").cast("smallint"), 5)).alias("samples")).repartition(4)


def test_segments_are_published_together(spark, tmp_path):
    wav.write_segments(segments(spark), str(tmp_path))
    want = [f"src0_{k:06d}.wav" for k in range(40) if k % 10]
    assert names(tmp_path) == want
    assert {r.name: r.samples for r in files.read_wav(spark, str(tmp_path)).collect()}[want[0]] == [1] * 5


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    from pyspark.errors import PySparkException

    failing = segments(spark).withColumn("samples", F.when(F.col("seg_id") == "src0_000033", F.raise_error(F.lit("lost")).cast("array<smallint>")).otherwise(F.col("samples")))
    with pytest.raises((PySparkException, Exception), match="lost"):
        wav.write_segments(failing, str(tmp_path))
    assert names(tmp_path) == []


def test_twins_and_lost_tasks_leave_nothing(tmp_path):
    """What the driver sees of a task that ran twice, and of one whose end it never heard of."""
    import pyarrow as pa

    batch = lambda k: pa.RecordBatch.from_pydict({"seg_id": [f"s{k}"], "samples": pa.array([[k, k]], pa.list_(pa.int16()))})
    w = wav.BatchWriter(str(tmp_path))
    first, _twin, _lost = w.write(iter([batch(1)])), w.write(iter([batch(1)])), w.write(iter([batch(2)]))
    assert not [n for n in names(tmp_path) if n.endswith(".wav")]
    w.commit([first, None])
    assert names(tmp_path) == ["s1.wav"]
    other = wav.BatchWriter(str(tmp_path))
    other.write(iter([batch(3)]))

    def breaks():
        yield batch(4)
        raise OSError("no disk")

    with pytest.raises(OSError):
        other.write(breaks())
    assert sum("s4" in n for n in names(tmp_path)) == 0
    other.abort([None])
    with pytest.raises(OSError):  # a task that was killed but goes on for a while
        other.write(iter([batch(5)]))
    assert names(tmp_path) == ["s1.wav"]


def test_a_stream_of_segments(spark, tmp_path):
    wav.register(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    segments(spark, 30).write.parquet(str(source))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("seg_id string, samples array<smallint>").option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.writeStream.format("segments").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert [n for n in names(out)] == [f"src0_{k:06d}.wav" for k in range(30) if k % 10]
