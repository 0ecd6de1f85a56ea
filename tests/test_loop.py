"""The loop from chunks to transcript: a crash between append and deletion, a stop in between, every segment once."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkstream.operators import asr
from larkstream.operators.segment import Cutter
from larkstream.sources import transcript, wav
from larkstream.streaming import loop, queue_source

LIMITS = 5, 0.2, 1.0


def load():
    return lambda frame: bool(np.abs(frame).max() > 100)


def is_speech(frame):
    return F.exists(frame, lambda x: F.abs(x) > 100)


def signal(source, n):
    """Chunks, loud and quiet by turns."""
    return [np.full(512, 1000 + k if (k // (7 + source)) % 2 == 0 else 0, np.int16) for k in range(n)]


def model(chunks):
    """Segments as lists of samples."""
    c, out, held, left = Cutter(*LIMITS), [], [], np.zeros(0, np.int16)
    for x in chunks:
        line = np.concatenate([left, x])
        whole = len(line) // 320 * 320
        left = line[whole:]
        held.append(x)
        if c.add(len(x) / 16_000, [load()(line[i : i + 320]) for i in range(0, whole, 320)]):
            out.append(np.concatenate(held))
            held = []
    return [*out, np.concatenate(held)] if held else out


def test_every_segment_once(spark, tmp_path):
    queue, wavs, lines, checkpoint = (str(tmp_path / n) for n in ("q", "wavs", "lines", "c"))
    (tmp_path / "q").mkdir()
    want, expected = {s: model(signal(s, 60)) for s in (0, 1)}, {}
    for s, segments in want.items():
        for k, x in enumerate(segments, 1):
            if np.any(x):  # silent ones are dropped
                expected[f"src{s}_{k:06d}"] = s
    step = lambda **how: loop.recognise(spark, wavs, lines, is_speech, asr.transcriber(asr.CountingEngine), F.lit("2024-01-01 00:00:00").cast("timestamp"), 0.0 if how.get("no_gate") else 0.15, how.get("after"))

    def run(n_files):
        query = loop.record(loop.recorded(queue_source.chunks(spark, queue, 512, 3), load, *LIMITS, 4_000), wavs, checkpoint, 0.3)
        try:
            end = time.time() + 90
            while time.time() < end and len(list((tmp_path / "wavs").glob("*.wav"))) < n_files:
                assert query.exception() is None
                time.sleep(0.3)
        finally:
            query.stop()

    for s in (0, 1):
        x = signal(s, 60)
        for k in range(0, 30, 10):
            queue_source.put(queue, s, k, np.concatenate(x[k : k + 10]))
    run(4)  # stopped with segments open

    def crash():
        raise OSError("lost")

    with pytest.raises(OSError):
        step(after=crash)
    first = {r.seg_id for r in transcript.read_entries(spark, lines).collect()}
    assert first and {p.stem for p in (tmp_path / "wavs").glob("*.wav")} >= first  # written, but not deleted
    step()
    assert not {p.stem for p in (tmp_path / "wavs").glob("*.wav")}
    for s in (0, 1):
        x = signal(s, 60)
        for k in range(30, 60, 10):
            queue_source.put(queue, s, k, np.concatenate(x[k : k + 10]))
    rest = sum(map(len, want.values())) - len([1 for s, w in want.items() for k in range(len(w)) if f"src{s}_{k + 1:06d}" in first])
    run(rest)
    files = {p.stem: p for p in (tmp_path / "wavs").glob("*.wav")}
    for name, p in files.items():
        source, k = int(name[3]), int(name[5:])
        assert np.array_equal(np.frombuffer(p.read_bytes()[44:], "<i2"), want[source][k - 1]), name
    while step():
        pass
    got = [r.seg_id for r in transcript.read_entries(spark, lines).collect()]
    assert sorted(got) == sorted(expected) and len(got) == len(set(got))
    assert not list((tmp_path / "wavs").glob("*.wav"))


def test_failed_recognition_is_tried_again(spark, tmp_path):
    class Broken:
        def name(self):
            return "broken"

        def transcribe(self, samples):
            raise ValueError("no")

    wavs, lines = str(tmp_path / "w"), str(tmp_path / "t")
    wav.write_segments(spark.createDataFrame([("src0_000001", [1000] * 400), ("src1_000002", [0] * 400)], "seg_id string, samples array<smallint>"), wavs)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert loop.recognise(spark, wavs, lines, is_speech, asr.transcriber(Broken), now) == 2
    assert [p.stem for p in (tmp_path / "w").glob("*.wav")] == ["src0_000001"]
    assert loop.recognise(spark, wavs, lines, is_speech, asr.transcriber(asr.CountingEngine), now) == 1
    assert [tuple(r)[:3] for r in transcript.read_entries(spark, lines).drop("line_no").collect()] == [("src0_000001", 0, "400 samples")]
    assert loop.recognise(spark, wavs, lines, is_speech, asr.transcriber(asr.CountingEngine), now) == 0
