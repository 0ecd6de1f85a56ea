"""Segmentation: stated vectors through every form of the library, numbering, and any split of the stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkstream.operators import frames, segment
from larkstream.operators.segment import Cutter

CHUNK, RATE, SILENT, LOUD = 512, 16_000, 0, 1000
LIMITS = 40, 1.5, 10.0

#: chunks, verdict of each frame, paused chunks, greatest number already used, expected (seq, chunks, seconds)
VECTORS = {
    "always speech": (700, lambda f: True, (), 0, [(1, 313, 10.016), (2, 313, 10.016), (3, 74, 2.368)]),
    "never speech": (100, lambda f: False, (), 0, [(1, 47, 1.504), (2, 47, 1.504), (3, 6, 0.192)]),
    "silence cuts": (120, lambda f: f < 100, (), 0, [(1, 88, 2.816), (2, 32, 1.024)]),
    "silence before the least length": (60, lambda f: f < 25, (), 0, [(1, 47, 1.504), (2, 13, 0.416)]),
    "speech after the last silent frame of a chunk": (120, lambda f: f < 101 or f == 141, (), 0, [(1, 114, 3.648), (2, 6, 0.192)]),
    "the same without it": (120, lambda f: f < 101, (), 0, [(1, 89, 2.848), (2, 31, 0.992)]),
    "a pause consumes the number": (120, lambda f: True, range(61, 81), 0, [(2, 40, 1.28)]),
    "numbers go on": (50, lambda f: True, (), 7, [(8, 50, 1.6)]),
    "an empty segment is dropped": (47, lambda f: False, (), 0, [(1, 47, 1.504)]),
}


def stream_of(n_chunks, is_speech, paused):
    """(place, kind, samples): chunks whose frames are loud where there is speech, with control rows around a pause."""
    rows, frame, left = [], 0, 0  # samples of the frame that has begun
    for k in range(1, n_chunks + 1):
        if k in paused and k - 1 not in paused:
            rows.append((10 * k - 5, "pause", None))
            left = 0
        if k not in paused and k - 1 in paused:
            rows.append((10 * k - 5, "resume", None))
        x = np.zeros(CHUNK, np.int16)
        if k in paused:
            x[:] = LOUD
        else:
            for i in range(CHUNK):
                if left == 320:
                    frame, left = frame + 1, 0
                x[i] = LOUD if is_speech(frame) else SILENT
                left += 1
        rows.append((10 * k, "data", x.tolist()))
    return rows


def load():
    return lambda frame: bool(np.all(frame == LOUD))


def all_vectors(spark):
    """All vectors as sources of one table, with verdicts made by the library."""
    rows = [(s, *r) for s, (n, speech, paused, _, _) in enumerate(VECTORS.values()) for r in stream_of(n, speech, paused)]
    random.Random(3).shuffle(rows)
    chunks = spark.createDataFrame(rows, "src int, place int, kind string, samples array<smallint>")
    return frames.frame_verdicts(chunks, "src", ["place"], "samples", load, "kind")


def seeds(spark):
    return spark.createDataFrame([(s, v[3]) for s, v in enumerate(VECTORS.values()) if v[3]], "src int, max_seq long")


def by_vector(rows):
    got = {name: [] for name in VECTORS}
    for src, seq, n, length, _ in sorted(rows):
        got[list(VECTORS)[src]].append((seq, n, round(length, 3)))
    return got


@pytest.mark.parametrize("form", [segment.segment, segment.segment_fold, segment.segment_runs])
def test_stated_vectors(spark, form):
    units = all_vectors(spark)
    got = form(units, "src", ["place"], F.col("n_samples") / RATE, F.col("verdicts"), *LIMITS, F.col("kind"), seeds(spark))
    assert by_vector(map(tuple, got.collect())) == {name: v[4] for name, v in VECTORS.items()}


def test_stated_vectors_as_a_stream(spark, tmp_path):
    from larkstream.streaming.segments import replay, run_to_end, segment_stream

    units = all_vectors(spark).select(F.col("src").alias("key"), F.col("place").cast("long").alias("ord"), (F.col("n_samples") / RATE).alias("length"), "verdicts", "kind").cache()
    ends = units.select("key").distinct().select("key", F.lit(10**9).cast("long").alias("ord"), F.lit(0.0).alias("length"), F.array().cast("array<boolean>").alias("verdicts"), F.lit("eof").alias("kind"))
    for part in (units.where("ord < 400"), units.where("ord >= 400"), ends):  # a stop and a restart between the parts
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = segment_stream(replay(spark, str(tmp_path / "in"), units.schema), *LIMITS, seeds(spark).withColumnRenamed("src", "key"))
        got = run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert by_vector(map(tuple, got.collect())) == {name: v[4] for name, v in VECTORS.items()}


def test_other_sources_are_dropped(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 2, 255, -1, None)], "source_id int")
    assert [r.source_id for r in segment.known_sources(df).orderBy("source_id").collect()] == [0, 1]


def test_frames_that_cannot_be_judged_are_speech():
    def fails(frame):
        raise ValueError("no verdict")

    assert frames.Framer(fails).hear(np.zeros(700, np.int16)) == [True, True]


@pytest.mark.parametrize("width", [1, 5, 320])
def test_rechunk(spark, width):
    r = random.Random(width)
    rows, want = [], {}
    for key in range(3):
        line, run = [], 0
        for place in range(40):
            reset = r.random() < 0.1
            if reset:
                line, run = [], run + 1
            x = [r.randint(-9, 9) for _ in range(r.choice([0, 1, 7, 50, 700]))]
            line += x
            rows.append((key, place, None if not x and place % 2 else x, reset))
            for k in range(len(line) // width):
                want[key, run, k] = line[k * width : k * width + width]
    df = spark.createDataFrame(rows, "k int, i int, s array<smallint>, r boolean").repartition(5)
    got = {(x.k, x.run, x.position): list(x.samples) for x in frames.rechunk(df, "k", ["i"], "s", width, F.col("r")).collect()}
    assert got == want


def units(spark, n_keys=5, seed=1):
    r = random.Random(seed)
    some = lambda: r.choice([[True], [False], [None], [], None, [True, False], [False, False]])
    rows = [(k, i // 2, r.choice([0.5, 1.0, 7.25, None]), some(), r.choice(["data"] * 18 + ["pause", "resume", None])) for k in range(n_keys) for i in range(r.randint(0, 200))]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows or [], "k long, i long, n double, v array<boolean>, kind string")


def model(rows, first=0):
    """By the rules: every opening takes the next number."""
    out = []
    for k in {r[0] for r in rows}:
        seq, number, n, length, silent, paused = first, None, 0, 0.0, 0, False
        own = [(i, kind or "data", x or 0.0, [v is not False for v in vs or []]) for key, i, x, vs, kind in rows if key == k]
        for _, kind, x, vs in sorted(own):
            if kind == "pause":
                number, n, length, silent, paused = None, 0, 0.0, 0, True
            elif kind == "resume":
                paused = False
            elif not paused:
                for v in vs:
                    silent = 0 if v else silent + 1
                was_open = number is not None
                if not was_open:
                    seq += 1
                    number = seq
                n, length = n + 1, length + x
                quiet = silent >= 2 and length >= 3.0
                if was_open and (quiet or length >= 20.0):
                    out.append((k, number, n, length, "silence" if quiet else "max"))
                    seq += 1
                    number, n, length, silent = seq, 0, 0.0, 0
        if number is not None and n:
            out.append((k, number, n, length, "tail"))
    return sorted(out)


@pytest.mark.parametrize("form", [segment.segment_fold, segment.segment_runs])
@pytest.mark.parametrize("seed", [1, 2])
def test_forms_agree(spark, form, seed):
    """Ties in the order, null lengths, verdicts and kinds."""
    rows, df = units(spark, seed=seed)
    got = form(df, "k", ["i"], F.col("n"), F.col("v"), 2, 3.0, 20.0, F.col("kind"))
    assert sorted(map(tuple, got.collect())) == model(rows)


def test_empty_table_and_null_key(spark):
    df = spark.createDataFrame([], "k long, i long, n double, s boolean")
    for form in (segment.segment_fold, segment.segment_runs):
        assert form(df, "k", ["i"], F.col("n"), F.col("s"), 2, 3.0, 20.0).count() == 0
        one = spark.createDataFrame([(None, 1, 1.0, True)], "k long, i long, n double, s boolean")
        assert [tuple(r) for r in form(one, "k", ["i"], F.col("n"), F.col("s"), 2, 3.0, 20.0).collect()] == [(None, 1, 1, 1.0, "tail")]


def test_the_tail_ends_a_segment_and_numbers_go_on():
    c = Cutter(2, 3.0, 20.0)
    assert c.take("data", 1.0, []) is None and c.take("eof", 0.0, []) == (1, 1, 1.0, "tail")
    assert c.take("eof", 0.0, []) is None and c.take("data", 1.0, []) is None and c.tail() == (2, 1, 1.0, "tail")


def test_island_runs(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True, None, True])], "k string, i int, f boolean")
    assert [r.run for r in segment.island_runs(df, "k", ["i"], F.col("f")).orderBy("i").collect()] == [1, 2, 0, 1, 0, 1]


@pytest.mark.parametrize("splits", [1, 3])
def test_stream_equals_batch(spark, tmp_path, splits):
    from larkstream.streaming.segments import replay, run_to_end, segment_stream

    rows, _ = units(spark, n_keys=3, seed=4)
    rows = [(k, 2 * i + j % 2, n, v, kind) for j, (k, i, n, v, kind) in enumerate(sorted(rows, key=lambda r: r[:2]))]
    schema = "key long, ord long, length double, verdicts array<boolean>, kind string"
    for part in range(splits):
        held = [(k, i, n, v, kind or "data") for k, i, n, v, kind in rows if i * splits // 200 == part]
        spark.createDataFrame(held, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ends = [(k, 10**9, 0.0, [True], "eof") for k in {r[0] for r in rows}]
    spark.createDataFrame(ends, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stream = segment_stream(replay(spark, str(tmp_path / "in"), schema), 2, 3.0, 20.0)
    got = run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, got.collect())) == model(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_a_query_on_a_clock(spark, tmp_path):
    """Batches go to a sink and to a view that fails; stop() leaves the rest to the next run."""
    import time

    from larkstream.streaming.segments import append_once, every, fan_out

    def gone(batch, batch_id):
        raise OSError("no screen")

    spark.range(5).write.parquet(str(tmp_path / "in"))
    act = fan_out(lambda b, i: append_once(b, i, str(tmp_path / "out")), gone)
    start = lambda: every(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), 0.1, act, str(tmp_path / "check"))
    for more in (5, 9):
        q = start()
        for _ in range(300):
            if (tmp_path / "out").exists() and spark.read.schema("id long, batch_id long").parquet(str(tmp_path / "out")).count() == more:
                break
            time.sleep(0.1)
        q.stop()
        spark.range(4).write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
