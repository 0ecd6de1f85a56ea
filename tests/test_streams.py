"""Streams: chunks in any order, gaps that are given up, sources that fall silent, restarts."""

import random
import time

import pytest

from larkstream.operators.segment import Cutter
from larkstream.streaming.reorder import segment_unordered
from larkstream.streaming.segments import replay, rocksdb_state, run_to_end

UNITS = "key string, place long, kind string, length double, verdicts array<boolean>"
LIMITS = 2, 5.0, 20.0


def chunks(key, n, seed):
    r = random.Random(seed)
    return [(key, i, r.choice(["data", "data", None]) if i % 17 != 5 else r.choice(["pause", "resume", "resume"]), float(r.randint(0, 4)), [r.random() < 0.6 for _ in range(r.randint(0, 2))]) for i in range(n)]


def model(rows, tail=True):
    out = {}
    for key in {x[0] for x in rows}:
        c = Cutter(*LIMITS)
        for _, _, kind, length, verdicts in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            if done := c.take(kind or "data", length, verdicts):
                out.setdefault(key, []).append(done)
        if tail and (done := c.tail()):
            out.setdefault(key, []).append(done)
    return out


def by_key(rows):
    out = {}
    for key, *done in rows:
        out.setdefault(key, []).append(tuple(done))
    return {k: sorted(v) for k, v in out.items()}


class Feed:
    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        (path / "in").mkdir()

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, UNITS).coalesce(1).write.parquet(str(self.path / f"new{self.n}"))
        for f in (self.path / f"new{self.n}").glob("part-*"):
            f.rename(self.path / "in" / f"{self.n:03d}-{f.name}")

    def stream(self, patience=86_400_000, idle=None, seeds=None):
        return segment_unordered(replay(self.spark, str(self.path / "in"), UNITS, 1), *LIMITS, patience, idle, seeds)

    def run(self, **how):
        return run_to_end(self.stream(**how), str(self.path / "out"), str(self.path / "checkpoint"))


def test_chunks_in_any_order(spark, tmp_path):
    """Dealt over batches by chance, some sent twice, and a restart between."""
    feed, rows = Feed(spark, tmp_path), chunks("a", 60, 1) + chunks("b", 25, 2)
    sent = rows + [("a", 60, "eof", 0.0, []), ("b", 25, "eof", 0.0, [])] + random.Random(3).sample(rows, 20)
    random.Random(4).shuffle(sent)
    for part in (sent[0::3], sent[1::3]):
        feed.put(part)
    feed.run(seeds=spark.createDataFrame([("b", 7)], "key string, n long"))
    feed.put(sent[2::3])
    got = by_key(feed.run(seeds=spark.createDataFrame([("b", 7)], "key string, n long")).collect())
    want = model(rows)
    want["b"] = [(seq + 7, *rest) for seq, *rest in want["b"]]
    assert got == {k: sorted(v) for k, v in want.items()}


def wait_for(spark, out, schema, enough, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.read.schema(schema).parquet(out).collect() if any(out_file.startswith("part-") for out_file in _names(out)) else []
        if enough(rows):
            return rows
        time.sleep(0.5)
    pytest.fail(f"nothing came within {seconds} s")


def _names(folder):
    import os

    return os.listdir(folder) if os.path.isdir(folder) else []


def started(feed, spark, **how):
    with rocksdb_state(spark):
        return feed.stream(**how).writeStream.format("parquet").option("path", str(feed.path / "out")).option("checkpointLocation", str(feed.path / "checkpoint")).trigger(processingTime="300 milliseconds").start()


def test_gaps_are_given_up_and_silent_sources_flushed(spark, tmp_path):
    """Both by timers, also over a restart, and the tail once."""
    feed, rows = Feed(spark, tmp_path), [(k, i, "data", 2.0, [True]) for k in "ab" for i in range(13)]
    feed.put([x for x in rows if not (x[0] == "a" and x[1] in (4, 5))])
    schema = "key string, seq long, n_units long, length double, reason string"
    whole = {"a": sorted([(1, 10, 20.0, "max"), (2, 1, 2.0, "tail")]), "b": sorted([(1, 10, 20.0, "max"), (2, 3, 6.0, "tail")])}
    query = started(feed, spark, patience=4_000, idle=9_000)
    try:
        wait_for(spark, str(tmp_path / "out"), schema, lambda got: ("b", 1, 10, 20.0, "max") in map(tuple, got))
    finally:
        query.stop()  # before either limit; timers are part of the state
    query = started(feed, spark, patience=4_000, idle=9_000)
    try:
        wait_for(spark, str(tmp_path / "out"), schema, lambda got: len(got) >= 4, 90)
        feed.put([("a", 4, "data", 9.0, [True]), ("b", 13, "data", 1.0, [True])])  # one comes too late, one goes on
        got = wait_for(spark, str(tmp_path / "out"), schema, lambda got: len(got) >= 5, 90)
        time.sleep(2)
        got = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    finally:
        query.stop()
    whole["b"] = sorted([*whole["b"], (3, 1, 1.0, "tail")])
    assert by_key(got) == whole


# ---- the queue of chunks


def queue_rows(n, source, first=0, width=4):
    return [(source, first + k, [(first + k) % 100] * width) for k in range(n)]


def start_queue(spark, folder, out, checkpoint, files=2, act=None):
    from larkstream.streaming.queue_source import chunks

    write = chunks(spark, str(folder), 4, files).writeStream.option("checkpointLocation", str(checkpoint)).trigger(processingTime="200 milliseconds")
    return (write.foreachBatch(act) if act else write.format("parquet").option("path", str(out))).start()


def test_no_chunk_is_lost_or_doubled(spark, tmp_path):
    """A queue that a query reads while it is filled, with a crash in the middle of a batch and restarts."""
    import numpy as np

    from larkstream.streaming import queue_source
    from larkstream.streaming.segments import append_once

    folder, out, checkpoint = tmp_path / "q", tmp_path / "out", tmp_path / "c"
    spark_rows = queue_rows(23, 0) + queue_rows(9, 1)
    assert queue_source.enqueue(spark.createDataFrame(spark_rows, "source_id short, chunk_seq long, samples array<short>"), str(folder), 5, 4) == 32
    assert sorted(p.name for p in folder.glob("*.pcm"))[-1] == "1-00000000000000000005-4.pcm"
    order, crashed = [], []

    def act(batch, batch_id):
        order.append({(r.source_id, r.chunk_seq) for r in batch.collect()})
        append_once(batch, batch_id, str(out))
        if batch_id == 1 and not crashed:
            crashed.append(batch_id)
            raise OSError("crash after the write, before the commit")

    query = start_queue(spark, folder, out, checkpoint, act=act)
    with pytest.raises(Exception, match="crash"):
        query.awaitTermination(60)
    queue_source.put(str(folder), 2, 0, np.repeat(np.arange(3), 4), 4)  # comes after the backlog
    for k in range(2):
        query = start_queue(spark, folder, out, checkpoint, act=act)
        try:
            end = time.time() + 60
            while time.time() < end and len(set().union(*order)) < 35 + 6 * k:
                time.sleep(0.2)
            queue_source.put(str(folder), 0, 23, np.repeat(np.arange(23, 29), 4), 4)
            while time.time() < end and len(set().union(*order)) < 41:
                time.sleep(0.2)
            time.sleep(1.5)
        finally:
            query.stop()
    got = sorted((r.source_id, r.chunk_seq, list(r.samples)) for r in spark.read.parquet(str(out)).collect())
    assert got == sorted(spark_rows + queue_rows(3, 2) + queue_rows(6, 0, 23))
    assert order[1] == order[2]  # the batch that crashed, once more
    assert not list(folder.glob("0-*-5.pcm"))  # read and committed


# ---- live views


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_live_view_is_the_batch_view(spark, tmp_path, seed):
    """After any split into batches, with batches repeated and a version that was never finished."""
    from pyspark.sql import functions as F

    from larkstream.operators import views
    from larkstream.streaming.live import LatestTable

    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1, 2, 3]), i) for i in range(60)]
    table = LatestTable(str(tmp_path), ["k"], "v", ["i"], keep=2)
    assert table.read(spark) is None
    left, batch_id = rows[:], 0
    r.shuffle(left)
    while left:
        n = r.randint(1, 25)
        batch = spark.createDataFrame(left[:n], "k string, v int, i int")
        if r.random() < 0.5:  # a crash: part of a version
            (tmp_path / f"v={batch_id}").mkdir()
            (tmp_path / f"v={batch_id}" / "part-junk.parquet").write_bytes(b"half")
            assert batch_id not in table.versions(spark)
        for _ in range(r.choice([1, 2])):
            table.merge(batch, batch_id)
        left, batch_id = left[n:], batch_id + 1
    want = views.latest(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], "v", ["i"]).select("k", "v")
    assert sorted(map(repr, table.read(spark).select("k", "v").collect())) == sorted(map(repr, want.collect()))
    assert len(table.versions(spark)) <= 2
    assert table.read(spark).select(F.count("*")).first()[0] == 3


# ---- settings that change


def test_changes_reach_every_key_and_cut(spark, tmp_path):
    """Global changes handed to all keys, in two batches: rows as the batch form gives them, segments end at changes."""
    from pyspark.sql import functions as F

    from larkstream.operators import segment, views
    from larkstream.streaming.reconfigure import closing_changes, configured_stream, for_every_key
    from larkstream.streaming.segments import segment_stream

    rows = [(k, 10 * i, f"{k}{i}", False, None, 2.0) for k in "ab" for i in range(12)]
    changes = spark.createDataFrame([(35, 7.0), (72, None), (78, 9.0)], "ord long, setting double")
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    controls = for_every_key(changes, keys).select("key", "ord", F.lit(None).cast("string").alias("id"), F.lit(True).alias("change"), "setting", F.lit(0.0).alias("length"))
    assert controls.count() == 6
    every = spark.createDataFrame(rows, "key string, ord long, id string, change boolean, setting double, length double").unionByName(controls)
    for part in (every.where("ord < 60"), every.where("ord >= 60")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: replay(spark, str(tmp_path / "in"), every.schema.simpleString()[7:-1].replace(":", " "), 1)
    got = run_to_end(configured_stream(read(), -1.0), str(tmp_path / "out"), str(tmp_path / "c"))
    want = views.configured(every, "key", ["ord"], F.col("change"), F.col("setting"), F.lit(-1.0))
    assert sorted(map(tuple, got.select("id", "config", "generation").collect())) == sorted(map(tuple, want.select("id", "config", "generation").collect()))
    kind = closing_changes(F.lit("data"), F.col("change"))
    units = read().select("key", "ord", "length", F.array(F.lit(True)).alias("verdicts"), kind.alias("kind"))
    cut = run_to_end(segment_stream(units, *LIMITS), str(tmp_path / "out2"), str(tmp_path / "c2"))
    whole = segment.segment(every, "key", ["ord"], F.col("length"), F.array(F.lit(True)), *LIMITS, closing_changes(F.lit("data"), F.col("change")))
    assert by_key(map(tuple, cut.collect())) == {k: [s for s in v if s[0] < 3] for k, v in by_key(map(tuple, whole.collect())).items()}


# ---- parts that are fed one after another


def test_parts_are_fed_as_many_files(spark, tmp_path):
    """Each part is one micro-batch, whatever the number of its files, and parts come in their order."""
    from pyspark.sql import functions as F

    from larkstream.streaming.reconfigure import configured_stream
    from larkstream.streaming.segments import fed

    rows = [("ab"[i % 2], i, i, i % 7 == 0, float(i)) for i in range(60)]
    every = spark.createDataFrame(rows, "key string, ord long, id long, change boolean, setting double")
    parts = [every.where(F.col("ord").between(20 * k, 20 * k + 19)).repartition(5) for k in range(3)]
    got = fed(spark, parts, lambda stream: configured_stream(stream, -1.0), str(tmp_path))
    want, state = [], {"a": (-1.0, 0), "b": (-1.0, 0)}
    for key, _, i, change, setting in rows:
        if change:
            state[key] = setting, state[key][1] + 1
        else:
            want.append((i, *state[key]))
    assert sorted(map(tuple, got.select("id", "config", "generation").collect())) == want
    assert len(list((tmp_path / "in").glob("part-*"))) == 15
    assert len([p for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit()]) == 3
