"""Scans, halos and segmentation over ranges of rows, against row-by-row models; one key in many partitions."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from larkstream.operators import gate, scan, segment, segment_hot, views
from larkstream.operators.segment import Cutter


def signal(seed, keys, n):
    """(key, place, flag, value, control): some keys have nearly all rows."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = keys[0] if r.random() < 0.7 else r.choice(keys)
        rows.append((k, i, r.choice([True, True, False, None]), r.choice([None, 0, 1, 5, 9]), r.choice([None] * 6 + ["on", "off"])))
    r.shuffle(rows)
    return rows


SCHEMA = "k string, i int, flag boolean, value int, control string"


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out.values()


@pytest.mark.parametrize("n, batch", [(0, 10_000), (1, 10_000), (900, 10_000), (900, 7)])
def test_scans_equal_loops(spark, n, batch):
    rows = signal(n + batch, ["a", "b", None, "", "zz"], n)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        ranged = scan.in_order(df, "k", ["i"], 6)
        got = scan.scan(ranged, {"run": scan.Run(F.lit(1), ~F.coalesce("flag", F.lit(True))), "total": scan.Run(F.col("value")), "half": scan.Run(F.col("value") / 2, kind="double"), "last": scan.Last(F.col("control"), "string", "none"), "before": scan.Before(F.col("value"), "int")})
        got = {x.i: (x.run, x.total, x.half, x["last"], x.before) for x in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for held in by_key(rows):
        run, total, last, before = 0, 0, "none", None
        for _, i, flag, value, control in held:
            run = 1 if flag is False else run + 1
            total += value or 0
            last = control or last
            want[i] = (run, total, total / 2, last, before)
            before = value
    assert got == want


@pytest.mark.parametrize("pad, n, batch", [(0, 200, 10_000), (3, 300, 10_000), (3, 300, 2), (15, 600, 10_000), (15, 40, 3), (200, 300, 11)])
def test_dilation_equals_a_window(spark, pad, n, batch):
    """Also where partitions hold fewer rows than the halo is wide."""
    rows = [(k, i, flag and i % 9 == 0, v, c) for k, i, flag, v, c in signal(pad, ["a", "b", None], n)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {x.i: x.keep for x in scan.near(scan.in_order(df, "k", ["i"], 7), F.col("flag"), pad, "keep").collect()}
        places = {(x.k, x.i): x.position for x in scan.dilate(df, "k", ["i"], F.col("flag"), pad, True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, positions = {}, {}
    for held in by_key(rows):
        kept = [any(x[2] for x in held[max(0, j - pad) : j + pad + 1]) for j in range(len(held))]
        want |= {x[1]: bool(k) for x, k in zip(held, kept, strict=True)}
        positions |= {(x[0], x[1]): p for p, x in enumerate(x for x, k in zip(held, kept, strict=True) if k)}
    assert got == want and places == positions


def test_forms_for_hot_keys_equal_windows(spark):
    df = spark.createDataFrame(signal(5, ["a", "b", "c"], 400), SCHEMA).cache()
    same = lambda a, b: sorted(map(repr, a.select("i", *more).collect())) == sorted(map(repr, b.select("i", *more).collect()))
    more = ["run"]
    assert same(scan.run_lengths(df, "k", ["i"], F.col("flag")), segment.island_runs(df, "k", ["i"], F.col("flag")))
    more = []
    assert same(scan.edges(df, "k", ["i"], F.col("flag")), views.edges(df, "k", ["i"], F.col("flag")))
    on, off = F.col("control") == "on", F.col("control") == "off"
    assert same(scan.while_on(df, "k", ["i"], on, off, True), views.while_on(df, "k", ["i"], on, off, True))
    more = ["offset", "total"]
    tall = df.withColumn("value", F.coalesce("value", F.lit(2)))
    assert same(scan.running_height(tall, "k", ["i"], "value"), views.running_height(tall, "k", ["i"], "value"))
    more = ["config", "generation"]
    assert same(scan.configured(df, "k", ["i"], on, F.col("value"), "int", -1), views.configured(df, "k", ["i"], on, F.col("value"), F.lit(-1)))
    more = ["position"]
    near = gate.compact(gate.dilate(df, "k", ["i"], F.coalesce("flag", F.lit(False)) & (F.col("i") % 5 == 0), 4), "k", ["i"])
    assert same(scan.dilate(df, "k", ["i"], F.col("flag") & (F.col("i") % 5 == 0), 4, True), near)


def units(seed, n, controls):
    """(key, place, kind, samples, verdicts)"""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if r.random() < 0.8 else r.choice(["a", "b", None])
        kind = r.choice(["pause", "resume", "resume", "eof"]) if controls and r.random() < 0.04 else r.choice(["data", "data", None])
        loud = (i // 40) % 2
        rows.append((k, i, kind, r.choice([0, 1, 20, 90, None]), r.choice([None, [], [r.random() < 0.9 * loud], [r.random() < 0.5, r.random() < 0.5, None if i % 7 == 0 else False]])))
    return rows


def model(rows, limits, seeds):
    out = []
    for held in by_key(rows):
        c = Cutter(*limits)
        c.begin(seeds.get(held[0][0], 0))
        for k, _, kind, samples, verdicts in held:
            if done := c.take(kind or "data", samples or 0, [v is None or v for v in verdicts or []]):
                out.append((k, *done))
        if done := c.tail():
            out.append((held[0][0], *done))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, n, controls, limits, partitions", [
    (1, 700, False, (4, 60, 400), 6), (2, 700, True, (4, 60, 400), 6), (3, 60, True, (2, 10, 50), 9), (4, 500, True, (3, 0, 100_000), 5), (5, 400, True, (1, 1, 30), 8), (6, 0, True, (1, 1, 30), 3), (7, 300, False, (10_000, 5, 90), 4),
])
def test_segments_of_a_hot_key(spark, seed, n, controls, limits, partitions):
    rows, seeds = units(seed, n, controls), {"hot": 40, None: 7}
    df = spark.createDataFrame(rows, "k string, i int, kind string, samples int, v array<boolean>").repartition(3)
    numbers = spark.createDataFrame(list(seeds.items()), "k string, n long")
    got = segment_hot.segment_hot(df, "k", ["i"], F.col("samples"), F.col("v"), *limits, F.col("kind") if controls else None, numbers, partitions)
    assert sorted(map(tuple, got.collect()), key=repr) == model(rows if controls else [(*x[:2], "data", *x[3:]) for x in rows], limits, seeds)


def test_a_hot_key_is_shared_out(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), "id")
    sizes = [x["n"] for x in scan.in_order(df, "k", ["id"], 8).groupBy(scan.PART).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * median(sizes)


def test_ranges_of_a_hot_key_keep_their_size(spark, monkeypatch):
    """Their number grows with the rows, and the session's number of partitions is the least."""
    rows = units(11, 600, True)
    df = spark.createDataFrame(rows, "k string, i int, kind string, samples int, v array<boolean>")
    asked, ordered = [], segment_hot.in_order
    monkeypatch.setattr(segment_hot, "in_order", lambda d, k, by, n: asked.append(n) or ordered(d, k, by, n))
    monkeypatch.setattr(segment_hot, "RANGE_ROWS", 50, raising=False)
    got = segment_hot.segment_hot(df, "k", ["i"], F.col("samples"), F.col("v"), 4, 60, 400, F.col("kind"))
    assert sorted(map(tuple, got.collect()), key=repr) == model(rows, (4, 60, 400), {})
    assert asked == [12]
