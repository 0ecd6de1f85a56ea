"""The driver's queries: every operator on a table with the same algebra, and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkstream.functions import audio, text
from larkstream.operators import asr, gate, lookup, queue, scan, segment, segment_hot, views
from larkstream.operators.names import first_with_part
from larkstream.operators.order import global_rank
from larkstream.plans.process import process_segments
from larkstream.sources import transcript

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- queue and recovery

_SEG = "concat(source, '_', lpad(cast(doc_id AS VARCHAR), greatest(6, length(cast(doc_id AS VARCHAR)))::INTEGER, '0'))"


@query(f"""
WITH pending AS (SELECT doc_id, {_SEG} AS seg_id, cast(substr(source, 4) AS BIGINT) AS src FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, seg_id, row_number() OVER (ORDER BY src, doc_id) AS rank FROM pending
""")
def recover_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.format_string("%s_%06d", "source", "doc_id").alias("seg_id"))
    pending = queue.unprocessed(files, table(spark, sf_dir, "labels"), "doc_id")
    return global_rank(pending, *queue.recovery_order(F.col("seg_id")), F.col("doc_id")).select("doc_id", "seg_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT doc_id FROM labels")
def processed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.processed_ids(table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT count(*) FILTER (l.doc_id IS NULL) AS pending, coalesce(sum(n_chars) FILTER (l.doc_id IS NULL), 0)::DOUBLE / 1048576 AS pending_mb, sum(n_chars)::DOUBLE / 1048576 AS total_mb
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
""")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.queue_stats(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "n_chars")


@query("SELECT source, max(doc_id) AS max_seq FROM documents GROUP BY source")
def max_seq_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.max_seq(table(spark, sf_dir, "documents"), "source", F.col("doc_id"))


# ---- segmentation

SILENCE, LEAST, GREATEST = 2, 30.0, 200.0


def _fold(kind: str = "'data'", first: str = "event_type <> 'error'", second: str = "NULL::BOOLEAN", seed: str = "0", key: str = "user_id", length: str = "value", whole: str = "DOUBLE", least: str = str(LEAST), greatest: str = str(GREATEST)) -> str:
    """The fold row by row: state after each unit, with what the unit closed. A null verdict here is no frame."""
    return f"""
WITH RECURSIVE e AS (
  SELECT {key} AS user_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY {key}) AS total,
         {kind} AS kind, {length} AS len, {first} AS a, {second} AS b, {seed} AS seed FROM events
), f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, total, false AS is_open, false AS paused, 0 AS silent, 0::BIGINT AS n, 0::{whole} AS length, seed::BIGINT AS seq,
         NULL::BIGINT AS out_seq, 0::BIGINT AS out_n, 0::{whole} AS out_length, '' AS reason FROM e
  UNION ALL
  SELECT user_id, i, total,
         CASE WHEN kind = 'pause' THEN false WHEN idle THEN is_open ELSE true END,
         CASE kind WHEN 'pause' THEN true WHEN 'resume' THEN false ELSE paused END,
         CASE WHEN kind = 'pause' OR closes THEN 0 WHEN idle THEN silent ELSE s END,
         CASE WHEN kind = 'pause' OR closes THEN 0 WHEN idle THEN n ELSE n + 1 END,
         CASE WHEN kind = 'pause' OR closes THEN 0::{whole} WHEN idle THEN length ELSE l END,
         CASE WHEN NOT idle AND (closes OR NOT is_open) THEN seq + 1 ELSE seq END,
         CASE WHEN closes THEN seq END, n + 1, l, CASE WHEN s >= {SILENCE} AND l >= {least} THEN 'silence' ELSE 'max' END
  FROM (SELECT *, kind <> 'data' OR paused AS idle, kind = 'data' AND NOT paused AND is_open AND ((s >= {SILENCE} AND l >= {least}) OR l >= {greatest}) AS closes
        FROM (SELECT f.user_id, e.i, f.total, f.is_open, f.paused, f.silent, f.n, f.length, f.seq, e.kind, f.length + e.len AS l,
                     CASE WHEN e.b THEN 0 WHEN NOT e.b THEN 1 + CASE WHEN e.a THEN 0 WHEN NOT e.a THEN f.silent + 1 ELSE f.silent END
                          WHEN e.a THEN 0 WHEN NOT e.a THEN f.silent + 1 ELSE f.silent END AS s
              FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
), segments AS (
  SELECT user_id, out_seq AS seq, out_n AS n_units, out_length AS length, reason FROM f WHERE out_seq IS NOT NULL
  UNION ALL
  SELECT user_id, seq, n, length, 'tail' FROM f WHERE i = total AND is_open AND n > 0
)
SELECT user_id, seq, n_units, length, reason FROM segments
"""


_FOLD = _fold()
_ORDER = ["ts", "event_id"]


def _segments(spark: SparkSession, sf_dir: str, form=segment.segment) -> DataFrame:
    return form(table(spark, sf_dir, "events"), "user_id", _ORDER, F.col("value"), F.col("event_type") != "error", SILENCE, LEAST, GREATEST)


@query(_FOLD)
def segment_by_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@query(_FOLD)
def segment_long_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for keys that fit no array, by its own name."""
    return _segments(spark, sf_dir, segment.segment_runs)


@query(_FOLD)
def segment_in_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for keys that fit an array."""
    return _segments(spark, sf_dir, segment.segment_fold)


@query(_FOLD + " WHERE reason = 'tail'")
def segment_tail_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).where("reason = 'tail'")


_TWO = {"first": "CASE WHEN event_id % 3 > 0 THEN event_type <> 'error' END", "second": "CASE WHEN event_id % 3 = 2 THEN event_id % 2 = 0 END"}


def _two_verdicts():
    """No, one or two frames end in a unit."""
    return F.slice(F.array(F.col("event_type") != "error", F.col("event_id") % 2 == 0), 1, (F.col("event_id") % 3).cast("int"))


@query(_fold(**_TWO))
def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in which several frames end."""
    return segment.segment(table(spark, sf_dir, "events"), "user_id", _ORDER, F.col("value"), _two_verdicts(), SILENCE, LEAST, GREATEST)


@query(_fold(kind="CASE event_type WHEN 'signup' THEN 'pause' WHEN 'click' THEN 'resume' ELSE 'data' END", seed="user_id % 5 * 10", **_TWO))
def segment_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control rows in the stream, and numbers that go on from those already used."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "pause").when(F.col("event_type") == "click", "resume").otherwise("data")
    seeds = events.select("user_id", (F.col("user_id") % 5 * 10).alias("max_seq")).distinct()
    return segment.segment(events, "user_id", _ORDER, F.col("value"), _two_verdicts(), SILENCE, LEAST, GREATEST, kind, seeds)


_CENTS = {"length": "round(value * 100)::BIGINT", "whole": "BIGINT", "least": "3000", "greatest": "20000"}
_HOT = {"kind": "CASE WHEN event_id % 997 = 5 THEN 'pause' WHEN event_id % 499 = 7 THEN 'resume' ELSE 'data' END", **_TWO}


def _hot(spark: SparkSession, sf_dir: str, speech, kind=None, seeds=None) -> DataFrame:
    """All events under one key, with lengths in whole cents."""
    events = table(spark, sf_dir, "events").withColumn("user_id", F.lit(0).cast("long"))
    cents = F.round(F.col("value") * 100).cast("long")
    return segment_hot.segment_hot(events, "user_id", _ORDER, cents, speech, SILENCE, 3000, 20000, kind, seeds)


@query(_fold(key="0::BIGINT", **_CENTS))
def segment_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir, F.col("event_type") != "error")


@query(_fold(key="0::BIGINT", seed="40", **_HOT, **_CENTS))
def segment_hot_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key with pauses, units of no, one or two frames, and numbers already used."""
    k = F.col("event_id")
    kind = F.when(k % 997 == 5, "pause").when(k % 499 == 7, "resume").otherwise("data")
    seeds = spark.range(1).select(F.col("id").alias("user_id"), F.lit(40).cast("long").alias("max_seq"))
    return _hot(spark, sf_dir, _two_verdicts(), kind, seeds)


@query("SELECT event_id, event_id % 4 AS source_id FROM events WHERE event_id % 4 <= 1")
def known_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.known_sources(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("source_id")))


@query(_FOLD)
def stream_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a stream that is stopped half-way and goes on from its checkpoint."""
    from larkstream.session import shared_folder
    from larkstream.streaming.segments import replay, run_to_end, segment_stream

    folder = shared_folder(spark, "stream")
    events = table(spark, sf_dir, "events")
    place = F.format_string("%s %020d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "event_id")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = low + (high - low) / 2 if low else None

    def feed(part: DataFrame) -> None:
        part.write.mode("append").parquet(f"{folder}/in")

    def rows(part: DataFrame) -> DataFrame:
        return part.select(F.col("user_id").alias("key"), place.alias("ord"), F.col("value").alias("length"), F.array(F.col("event_type") != "error").alias("verdicts"), F.lit("data").alias("kind"))

    def run() -> DataFrame:
        stream = replay(spark, f"{folder}/in", "key bigint, ord string, length double, verdicts array<boolean>, kind string", None)
        return run_to_end(segment_stream(stream, SILENCE, LEAST, GREATEST), f"{folder}/out", f"{folder}/checkpoint")

    feed(rows(events.where(F.col("ts") < F.lit(middle))))
    run()
    ends = events.select(F.col("user_id").alias("key")).distinct().select("key", F.lit("9").alias("ord"), F.lit(0.0).alias("length"), F.array().cast("array<boolean>").alias("verdicts"), F.lit("eof").alias("kind"))
    feed(rows(events.where(F.col("ts") >= F.lit(middle))).unionByName(ends))
    return run().withColumnRenamed("key", "user_id")


@query("SELECT event_id, value FROM events")
def stream_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose batches are each written once, though one view of them always fails."""
    from larkstream.session import shared_folder
    from larkstream.streaming.segments import append_once, fan_out

    folder = shared_folder(spark, "delivery")
    events = table(spark, sf_dir, "events").select("event_id", "value")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")

    def gone(batch: DataFrame, batch_id: int) -> None:
        raise OSError("no screen")

    act = fan_out(lambda b, i: append_once(b, i, f"{folder}/out"), gone)
    stream.writeStream.foreachBatch(act).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch", "batch_id")


@query("""
WITH d AS (SELECT doc_id, source, n_chars, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 ELSE 1 END AS phase FROM documents)
SELECT doc_id, phase, row_number() OVER (ORDER BY phase, cast(substr(source, 4) AS BIGINT), doc_id) AS place FROM d
""")
def backlog_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents stand for the backlog."""
    from larkstream.streaming.segments import backlog_then_live

    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 9).cast("long").alias("src"))
    ids = table(spark, sf_dir, "labels").select("doc_id")
    both = backlog_then_live(docs.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_anti"), [F.col("src"), F.col("doc_id")])
    return both.select("doc_id", "phase", F.col("place").cast("long").alias("place"))


_RUNS = """
WITH m AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM m)
"""


def _error_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.island_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(_RUNS + "SELECT event_id, user_id, run FROM r")
def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error_runs(spark, sf_dir).select("event_id", "user_id", "run")


@query(_RUNS + """SELECT event_id, user_id, run AS streak, greatest(500, least(12000, 600 * run)) AS delay_ms,
  CASE WHEN run = 1 THEN 'warn' WHEN bit_count(run) = 1 THEN 'debug' ELSE 'quiet' END AS log_at FROM r WHERE run > 0""")
def failure_streak_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    streaks = _error_runs(spark, sf_dir).where("run > 0")
    log_at = F.when(F.col("run") == 1, "warn").when(F.bit_count("run") == 1, "debug").otherwise("quiet")
    return streaks.select("event_id", "user_id", F.col("run").alias("streak"), audio.backoff_ms(F.col("run")).alias("delay_ms"), log_at.alias("log_at"))


# ---- gate


@query("""
SELECT *, CASE WHEN ratio = 0 THEN 'drop' WHEN ratio < 0.15 THEN 'trim' ELSE 'pass' END AS action
FROM (SELECT user_id, count(*) AS n_frames, count(*) FILTER (event_type = 'purchase') AS n_speech, count(*) FILTER (event_type = 'purchase') / count(*) AS ratio FROM events GROUP BY user_id)
""")
def speech_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_ratio(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase")


_DILATE = """
WITH d AS (SELECT event_id, user_id, ts, max(event_type = 'purchase' AND value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS keep FROM events)
"""


def _dilated(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = (F.col("event_type") == "purchase") & (F.col("value") > 50)
    return gate.dilate(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], loud, audio.pad_frames(300))


@query(_DILATE + "SELECT event_id, user_id, keep FROM d")
def dilate_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dilated(spark, sf_dir).select("event_id", "user_id", "keep")


@query(_DILATE + "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS kept FROM d WHERE keep")
def trim_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = gate.compact(_dilated(spark, sf_dir), "user_id", ["ts", "event_id"])
    return kept.select("event_id", "user_id", F.col("position").cast("long").alias("position"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("kept"))


@query("""
WITH n AS (SELECT l_suppkey, l_quantity, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 320 AS frame FROM lineitem)
SELECT l_suppkey, frame, count(*) AS n_samples, sum(l_quantity) AS total FROM n GROUP BY ALL HAVING count(*) = 320
""")
def frame_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = gate.whole_frames(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], audio.FRAME)
    return framed.groupBy("l_suppkey", "frame").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("l_quantity").alias("total"))


# ---- samples

_I16 = "list_transform(embedding, lambda x: cast(trunc(greatest(-32768.0, least(32767.0, x::DOUBLE * 32767.0))) AS INTEGER))"
_LEVEL = f"round(least(1.0, sqrt(list_sum(list_transform({_I16}, lambda x: x::BIGINT * x))::DOUBLE / len(embedding)) / 32768.0 * 12.0), 9)"


def _i16(c: str = "embedding"):
    return F.transform(c, audio.to_i16)


@query(f"SELECT vec_id, {_LEVEL} AS level FROM embeddings")
def rms_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.level(_i16()), 9).alias("level"))


@query(f"SELECT vec_id, repeat('#', n) || repeat('-', 8 - n) AS meter FROM (SELECT vec_id, cast(floor(greatest(0, least(8, {_LEVEL} * 8))) AS INTEGER) AS n FROM embeddings)")
def level_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", audio.level_meter(F.round(audio.level(_i16()), 9)).alias("meter"))


@query(f"SELECT vec_id, array_to_string({_I16}, ',') AS samples FROM embeddings")
def quantise_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(_i16().cast("array<string>"), ",").alias("samples"))


@query(f"SELECT vec_id, len(s) AS n, list_min(s) / 32768.0 AS least, list_max(s) / 32768.0 AS greatest, s[1] / 32768.0 AS first FROM (SELECT vec_id, {_I16} AS s FROM embeddings)")
def dequantise_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.transform(_i16(), audio.from_i16).cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(back).cast("long").alias("n"), F.array_min(back).alias("least"), F.array_max(back).alias("greatest"), F.element_at(back, 1).alias("first"))


@query("""
SELECT vec_id, len(m) AS n, m[1] AS first, m[len(m)] AS last, list_max(m) AS greatest
FROM (SELECT vec_id, list_transform(range(0, len(embedding) // 3), lambda i: (embedding[i * 3 + 1]::DOUBLE + embedding[i * 3 + 2]::DOUBLE + embedding[i * 3 + 3]::DOUBLE) / 3) AS m FROM embeddings)
""")
def mixdown_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = audio.mono(F.col("embedding"), 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(m).cast("long").alias("n"), F.element_at(m, 1).alias("first"), F.element_at(m, -1).alias("last"), F.array_max(m).alias("greatest"))


@query("""
SELECT vec_id, len(m) AS n, m[1] AS first, m[len(m)] AS last, list_max(m) AS greatest FROM (
  SELECT vec_id, list_transform(range(0, ceil(len(embedding) / 2.75625)::BIGINT), lambda i:
    embedding[least(floor(i * 2.75625::DOUBLE)::BIGINT, len(embedding) - 1) + 1]::DOUBLE
    + (embedding[least(floor(i * 2.75625::DOUBLE)::BIGINT + 1, len(embedding) - 1) + 1]::DOUBLE - embedding[least(floor(i * 2.75625::DOUBLE)::BIGINT, len(embedding) - 1) + 1]::DOUBLE)
    * (i * 2.75625::DOUBLE - floor(i * 2.75625::DOUBLE))) AS m FROM embeddings)
""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """44.1 to 16 kHz."""
    m = audio.resample(F.col("embedding"), 44_100)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(m).cast("long").alias("n"), F.element_at(m, 1).alias("first"), F.element_at(m, -1).alias("last"), F.array_max(m).alias("greatest"))


# ---- keys, names and texts

_IDS = """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'bad' WHEN 1 THEN concat('src', doc_id, '_abc') WHEN 2 THEN concat('srcx_', doc_id) WHEN 3 THEN concat('src300_', doc_id)
  WHEN 4 THEN concat('src1_', doc_id * 7000000) WHEN 5 THEN concat('src0_', doc_id, '_1') WHEN 6 THEN 'src1_' ELSE concat(source, '_', lpad(cast(doc_id AS VARCHAR), 6, '0')) END AS seg_id FROM documents
"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, cast = F.col("doc_id"), F.col("doc_id").cast("string")
    kinds = [F.lit("bad"), F.concat(F.lit("src"), cast, F.lit("_abc")), F.concat(F.lit("srcx_"), cast), F.concat(F.lit("src300_"), cast), F.concat(F.lit("src1_"), (d * 7_000_000).cast("string")), F.concat(F.lit("src0_"), cast, F.lit("_1")), F.lit("src1_")]
    made = F.concat("source", F.lit("_"), F.lpad(cast, 6, "0"))
    for i, k in reversed(list(enumerate(kinds))):
        made = F.when(d % 9 == i, k).otherwise(made)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("seg_id"))


_PARTS = f"""
WITH ids AS ({_IDS}), p AS (
  SELECT doc_id, seg_id, CASE WHEN starts_with(seg_id, 'src') AND contains(seg_id, '_') THEN substr(seg_id, 4, position('_' IN seg_id) - 4) END AS a,
         CASE WHEN starts_with(seg_id, 'src') AND contains(seg_id, '_') THEN substr(seg_id, position('_' IN seg_id) + 1) END AS b FROM ids
), k AS (
  SELECT doc_id, seg_id, CASE WHEN regexp_full_match(a, '[0-9]+') AND a::HUGEINT <= 255 THEN a::BIGINT END AS src, CASE WHEN regexp_full_match(b, '[0-9]+') AND b::HUGEINT <= 4294967295 THEN b::BIGINT END AS seq FROM p
)
"""


@query(_PARTS + "SELECT doc_id, seg_id, coalesce(src, 255) AS source, coalesce(seq, 4294967295) AS seq FROM k")
def seg_key_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", "seg_id", text.seg_key_lenient(F.col("seg_id")).alias("k")).select("doc_id", "seg_id", "k.source", "k.seq")


@query(_PARTS + "SELECT doc_id, seg_id, CASE WHEN seq IS NOT NULL THEN src END AS source, CASE WHEN src IS NOT NULL THEN seq END AS seq FROM k")
def seg_key_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", "seg_id", text.seg_key_strict(F.col("seg_id")).alias("k")).select("doc_id", "seg_id", "k.source", "k.seq")


@query("SELECT o_orderkey, format('src{}_{:06d}', o_orderkey % 2, o_orderkey * 97) AS seg_id, format('src{}_{:06d}.part', o_orderkey % 2, o_orderkey * 97) AS part FROM orders")
def segment_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.segment_name(k % 2, k * 97).alias("seg_id"), text.segment_name(k % 2, k * 97, ".part").alias("part"))


_SOURCE = "CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"


def _with_source(talk: DataFrame) -> DataFrame:
    return talk.withColumn("source_id", F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2))


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_source(table(spark, sf_dir, "conversations")).withColumn("time", F.format_string("%02d:00:00", F.col("turn") % 24))


@query(f"SELECT conv_id, turn, CASE {_SOURCE} WHEN 0 THEN 'mic ' WHEN 1 THEN 'sys ' ELSE '' END AS label, CASE WHEN starts_with(concat('src', {_SOURCE}, '_x'), 'src1_') THEN 1 ELSE 0 END AS file_source FROM conversations")
def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.segment_name(F.col("source_id"), F.lit(1))
    return _talk(spark, sf_dir).select("conv_id", "turn", text.source_label(F.col("source_id")).alias("label"), text.source_of_file(name).alias("file_source"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS preview FROM documents")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("""
SELECT event_id, printf('%s %-8s %-4s chunk=%5.2fs proc=%5.3fs %s', strftime(ts, '%H:%M:%S'), event_type, concat('src', user_id % 2), value, (event_id % 1000) / 1000.0::DOUBLE,
  concat('gate ', printf('%.0f%%', (event_id % 101)::DOUBLE))) AS line FROM events
""")
def log_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.concat(F.lit("gate "), text.percent((F.col("event_id") % 101) / 100))
    line = text.log_line(F.date_format("ts", "HH:mm:ss"), F.col("event_type"), F.col("user_id") % 2, F.col("value"), (F.col("event_id") % 1000) / 1000.0, detail)
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


_HEIGHT = f"greatest(1, ceil((8 + 1 + CASE WHEN {_SOURCE} < 2 THEN 4 ELSE 0 END + length(text)) / 40.0))::BIGINT"


@query(f"SELECT conv_id, turn, {_HEIGHT} AS height FROM conversations")
def row_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(spark, sf_dir).select("conv_id", "turn", text.row_height(F.col("time"), F.col("source_id"), F.col("text"), 40).alias("height"))


@query(f"""
SELECT conv_id, turn, (sum(h) OVER (PARTITION BY conv_id ORDER BY turn, role) - h)::BIGINT AS "offset", (sum(h) OVER (PARTITION BY conv_id))::BIGINT AS total FROM (SELECT *, {_HEIGHT} AS h FROM conversations)
""")
def scroll_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _talk(spark, sf_dir).withColumn("height", text.row_height(F.col("time"), F.col("source_id"), F.col("text"), 40))
    return views.running_height(rows, "conv_id", ["turn", "role"], "height").select("conv_id", "turn", "offset", "total")


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 800")
def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.last_n(table(spark, sf_dir, "events"), ["event_id"], 800).select("event_id", "user_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
def verbose_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").withColumn("verbose_only", F.col("event_type") == "view")
    return views.shown_logs(logs, False).select("event_id", "event_type")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY ALL")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"]).withColumn("at", F.col("at.ts"))


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return views.younger_than(events.crossJoin(F.broadcast(now)), "ts", F.col("now"), "6 hours").select("event_id", "ts")  # one row


_ORDERED = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, user_id FROM (SELECT *, lag(event_type = 'click') OVER {_ORDERED} AS was FROM events) WHERE was AND event_type <> 'click'")
def pause_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.edges(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "user_id")


_RUNNING = """
WITH c AS (SELECT *, CASE event_type WHEN '{on}' THEN true WHEN '{off}' THEN false END AS control FROM events),
s AS (SELECT *, coalesce(last_value(control IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {first}) AS is_on FROM c)
SELECT event_id, user_id FROM s WHERE is_on AND control IS NULL
"""


def _while_on(spark: SparkSession, sf_dir: str, on: str, off: str, at_first: bool) -> DataFrame:
    return views.while_on(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == on, F.col("event_type") == off, at_first).select("event_id", "user_id")


@query(_RUNNING.format(on="signup", off="error", first="false"))
def recording_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _while_on(spark, sf_dir, "signup", "error", False)


@query(_RUNNING.format(on="click", off="view", first="true"))
def suppress_until_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _while_on(spark, sf_dir, "click", "view", True)


# ---- transcript

_STAMP = "CASE WHEN event_id % 10 = 9 THEN 'soon' ELSE strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') END"


@query(f"""
SELECT event_id, timestamp, row_number() OVER (ORDER BY timestamp = 'soon', timestamp, user_id % 2, value_seq, event_id) AS rank
FROM (SELECT *, {_STAMP} AS timestamp, user_id * 3 AS value_seq FROM events)
""")
def export_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 10 == 9, "soon").otherwise(F.date_format(F.date_trunc("minute", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    rows = table(spark, sf_dir, "events").select("event_id", text.segment_name(F.col("user_id") % 2, F.col("user_id") * 3).alias("seg_id"), stamp.alias("timestamp"))
    return views.export_sorted(rows, line="event_id").select("event_id", "timestamp", F.col("rank").cast("long").alias("rank"))


_TIMES = """CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dt%H:%M:%Sz') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, ' %Y-%m-%d %H:%M:%S.%f+03:00') ELSE strftime(ts, '%Y-%m-%d') END"""


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'", "yyyy-MM-dd't'HH:mm:ss'z'", "yyyy-MM-dd HH:mm:ss", "' 'yyyy-MM-dd HH:mm:ss.SSSSSS'+03:00'"]
    made = F.date_format("ts", "yyyy-MM-dd")
    for i, form in reversed(list(enumerate(forms))):
        made = F.when(F.col("event_id") % 5 == i, F.date_format("ts", form)).otherwise(made)
    return table(spark, sf_dir, "events").select("event_id", "ts", made.alias("stamp"))


_PARSED = "CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 3 THEN ts - INTERVAL 3 HOUR END"


@query(f"SELECT event_id, {_TIMES} AS stamp, {_PARSED} AS parsed, strftime({_PARSED}, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS again FROM events")
def rfc3339_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = text.rfc3339(F.col("stamp"))
    again = F.regexp_replace(text.to_rfc3339(ts), "Z$", "+00:00")
    return _times(spark, sf_dir).select("event_id", "stamp", ts.cast("timestamp_ntz").alias("parsed"), again.alias("again"))


@query(f"SELECT event_id, strftime(coalesce({_PARSED}, TIMESTAMP '2024-01-01 00:00:00'), '%H:%M:%S') AS shown FROM events")
def local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).select("event_id", text.local_time(F.col("stamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("shown"))


_LINES = """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'not json' WHEN 1 THEN concat('{"seg_id":"a","source_id":', user_id, ',"text":"t","duration_sec":1.5}')
  WHEN 2 THEN concat('{"seg_id":7,"source_id":1,"text":"t","duration_sec":1,"timestamp":"x"}') WHEN 3 THEN concat('{"seg_id":"s","source_id":', 200 + event_id % 100, ',"text":"t","duration_sec":1,"timestamp":"x"}')
  ELSE concat('{"seg_id":"src0_', event_id, '","source_id":', event_id % 2, ',"text":"é","duration_sec":', event_id, ',"timestamp":"x","more":', props, '}') END AS line FROM events
"""


_VALID = f"""
WITH l AS ({_LINES})
SELECT event_id, CASE WHEN event_id % 8 = 3 THEN 's' ELSE concat('src0_', event_id) END AS seg_id, (CASE WHEN event_id % 8 = 3 THEN 200 + event_id % 100 ELSE event_id % 2 END)::BIGINT AS source_id,
  (CASE WHEN event_id % 8 = 3 THEN 1 ELSE event_id END)::DOUBLE AS duration_sec
FROM l WHERE event_id % 8 > 3 OR (event_id % 8 = 3 AND 200 + event_id % 100 <= 255)
"""


@query(_VALID)
def jsonl_decode_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, False)


@query(_VALID)
def jsonl_decode_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict decoder, outside the JVM."""
    return _decoded(spark, sf_dir, True)


def _decoded(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    lines = spark.sql(_LINES.replace("FROM events", "FROM {events}").replace("concat('{", "concat('{{").replace("}')", "}}')").replace("VARCHAR", "STRING"), events=table(spark, sf_dir, "events"))
    return transcript.decoded(lines, "line", exact).select("event_id", "seg_id", F.col("source_id").cast("long").alias("source_id"), "duration_sec")


@query("SELECT to_json({'seg_id': concat('src', turn % 2, '_', conv_id), 'source_id': turn % 2, 'text': text, 'duration_sec': turn + 0.5::DOUBLE, 'timestamp': 'at ' || turn})::VARCHAR AS value FROM conversations")
def jsonl_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    seg = F.concat(F.lit("src"), (turn % 2).cast("string"), F.lit("_"), F.col("conv_id").cast("string"))
    entries = table(spark, sf_dir, "conversations").select(seg.alias("seg_id"), (turn % 2).alias("source_id"), "text", (turn + 0.5).alias("duration_sec"), F.concat(F.lit("at "), turn.cast("string")).alias("timestamp"))
    return transcript.encode(entries)


@query("SELECT event_id, value, 0 AS source_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value, 1 AS source_id FROM events WHERE event_type = 'view'")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = lambda kind: e.where(F.col("event_type") == kind).select("event_id", "value")
    return views.multiplexed({0: one("click"), 1: one("view")})


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page(table(spark, sf_dir, "events"), [F.col("ts"), F.col("event_id")], 100, 50).select("event_id", "event_type")


@query(r"SELECT doc_id, greatest(1, list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(1, ceil(length(x) / 80.0)))))::BIGINT AS rows FROM documents")
def wrapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.wrapped_rows(F.split("text", "\n"), 80).alias("rows"))


@query("SELECT o_orderkey, concat('transcript_dump_', strftime(o_orderdate, '%Y-%m-%d_%H%M%S'), CASE WHEN o_orderkey % 2 = 0 THEN concat('_', o_custkey) ELSE '' END, '.jsonl') AS name FROM orders")
def dump_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.dump_name(F.col("o_orderdate"), F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).alias("name"))


@query("SELECT concat('src0_', user_id) AS seg_id, count(*)::INTEGER AS attempts, count(*) < 15 AS again FROM events WHERE event_type = 'error' GROUP BY user_id")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = table(spark, sf_dir, "events").select(F.concat(F.lit("src0_"), F.col("user_id").cast("string")).alias("seg_id"), F.when(F.col("event_type") == "error", "error").otherwise("kept").alias("reason"))
    return queue.dead_letters(tried, most=15)


# ---- lookups, settings, small texts

_ASKED = ["default", " Default", "id:3", "id:9", "id:99", "micidx:7", "micidx:70", "micidx:x", "12", "012", "+3", "70", "ation_1", "NATION_24", "nope", "", "0", "default-output", "lbidx:2", "lbidx:9", "8"]


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for devices; every fifth one cannot record."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("pos"), F.concat(F.lit("id:"), k.cast("string")).alias("id"), F.col("n_name").alias("name"), (k % 5 != 4).alias("input"))


def _queries(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(q) for q in _ASKED])).alias("query"))


#: Written from the rules: what each form of a query means, and the error where that is not there.
_FORMS = f"""
WITH q AS (SELECT unnest({_ASKED!r}) AS query), f AS (
  SELECT query, trim(query) AS t, lower(trim(query)) AS low,
         CASE WHEN regexp_full_match(trim(query), '[+]?[0-9]+') THEN trim(query)::BIGINT END AS num,
         CASE WHEN starts_with(trim(query), 'micidx:') OR starts_with(trim(query), 'lbidx:') THEN split_part(trim(query), ':', 2) END AS rest FROM q
), d AS (SELECT n_nationkey::BIGINT AS pos, concat('id:', n_nationkey) AS id, n_name AS name, n_nationkey % 5 <> 4 AS records FROM nation)
"""


@query(_FORMS + """
, can AS (SELECT pos, name, row_number() OVER (ORDER BY pos) - 1 AS nth FROM d WHERE records), found AS (
  SELECT query, 1::BIGINT AS rule, (SELECT min(pos) FROM can) AS pos, 'no default device' AS error FROM f WHERE low = 'default'
  UNION ALL SELECT query, 2, (SELECT pos FROM d WHERE d.id = t AND records), CASE WHEN t IN (SELECT id FROM d) THEN 'not an input' ELSE 'no such id' END FROM f WHERE starts_with(t, 'id:')
  UNION ALL SELECT query, 3, (SELECT pos FROM can WHERE nth = try_cast(rest AS BIGINT)), CASE WHEN try_cast(rest AS BIGINT) IS NULL THEN 'not a number' ELSE 'no such position' END FROM f WHERE starts_with(t, 'micidx:')
  UNION ALL SELECT query, 4, (SELECT pos FROM can WHERE nth = num), 'no such position' FROM f WHERE num IS NOT NULL
  UNION ALL SELECT query, 5, (SELECT min(pos) FROM can WHERE contains(lower(name), low)), 'no such name' FROM f WHERE num IS NULL AND low <> 'default' AND NOT starts_with(t, 'id:') AND NOT starts_with(t, 'micidx:')
)
SELECT query, pos, (SELECT name FROM d WHERE d.pos = found.pos) AS name, rule, CASE WHEN pos IS NULL THEN error END AS error FROM found
""")
def device_lookup_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microphones among the devices that record; an id may name another one, which is an error."""
    return lookup.find_device(_devices(spark, sf_dir), _queries(spark)).withColumn("rule", F.col("rule").cast("long"))


#: Regions are the outputs; loopback devices are the nations with an even key, counted among themselves.
_LOOP = """
, lb AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, concat('Monitor of ', CASE WHEN d.pos = 6 THEN 'ASIA 5' ELSE name END) AS name FROM d WHERE d.pos % 2 = 0),
o AS (SELECT 0 AS pos, 'default-output' AS name UNION ALL SELECT r_regionkey + 1, r_name FROM region)
"""


@query(_FORMS + _LOOP + """
, hop AS (SELECT query, CASE WHEN o.name = 'default-output' THEN (SELECT min(pos) FROM lb) ELSE (SELECT min(lb.pos) FROM lb WHERE contains(lower(lb.name), lower(o.name))) END AS pos FROM f JOIN o ON o.pos = f.num),
found AS (
  SELECT query, 1::BIGINT AS rule, (SELECT min(pos) FROM lb) AS pos, 'no default device' AS error FROM f WHERE low IN ('default', 'default-output')
  UNION ALL SELECT query, 2, (SELECT pos FROM lb WHERE lb.id = t), 'no such id' FROM f WHERE starts_with(t, 'id:')
  UNION ALL SELECT query, 3, (SELECT pos FROM lb WHERE lb.pos = try_cast(rest AS BIGINT)), CASE WHEN try_cast(rest AS BIGINT) IS NULL THEN 'not a number' ELSE 'no such position' END FROM f WHERE starts_with(t, 'lbidx:')
  UNION ALL SELECT f.query, CASE WHEN hop.pos IS NOT NULL THEN 4 ELSE 5 END, coalesce(hop.pos, (SELECT min(lb.pos) FROM lb WHERE contains(lower(lb.name), low))), 'no such name'
    FROM f LEFT JOIN hop ON hop.query = f.query WHERE low NOT IN ('default', 'default-output') AND NOT starts_with(t, 'id:') AND NOT starts_with(t, 'lbidx:')
)
SELECT query, pos, (SELECT name FROM lb WHERE lb.pos = found.pos) AS name, rule, CASE WHEN pos IS NULL THEN error END AS error FROM found
""")
def loopback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = _devices(spark, sf_dir).where("pos % 2 = 0")
    loop = even.select((F.col("pos") / 2).cast("long").alias("pos"), "id", F.concat(F.lit("Monitor of "), F.when(F.col("pos") == 6, "ASIA 5").otherwise(F.col("name"))).alias("name"))
    outputs = lookup.with_default_output(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name")))
    return lookup.find_loopback(lookup.loopback_monitors(loop), outputs, _queries(spark)).withColumn("rule", F.col("rule").cast("long"))


@query(f"""
WITH q AS (SELECT unnest({_ASKED!r}) AS query), d AS (SELECT n_nationkey::BIGINT AS pos, n_name AS name FROM nation),
f AS (SELECT query, lower(query) AS low, CASE WHEN regexp_full_match(query, '[+]?[0-9]+') THEN query::BIGINT END AS num FROM q),
found AS (
  SELECT query, 1::BIGINT AS rule, (SELECT min(pos) FROM d) AS pos, 'no default device' AS error FROM f WHERE low IN ('default', 'default-output')
  UNION ALL SELECT query, 4, CASE WHEN num = 0 THEN (SELECT min(pos) FROM d) ELSE (SELECT pos FROM d WHERE d.pos = num - 1) END, 'no such position' FROM f WHERE num IS NOT NULL
  UNION ALL SELECT query, 5, (SELECT min(pos) FROM d WHERE contains(lower(name), low)), 'no such name' FROM f WHERE num IS NULL AND low NOT IN ('default', 'default-output')
)
SELECT query, pos, (SELECT name FROM d WHERE d.pos = found.pos) AS name, rule, CASE WHEN pos IS NULL THEN error END AS error FROM found
""")
def output_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find_output(_devices(spark, sf_dir).select("pos", "name"), _queries(spark)).withColumn("rule", F.col("rule").cast("long"))


@query(f"""
WITH q AS (SELECT unnest({_ASKED!r}) AS query), d AS (SELECT n_nationkey::BIGINT AS pos, concat('id:', n_nationkey) AS id, n_name AS name FROM nation)
SELECT query, coalesce((SELECT min(pos) FROM d WHERE d.id = query),
  (SELECT pos FROM d WHERE starts_with(query, 'micidx:') AND d.pos = try_cast(substr(query, 8) AS BIGINT)),
  (SELECT pos FROM d WHERE regexp_full_match(query, '[+]?[0-9]+') AND d.pos = try_cast(query AS BIGINT)),
  (SELECT min(pos) FROM d WHERE contains(lower(name), lower(query))), 0) AS pos FROM q
""")
def selected_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.selected_index(_devices(spark, sf_dir), _queries(spark))


@query("""
WITH q AS (SELECT DISTINCT lower(substr(p_name, p_partkey % 5 + 1, p_partkey % 9)) AS part FROM part UNION SELECT lower(substr(c_name, 6, 3 + c_custkey % 9)) FROM customer)
SELECT part, min(p_partkey) AS pos FROM q JOIN part ON contains(lower(p_name), part) GROUP BY part
""")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part whose name contains a text, by the index whatever the sizes."""
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    texts = part.select(F.lower(F.substr("p_name", (F.col("p_partkey") % 5 + 1).cast("int"), (F.col("p_partkey") % 9).cast("int"))).alias("_part"))
    texts = texts.unionByName(customer.select(F.lower(F.substr("c_name", F.lit(6), (3 + F.col("c_custkey") % 9).cast("int"))).alias("_part")))
    names = part.select(F.col("p_partkey").alias("_pos"), F.col("p_name").alias("_name"))
    return first_with_part(texts, names, (0, 0)).select(F.col("_part").alias("part"), F.col("_hit._pos").alias("pos"))


@query("SELECT 0::BIGINT AS pos, 'default-output' AS name UNION ALL SELECT r_regionkey + 1, r_name FROM region")
def output_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lookup.with_default_output(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name")))
    return listed.select(F.col("pos").cast("long").alias("pos"), "name")


@query("SELECT s_suppkey, name FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('MONITOR of ', s_name) ELSE s_name END AS name FROM supplier) WHERE contains(lower(name), 'monitor')")
def loopback_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("MONITOR of "), "s_name")).otherwise(F.col("s_name")).alias("name"))
    return lookup.loopback_monitors(named)


_GIVEN = "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END"
_SAVED = "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END"


@query(f"SELECT c_custkey, coalesce(nullif({_GIVEN}, ''), CASE WHEN c_custkey % 2 = 1 THEN nullif({_SAVED}, '') END, 'default') AS mic FROM customer")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    saved = F.when(k % 2 == 1, F.when(k % 4 == 0, "").otherwise(F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.merged(F.when(k % 3 == 0, F.col("c_mktsegment")), saved, default="default").alias("mic"))


_ENV = "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'yes' WHEN 4 THEN ' on' WHEN 5 THEN '' ELSE '2' END"


@query(f"""SELECT c_custkey, t AS truthy, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 2 = 0 END, t, c_custkey % 2 = 0) AS flag
FROM (SELECT c_custkey, CASE WHEN env IS NOT NULL THEN lower(env) IN ('1', 'true', 'yes', 'on') END AS t FROM (SELECT c_custkey, {_ENV} AS env FROM customer))""")
def truthy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, env = F.col("c_custkey"), F.lit("2")
    for i, v in reversed(list(enumerate([None, "1", "TRUE", "yes", " on", ""]))):
        env = F.when(k % 7 == i, F.lit(v)).otherwise(env)
    return table(spark, sf_dir, "customer").select("c_custkey", text.truthy(env).alias("truthy"), text.merged_flag(k % 5 == 0, k % 2 == 0, env).alias("flag"))


@query(f"SELECT doc_id, translate(text, '{text.CYRILLIC_KEYS}{text.CYRILLIC_KEYS.upper()}{text.LATIN_KEYS.upper()}', '{text.LATIN_KEYS * 3}') AS keys, translate(translate(text, '{text.LATIN_KEYS}', '{text.CYRILLIC_KEYS}'), '{text.CYRILLIC_KEYS}{text.CYRILLIC_KEYS.upper()}{text.LATIN_KEYS.upper()}', '{text.LATIN_KEYS * 3}') AS typed FROM documents")
def key_transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the texts, and of the texts as typed in the other layout."""
    typed = F.translate("text", text.LATIN_KEYS, text.CYRILLIC_KEYS)
    return table(spark, sf_dir, "documents").select("doc_id", text.physical_key(F.col("text")).alias("keys"), text.physical_key(typed).alias("typed"))


@query("SELECT p_partkey, p_name AS path FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey, '\"' || p_name AS path FROM part WHERE p_partkey % 4 = 3")
def path_unquote(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    quoted = F.when(k == 0, F.concat(F.lit('  "'), name, F.lit('" '))).when(k == 1, F.concat(F.lit("' "), name, F.lit("'"))).when(k == 2, F.concat(F.lit(" "), name)).otherwise(F.concat(F.lit('"'), name))
    return table(spark, sf_dir, "part").select("p_partkey", text.unquoted(quoted).alias("path"))


@query("""
SELECT s_suppkey, concat_ws(' | ', s_name, CASE WHEN s_suppkey % 3 = 1 THEN 'maker' END, CASE WHEN s_suppkey % 2 = 0 THEN concat('id:', s_nationkey) END, CASE WHEN s_suppkey % 5 = 0 THEN 'extra' END) AS label FROM supplier
""")
def device_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    maker = F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, "maker").otherwise("")
    label = text.device_label(F.col("s_name"), maker, F.when(k % 2 == 0, F.col("s_nationkey").cast("string")).otherwise(""), F.when(k % 5 == 0, "extra"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", label.alias("label"))


@query("SELECT doc_id, concat(n, ' samples') AS text FROM (SELECT doc_id, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n FROM documents) WHERE n > 0")
def stub_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recogniser interface with a stand-in engine: letters, as 16-bit numbers, are the samples."""
    letters = F.encode(F.regexp_replace("text", "[^a-z]", ""), "UTF-16LE")
    return asr.transcripts(table(spark, sf_dir, "documents").select("doc_id", letters.alias("pcm")), "pcm", asr.CountingEngine).select("doc_id", "text")


PART = 500  # frames of a segment, at most

@query(f"""
WITH f AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {PART} AS part FROM events),
s AS (SELECT user_id, part, count(*) AS n, count(*) FILTER (event_type = 'purchase' AND value > 300) AS spoken FROM f GROUP BY ALL)
SELECT concat('src0_', user_id, '_', part) AS seg_id, CASE WHEN spoken = 0 THEN 'silent' ELSE 'kept' END AS reason, CASE WHEN spoken = 0 THEN 'drop' WHEN spoken / n < 0.15 THEN 'trim' ELSE 'pass' END AS action FROM s
""")
def process_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a segment; a user's events are frames of 320 equal samples, cut into segments of bounded length."""
    loud = (F.col("event_type") == "purchase") & (F.col("value") > 300)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy(*_ORDER)) - 1
    frames = table(spark, sf_dir, "events").withColumn("part", F.floor(number / PART))
    parts = frames.groupBy("user_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", loud.alias("loud")))), lambda x: x["loud"]).alias("flags"))
    samples = F.flatten(F.transform("flags", lambda f: F.array_repeat(F.when(f, 1000).otherwise(1).cast("smallint"), audio.FRAME)))
    seg_id = F.concat(F.lit("src0_"), F.col("user_id").cast("string"), F.lit("_"), F.col("part").cast("string"))
    segments = parts.select(seg_id.alias("seg_id"), F.lit(0).cast("smallint").alias("source_id"), samples.alias("samples"), "flags")
    return process_segments(segments, asr.transcriber(asr.CountingEngine), F.lit("2024-01-01 00:00:00").cast("timestamp")).select("seg_id", "reason", "action")


# ---- all events under one key, in parallel

_ALL = "WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.lit(0).alias("k"))


@query("""
WITH m AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (ORDER BY ts, event_id) AS island FROM events)
SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY island ORDER BY ts, event_id) AS run FROM m
""")
def runs_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.run_lengths(_one_key(spark, sf_dir), "k", _ORDER, F.col("event_type") == "error").select("event_id", "run")


@query(f"""
WITH s AS (SELECT event_id, event_type, coalesce(last_value(CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER w, false) AS is_on FROM events {_ALL})
SELECT event_id FROM s WHERE is_on AND event_type NOT IN ('signup', 'error')
""")
def recording_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return scan.while_on(_one_key(spark, sf_dir), "k", _ORDER, kind == "signup", kind == "error", False).select("event_id")


@query(f"""
WITH s AS (SELECT event_id, event_type = 'signup' AS change, coalesce(last_value(CASE event_type WHEN 'signup' THEN value END IGNORE NULLS) OVER w, -1) AS config, count(*) FILTER (event_type = 'signup') OVER w AS generation FROM events {_ALL})
SELECT event_id, config, generation FROM s WHERE NOT change
""")
def reconfigured_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.configured(_one_key(spark, sf_dir), "k", _ORDER, F.col("event_type") == "signup", F.col("value"), "double", -1.0)
    return rows.select("event_id", "config", "generation")


@query("""
WITH s AS (SELECT event_id, length(event_type) AS height, event_type = 'error' AS is_on, lag(event_type = 'error') OVER (ORDER BY ts, event_id) AS before,
  sum(length(event_type)) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(length(event_type)) OVER () AS total FROM events)
SELECT event_id, (upto - height)::BIGINT AS "offset", total::BIGINT AS total, before AND NOT is_on AS falls FROM s WHERE before AND NOT is_on
""")
def offsets_at_falls_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one_key(spark, sf_dir).withColumn("height", F.length("event_type"))
    falls = scan.edges(rows, "k", _ORDER, F.col("event_type") == "error").select("event_id", F.lit(True).alias("falls"))
    return scan.running_height(rows, "k", _ORDER, "height").join(falls, "event_id").select("event_id", "offset", "total", "falls")


@query("""
WITH d AS (SELECT event_id, ts, max(event_type = 'purchase' AND value > 150) OVER (ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS keep FROM events)
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM d WHERE keep
""")
def dilate_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames near speech, numbered anew."""
    speech = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    return scan.dilate(_one_key(spark, sf_dir), "k", _ORDER, speech, 15, True).select("event_id", "position")


# ---- streams without an order


@query(_FOLD)
def stream_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each user dealt over four micro-batches by chance, and put in order by their numbers."""
    from larkstream.session import cut, shared_folder
    from larkstream.streaming.reorder import segment_unordered
    from larkstream.streaming.segments import fed

    folder = shared_folder(spark, "unordered")
    numbered = scan.scan(scan.in_order(table(spark, sf_dir, "events"), "user_id", _ORDER), {"place": scan.Run(F.lit(1))})
    rows = numbered.select(F.col("user_id").alias("key"), (F.col("place") - 1).alias("place"), F.lit("data").alias("kind"), F.col("value").alias("length"), F.array(F.col("event_type") != "error").alias("verdicts"))
    ends = rows.groupBy("key").agg((F.max("place") + 1).alias("place")).select("key", "place", F.lit("eof").alias("kind"), F.lit(0.0).alias("length"), F.array().cast("array<boolean>").alias("verdicts"))
    mixed = rows.unionByName(ends).withColumn("part", F.pmod(F.xxhash64("key", "place"), F.lit(4)))
    mixed = cut(mixed)
    parts = [mixed.where(F.col("part") == k).drop("part") for k in range(4)]  # the later ones hold what the earlier ones lack
    return fed(spark, parts, lambda stream: segment_unordered(stream, SILENCE, LEAST, GREATEST, 86_400_000), folder).withColumnRenamed("key", "user_id")


@query("""
WITH c AS (SELECT *, event_type = 'signup' AS change FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN change THEN value END IGNORE NULLS) OVER w, -1) AS config, count(*) FILTER (change) OVER w AS generation FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, config, generation FROM s WHERE NOT change
""")
def stream_reconfigured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that change in a stream of three micro-batches."""
    from larkstream.session import shared_folder
    from larkstream.streaming.reconfigure import configured_stream
    from larkstream.streaming.segments import fed

    folder, events = shared_folder(spark, "configured"), table(spark, sf_dir, "events")
    place = F.format_string("%s %020d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "event_id")
    rows = events.select(F.col("user_id").alias("key"), place.alias("ord"), F.col("event_id").alias("id"), (F.col("event_type") == "signup").alias("change"), F.col("value").alias("setting"), "ts")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    ends = [low + (high - low) * k / 3 for k in (1, 2)] if low else []
    parts = []
    for k in range(3):
        mine = rows.where((F.col("ts") >= F.lit(ends[k - 1])) if k and ends else F.lit(True)).where((F.col("ts") < F.lit(ends[k])) if ends and k < 2 else F.lit(bool(ends) or not k))
        parts.append(mine.drop("ts"))
    return fed(spark, parts, lambda stream: configured_stream(stream, -1.0), folder).select(F.col("id").alias("event_id"), "config", "generation")
