"""Queries over files, settings, views and arrays, beside those of `queries`; the same registry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkstream.functions import audio, text
from larkstream.operators import frames, gate, queue, scan, views
from larkstream.operators.order import global_rank
from larkstream.plans.queries import _I16, _i16, _with_source, query, table
from larkstream.session import shared_folder
from larkstream.sources import files, transcript, wav

# ---- chunks and frames

_LINE = f"SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS spot, x, vec_id % 7 = 0 AS reset FROM (SELECT label, vec_id, unnest({_I16}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label are its chunks."""
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", _i16().alias("samples"))


def _summed(chunks: DataFrame) -> DataFrame:
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x)
    return chunks.select("label", F.col("run").cast("long").alias("run"), "position", F.size("samples").cast("long").alias("n"), total.alias("total"))


@query(f"""
WITH l AS ({_LINE}) SELECT label, 0::BIGINT AS run, spot // 512 AS position, count(*) AS n, sum(x)::BIGINT AS total FROM l GROUP BY ALL HAVING count(*) = 512
""")
def rechunk_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(frames.rechunk(_signal(spark, sf_dir), "label", ["vec_id"], "samples", 512))


@query(f"""
WITH l AS ({_LINE}),
r AS (SELECT label, x, spot, count(DISTINCT CASE WHEN reset THEN vec_id END) OVER (PARTITION BY label ORDER BY vec_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l),
p AS (SELECT label, x, run, row_number() OVER (PARTITION BY label, run ORDER BY spot) - 1 AS spot FROM r)
SELECT label, run, spot // {audio.FRAME} AS position, count(*) AS n, sum(x)::BIGINT AS total FROM p GROUP BY ALL HAVING count(*) = {audio.FRAME}
""")
def frame_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over chunk borders; what is left over is dropped where a pause ends."""
    return _summed(frames.rechunk(_signal(spark, sf_dir), "label", ["vec_id"], "samples", audio.FRAME, F.col("vec_id") % 7 == 0))


def _loud():
    return lambda frame: float(np.mean(np.square(frame, dtype=np.float64))) > 60_000.0


@query(f"""
WITH l AS ({_LINE}),
f AS (SELECT label, spot // {audio.FRAME} AS frame, max(vec_id) AS vec_id, avg(x::DOUBLE * x) > 60000 AS speech FROM l GROUP BY ALL HAVING count(*) = {audio.FRAME}),
v AS (SELECT label, vec_id, string_agg(CASE WHEN speech THEN '1' ELSE '0' END, '' ORDER BY frame) AS verdicts FROM f GROUP BY ALL)
SELECT label, vec_id, len(embedding)::INTEGER AS n_samples, coalesce(verdicts, '') AS verdicts FROM embeddings LEFT JOIN v USING (label, vec_id)
""")
def frame_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames heard in order by a classifier of each source."""
    heard = frames.frame_verdicts(_signal(spark, sf_dir), "label", ["vec_id"], "samples", _loud)
    return heard.select("label", "vec_id", "n_samples", F.array_join(F.transform("verdicts", lambda v: F.when(v, "1").otherwise("0")), "").alias("verdicts"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS any_speech, count(*) / 16000.0::DOUBLE AS seconds FROM events GROUP BY user_id")
def any_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.any_speech(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase")


@query(f"SELECT vec_id, len(embedding) / 16000.0::DOUBLE AS seconds, ceil((label + 1) / 10.0::DOUBLE * 16000 / 320)::INTEGER AS frames FROM embeddings")
def clip_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames_of = audio.silence_frames_of((F.col("label") + 1) / 10.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", audio.duration_sec(F.col("embedding")).alias("seconds"), frames_of.alias("frames"))


# ---- files


_SAMPLES = f"SELECT concat('src0_', lpad(vec_id::VARCHAR, 6, '0')) AS seg_id, {_I16} AS s FROM embeddings"


def _segment_files(spark: SparkSession, sf_dir: str):
    """The vectors as segments, written through the sink, and the listing of its folder."""
    folder = shared_folder(spark, "wavs")
    wav.write_segments(table(spark, sf_dir, "embeddings").select(text.segment_name(F.lit(0), F.col("vec_id")).alias("seg_id"), _i16().alias("samples")), folder)
    return folder, files.with_samples(files.segment_files(files.listing(spark, folder)))


@query(f"SELECT seg_id, 16000 AS rate, len(s)::BIGINT AS n, list_sum(s)::BIGINT AS total, len(s) / 16000.0::DOUBLE AS seconds, len(s) / 16000.0::DOUBLE AS by_header FROM ({_SAMPLES})")
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as files, listed, and read again by header and by content."""
    folder, listed = _segment_files(spark, sf_dir)
    read = files.read_wav(spark, folder).where("error is null").withColumn("seg_id", text.stem(F.col("name")))
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x)
    heads = wav.headers(listed).select(text.stem(F.col("name")).alias("seg_id"), F.col("seconds").alias("by_header"))
    return read.join(heads, "seg_id").select("seg_id", "rate", F.size("samples").cast("long").alias("n"), total.alias("total"), audio.duration_sec(F.col("samples")).alias("seconds"), "by_header")


@query(f"""
WITH x AS (SELECT seg_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM ({_SAMPLES}) WHERE seg_id NOT LIKE '%7')
SELECT seg_id, i // 10 * 10 AS first, count(*) AS n, sum(x)::BIGINT AS total FROM x GROUP BY ALL
""")
def wav_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ten samples out of ranges of thirty; files that the listing leaves out are not opened."""
    _, listed = _segment_files(spark, sf_dir)
    read = wav.samples(listed.where("seg_id not like '%7'"), 10, 30)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x)
    return read.select(text.stem(F.col("name")).alias("seg_id"), "first", F.size("samples").cast("long").alias("n"), total.alias("total"))


_NAMES = "SELECT o_orderkey, concat('src', o_custkey % 3, '_', lpad(o_orderkey::VARCHAR, 6, '0'), CASE o_orderkey % 4 WHEN 0 THEN '.part' WHEN 1 THEN '.WAV' ELSE '.wav' END) AS name, o_orderkey % 90 AS length FROM orders"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    end = F.when(k % 4 == 0, ".part").when(k % 4 == 1, ".WAV").otherwise(".wav")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("src"), (F.col("o_custkey") % 3).cast("string"), F.lit("_"), F.lpad(k.cast("string"), 6, "0"), end).alias("name"), (k % 90).alias("length"))


@query(f"SELECT o_orderkey, replace(name, '.wav', '') AS seg_id, CASE WHEN starts_with(name, 'src1_') THEN 1 ELSE 0 END AS source_id FROM ({_NAMES}) WHERE suffix(name, '.wav') AND length > 44".replace("suffix(", "ends_with("))
def segment_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.segment_files(files.with_samples(_names(spark, sf_dir))).select("o_orderkey", "seg_id", "source_id")


@query(f"SELECT o_orderkey, name FROM ({_NAMES}) WHERE ends_with(name, '.part')")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.orphans(_names(spark, sf_dir)).select("o_orderkey", "name")


@query("SELECT count(*) AS deleted, 0::BIGINT AS failed, (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 3) AS left_over FROM supplier WHERE s_suppkey % 4 <> 3")
def acknowledged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of finished segments are deleted, those of failed ones stay."""
    folder = shared_folder(spark, "acknowledged")
    files.make_folder(spark, folder)
    k = F.col("s_suppkey")
    reason = F.when(k % 4 == 0, "kept").when(k % 4 == 1, "silent").when(k % 4 == 2, "no_text").otherwise("error")
    done = table(spark, sf_dir, "supplier").select(text.segment_name(F.lit(0), k).alias("seg_id"), reason.alias("reason"), F.array(F.lit(1).cast("smallint")).alias("samples"))
    files.write_wavs(done, folder).count()
    listed = files.segment_files(files.listing(spark, folder)).select("seg_id", "path")
    counts = files.delete_files(queue.acknowledged(done, listed)).agg(F.count_if("gone").alias("deleted"), F.count_if(~F.col("gone")).alias("failed"))
    deleted, failed = counts.first()
    return files.listing(spark, folder).agg(F.lit(deleted).cast("long").alias("deleted"), F.lit(failed).cast("long").alias("failed"), F.count(F.lit(1)).alias("left_over"))


@query("SELECT concat('src0_', user_id) AS seg_id, count(*)::INTEGER AS attempts FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) < 15")
def retry_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed segments whose files go back to the queue."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("src0_"), F.col("user_id").cast("string")).alias("seg_id"), F.when(F.col("event_type") == "error", "error").otherwise("kept").alias("reason"))
    letters = queue.dead_letters(events, most=15)
    return queue.to_retry(letters, events.select("seg_id").distinct())


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 3 > 0")
def still_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    pending = queue.unprocessed(docs, table(spark, sf_dir, "labels"), "doc_id")
    return queue.still_there(pending, docs.where("doc_id % 3 > 0"), "doc_id")


@query("""
WITH i AS (SELECT concat('src', doc_id % 3, '_', doc_id) AS id FROM documents UNION ALL SELECT concat('src', doc_id % 2, '_', doc_id * 2) FROM labels)
SELECT cast(substr(id, 4, 1) AS BIGINT) AS source, max(cast(substr(id, 6) AS BIGINT)) AS max_seq FROM i GROUP BY ALL
""")
def seed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest number of each source in file names and in entries."""
    d = F.col("doc_id")
    names = table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), (d % 3).cast("string"), F.lit("_"), d.cast("string"), F.lit(".wav")).alias("name"))
    entries = table(spark, sf_dir, "labels").select(F.concat(F.lit("src"), (d % 2).cast("string"), F.lit("_"), (d * 2).cast("string")).alias("seg_id"))
    return queue.seed_numbers(names, entries)


def _entries(talk: DataFrame) -> DataFrame:
    seg = F.concat(F.lit("src"), (F.col("turn") % 2).cast("string"), F.lit("_"), F.col("conv_id").cast("string"))
    stamp = F.format_string("2024-01-01T%02d:00:00Z", F.col("turn") % 24)
    return _with_source(talk).select(seg.alias("seg_id"), F.col("source_id").cast("smallint").alias("source_id"), "text", F.col("turn").cast("double").alias("duration_sec"), stamp.alias("timestamp"))


@query("SELECT concat('src', turn % 2, '_', conv_id) AS seg_id, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS source_id, text, turn::DOUBLE AS duration_sec, printf('2024-01-01T%02d:00:00Z', turn % 24) AS timestamp FROM conversations")
def transcript_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended, emptied, appended again in two parts, and read back."""
    path = shared_folder(spark, "transcript")
    entries = _entries(table(spark, sf_dir, "conversations"))
    transcript.append(entries, path)
    transcript.truncate(spark, path)
    transcript.append(entries.where("source_id = 0"), path)
    transcript.append(entries.where("source_id <> 0"), path)
    return transcript.read_entries(spark, path).drop("line_no").withColumn("source_id", F.col("source_id").cast("int"))


@query("""
WITH e AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN 0 WHEN conv_id % 7 < 3 THEN 1 ELSE 2 END AS part FROM conversations)
SELECT concat('src', turn % 2, '_', conv_id) AS seg_id, turn::DOUBLE AS duration_sec, row_number() OVER (ORDER BY part, conv_id, turn) AS line FROM e
""")
def transcript_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three appends of unequal size, numbered as they were written."""
    path, talk = shared_folder(spark, "transcript"), table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 7
    for mine in (k == 0, (k > 0) & (k < 3), k >= 3):
        transcript.append(_entries(talk.where(mine).repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn")), path)
    return global_rank(transcript.read_entries(spark, path), F.col("line_no"), name="line").select("seg_id", "duration_sec", F.col("line").cast("long").alias("line"))


@query("SELECT count(*) AS n, count(DISTINCT concat('src', turn % 2, '_', conv_id)) AS ids FROM conversations")
def export_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    path, n = transcript.export_file(_entries(table(spark, sf_dir, "conversations")).withColumn("line_no", F.monotonically_increasing_id()), shared_folder(spark, "dumps"), datetime(2024, 1, 1))
    read = transcript.read_entries(spark, path)
    return read.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seg_id").alias("ids")).where(F.col("n") == n)


# ---- views and settings


@query("""
SELECT conv_id, total, greatest(total - 12, 0) AS most, CASE WHEN conv_id % 2 = 0 THEN greatest(total - 12, 0) ELSE least(conv_id % 20, greatest(total - 12, 0)) END AS "offset"
FROM (SELECT conv_id, sum(length(text))::BIGINT AS total FROM conversations GROUP BY conv_id)
""")
def scroll_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("height", F.length("text"))
    return views.scroll_view(rows, "conv_id", "height", F.first(F.col("conv_id") % 20), 12, F.first(F.col("conv_id") % 2 == 0))


@query("SELECT user_id, floor(epoch_us(ts) / 3600000000.0)::BIGINT AS slot, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def throttled_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen drawn once an hour shows."""
    return views.throttled(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", ["ts", "event_id"], 3_600_000)


@query("""
WITH c AS (SELECT *, event_type = 'signup' AS change FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN change THEN value END IGNORE NULLS) OVER w, -1) AS config, count(*) FILTER (change) OVER w AS generation FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, config, generation FROM s WHERE NOT change
""")
def reconfigured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.configured(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("value"), F.lit(-1.0))
    return rows.select("event_id", "config", "generation")


@query("SELECT event_id, value FROM events WHERE event_type = 'view'")
def snapshot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that is replaced shows the last rows only."""
    folder, events = shared_folder(spark, "snapshots"), table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    for kind in ("click", "view"):
        views.replace_snapshot(events.where(F.col("event_type") == kind).drop("event_type"), "larkstream_history", folder)
    shown = spark.table("larkstream_history")
    spark.catalog.dropTempView("larkstream_history")
    return shown


@query("SELECT doc_id, trim(text) AS trimmed, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS best FROM documents")
def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  \t"), F.trim("text"), F.lit(" \n"))
    found = F.filter(F.array(F.struct(F.col("source").alias("text"), F.lit(1.0).alias("confidence"))), lambda a: F.col("doc_id") % 3 > 0)
    return table(spark, sf_dir, "documents").select("doc_id", text.trimmed(padded).alias("trimmed"), text.first_alternative(found).alias("best"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('pass speech ', event_id % 101, '%') WHEN 1 THEN concat('trim → ', event_id % 10, '.5s speech ', event_id % 101, '%') END AS gate,
  CASE WHEN event_id % 5 = 0 THEN 'ERROR: lost' WHEN event_id % 2 = 0 THEN concat(event_type, ' pipeline_seg=', event_id % 10, '.25s') ELSE event_type END AS asr FROM events
""")
def detail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    action = F.when(k % 3 == 0, "pass").when(k % 3 == 1, "trim").otherwise("drop")
    gate = text.gate_detail(action, (k % 101) / 100, (k % 10) + 0.5)
    said = text.asr_detail(F.col("event_type"), F.when(k % 5 == 0, "lost"), F.when(k % 2 == 0, (k % 10) + 0.25))
    return table(spark, sf_dir, "events").select("event_id", gate.alias("gate"), said.alias("asr"))


@query("SELECT c_custkey, (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 5 > 0 AS loopback FROM customer")
def loopback_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", text.loopback_on(k % 2 == 0, k % 5 == 0, F.when(k % 3 == 0, True)).alias("loopback"))


@query(f"SELECT label::INTEGER AS source_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_seq, list_sum({_I16})::BIGINT AS total FROM embeddings")
def chunk_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label as a source's chunks, put into a queue and streamed out of it."""
    from larkstream.streaming import queue_source
    from larkstream.streaming.segments import run_to_end

    folder = shared_folder(spark, "queue")
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", _i16().alias("samples"))
    numbered = scan.scan(scan.in_order(vectors, "label", ["vec_id"]), {"place": scan.Run(F.lit(1))})
    queue_source.enqueue(numbered.select(F.col("label").cast("smallint").alias("source_id"), (F.col("place") - 1).alias("chunk_seq"), "samples"), f"{folder}/queue", 50, 64)
    read = run_to_end(queue_source.chunks(spark, f"{folder}/queue", 64, 1_000_000), f"{folder}/out", f"{folder}/checkpoint")
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x)
    return read.select(F.col("source_id").cast("int").alias("source_id"), "chunk_seq", total.alias("total"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def live_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live view over micro-batches that come in no order, one of them twice."""
    from larkstream.streaming.live import LatestTable

    folder, events = shared_folder(spark, "live"), table(spark, sf_dir, "events").select("user_id", "value", "ts", "event_id")
    for k in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    shown = LatestTable(f"{folder}/view", ["user_id"], "value", ["ts", "event_id"])

    def twice(batch: DataFrame, batch_id: int) -> None:
        shown.merge(batch, batch_id)
        if batch_id == 1:
            shown.merge(batch, batch_id)

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return shown.read(spark).select("user_id", "value")


@query("""
SELECT count(*) FILTER (l.doc_id IS NULL) AS pending, coalesce(sum(n_chars) FILTER (l.doc_id IS NULL), 0)::DOUBLE / 1048576 AS pending_mb, sum(n_chars)::DOUBLE / 1048576 AS total_mb
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
""")
def live_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's statistics out of a stream of files and a stream of entries."""
    from larkstream.streaming.live import live_queue_stats, queue_totals

    folder = shared_folder(spark, "live")
    docs, done = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seg_id"), F.col("n_chars").alias("length")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seg_id"))
    for k in range(2):
        docs.where(F.col("seg_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{folder}/files")
        done.where(F.col("seg_id") % 2 != k).coalesce(1).write.mode("append").parquet(f"{folder}/entries")
    read = lambda name, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    shown, marks = live_queue_stats(read("files", docs.schema), read("entries", done.schema), f"{folder}/view", f"{folder}/checkpoint")
    marks.writeStream.foreachBatch(shown.merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return queue_totals(shown.read(spark))
