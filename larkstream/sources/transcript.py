"""The append-only transcript in JSON Lines: strict reading, appending, truncating, exporting.

A transcript is a folder. Each append writes its rows as part files of a folder of its own, hidden from other
readers, and then takes the next number in ``_appends``, a log with one small file for each append that names
the folder. So an append is there wholly or not at all, appends have a total order, and with the number of the
part file, the place of its block and the row within that, lines have one too: `line_no`, a struct that sorts as
the lines were written. Truncating takes a number as well; what was appended before it is not read any more.

A plain file, or a folder of part files without such a log, is read in the order of file names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkstream.operators.views import export_order
from larkstream.schemas import TRANSCRIPT

_TYPES = {"seg_id": "STRING", "text": "STRING", "timestamp": "STRING"}


def decode_native(line: Column) -> Column:
    """A struct of the five fields, or null for a line that is no valid entry; JVM only.

    Differs from `decode_exact` in accepting two objects on one line (the first counts). The line is parsed
    once and named by a lambda, so that no rule of the optimiser repeats the parsing for each field.
    """

    def entry(v: Column) -> Column:
        of_type = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        source = F.try_variant_get(v, "$.source_id", "bigint")
        numeric = of_type("duration_sec")
        ok = (
            (of_type("seg_id") == "STRING") & (of_type("text") == "STRING") & (of_type("timestamp") == "STRING")
            & (of_type("source_id") == "BIGINT") & source.between(0, 255)
            & (numeric.isin("BIGINT", "DOUBLE") | numeric.startswith("DECIMAL"))
        )
        fields = [F.try_variant_get(v, "$.seg_id", "string").alias("seg_id"), source.cast("smallint").alias("source_id"), F.try_variant_get(v, "$.text", "string").alias("text"), F.try_variant_get(v, "$.duration_sec", "double").alias("duration_sec"), F.try_variant_get(v, "$.timestamp", "string").alias("timestamp")]
        return F.when(ok, F.struct(*fields))

    parsed = F.when(line.rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(line))
    return F.get(F.transform(F.array(parsed), entry), F.lit(0))


def decoded(lines: DataFrame, line: str, exact: bool = False) -> DataFrame:
    """lines without `line`, with the fields of the entry it holds; lines that hold none are dropped.

    Rows are dropped by an explode or a map, not by a filter, which would decode each line a second time.
    """
    rest = [c for c in lines.columns if c != line]
    if not exact:
        return lines.select(F.struct(*rest).alias("r"), F.explode(F.filter(F.array(decode_native(F.col(line))), lambda e: e.isNotNull())).alias("e")).select("r.*", "e.*")
    rows = lines.select(F.struct(*rest).alias("record"), F.col(line).alias("line"))
    fields = [f.split() for f in TRANSCRIPT.split(", ")]
    schema = T.StructType([rows.schema["record"], *T.StructType.fromDDL(TRANSCRIPT).fields])
    types = {"string": pa.string(), "smallint": pa.int16(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [_entry(x or "") for x in b.column(1).to_pylist()]
            kept = [e for e in held if e]
            columns = [pa.array([e[name] for e in kept], types[kind]) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([bool(e) for e in held], pa.bool_())), *columns], ["record", *[n for n, _ in fields]])

    return rows.mapInArrow(run, schema).select("record.*", *[n for n, _ in fields])


def _entry(line: str) -> dict | None:
    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key twice")
        return dict(pairs)

    def refuse(x: str) -> float:
        raise ValueError(x)

    try:
        e = json.loads(line, object_pairs_hook=unique, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not isinstance(e, dict) or not all(isinstance(e.get(k), str) for k in _TYPES):
        return None
    if type(e.get("source_id")) is not int or not 0 <= e["source_id"] <= 255 or not number(e.get("duration_sec")):
        return None
    return {**{k: e[k] for k in _TYPES}, "source_id": e["source_id"], "duration_sec": float(e["duration_sec"])}


def decode_exact(line: Column) -> Column:
    """The strict decoder; all fields are null for a line that is no valid entry."""
    order = [f.split()[0] for f in TRANSCRIPT.split(", ")]

    @F.pandas_udf(TRANSCRIPT)
    def decode(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in lines:
            held = [_entry(x) or {} for x in s.fillna("")]
            yield pd.DataFrame({k: pd.Series([e.get(k) for e in held], dtype=object) for k in order})

    return decode(line)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and a function that makes paths below `path`."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *names]))
    return place().getFileSystem(conf), place


LOG, DATA, CUT = "_appends", "_data", "truncated"
#: append: number in the log; file: number of the part file, then its name; block and row: place in it.
LINE_NO = "struct<append:bigint,file:bigint,name:string,block:bigint,row:bigint>"


def _take_number(spark: SparkSession, path: str, what: str) -> int:
    """Writes `what` as the next entry of the log; another writer may take a number first, then the one after it is tried."""
    system, place = _files(spark, path)
    system.mkdirs(place(LOG))
    n = max([int(f.getPath().getName()) for f in system.listStatus(place(LOG)) if f.getPath().getName().isdigit()], default=0)
    while True:
        n += 1
        try:
            out = system.create(place(LOG, f"{n:020d}"), False)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            continue
        out.write(bytearray(f"{what}\n".encode()))
        out.close()
        return n


def appends(spark: SparkSession, path: str) -> DataFrame:
    """append and folder of the appends that count, those after the last truncation."""
    log = spark.read.text(f"{path.rstrip('/')}/{LOG}/*").select(F.element_at(F.split("_metadata.file_path", "/"), -1).cast("long").alias("append"), F.col("value").alias("folder"))
    last = log.agg(F.coalesce(F.max(F.when(F.col("folder") == CUT, F.col("append"))), F.lit(0)).alias("last"))
    return log.crossJoin(F.broadcast(last)).where("append > last").select("append", "folder")  # one row


def _lines(spark: SparkSession, path: str, numbered: bool) -> DataFrame:
    """value and line_no; line_no is taken where the file is read, and nothing moves."""
    meta = F.col("_metadata")
    name = meta["file_name"]
    part = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), F.lit(0))
    place = [part.alias("file"), name.alias("name"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")]
    if not numbered:
        return spark.read.text(path).select("value", F.struct(F.lit(0).cast("long").alias("append"), *place).alias("line_no"))
    known = appends(spark, path)
    if known.limit(BROADCAST_APPENDS + 1).count() <= BROADCAST_APPENDS:
        known = F.broadcast(known)
    lines = spark.read.text(f"{path.rstrip('/')}/{DATA}/*").select("value", F.element_at(F.split(meta["file_path"], "/"), -2).alias("folder"), *place)
    return lines.join(known, "folder").select("value", F.struct("append", "file", "name", "block", "row").alias("line_no"))


BROADCAST_APPENDS = 100_000


def read_entries(spark: SparkSession, path: str, exact: bool = True) -> DataFrame:
    """Valid entries of a transcript, with line_no, which sorts as they were written; empty if there is nothing."""
    system, place = _files(spark, path)
    numbered = system.exists(place(LOG))
    if not system.exists(place()) or numbered and not system.exists(place(DATA)):
        return spark.createDataFrame([], f"{TRANSCRIPT}, line_no {LINE_NO}")
    return decoded(_lines(spark, path, numbered), "value", exact).select(*[f.split()[0] for f in TRANSCRIPT.split(", ")], "line_no")


def encode(entries: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in TRANSCRIPT.split(", ")]
    return entries.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def append(entries: DataFrame, path: str) -> int:
    """Appends the rows in their order; the number of the append. Rows are seen when the log names them, all at once."""
    folder = uuid.uuid4().hex
    encode(entries).write.text(f"{path.rstrip('/')}/{DATA}/{folder}")
    return _take_number(entries.sparkSession, path, folder)


def truncate(spark: SparkSession, path: str) -> None:
    """Empties the transcript. What was appended is first hidden, by an entry of the log, and then deleted."""
    system, place = _files(spark, path)
    n = _take_number(spark, path, CUT)
    if not system.exists(place(DATA)):
        return
    for entry in system.listStatus(place(LOG)):
        if entry.getPath().getName().isdigit() and int(entry.getPath().getName()) < n:
            stream = system.open(entry.getPath())
            folder = bytes(stream.readAllBytes()).decode().strip()
            stream.close()
            if folder and folder != CUT:
                system.delete(place(DATA, folder), True)
            system.delete(entry.getPath(), False)


def export(entries: DataFrame, path: str) -> int:
    """Writes all entries in export order, as part files in that order; the number of rows. No rows are an error."""
    n = entries.count()
    if not n:
        raise ValueError("the transcript has no entries")
    encode(entries.orderBy(*export_order("seg_id", "timestamp", "line_no"))).write.text(path)
    return n


def export_file(entries: DataFrame, folder: str, now: datetime) -> tuple[str, int]:
    """The export as one file transcript_dump_<time>.jsonl in `folder`; its path and the number of rows.

    An empty folder name and no rows are errors; a name that is taken gets a random suffix. Rows are sorted
    and written in parts by all executors; one task then streams the parts into a ``.part`` file in their order,
    and that is renamed. One file has one writer, but of any size, and nothing passes through the driver.
    """
    if not folder:
        raise ValueError("the export folder has no name")
    spark = entries.sparkSession
    system, place = _files(spark, folder)
    name = f"transcript_dump_{now:%Y-%m-%d_%H%M%S}"
    if system.exists(place(name + ".jsonl")):
        name += f"_{uuid.uuid4().hex[:8]}"
    parts = f"{folder.rstrip('/')}/.{name}"
    try:
        n = export(entries, parts)
        listed = [f.getPath() for f in system.listStatus(place("." + name)) if f.getPath().getName().startswith("part-")]
        listed.sort(key=lambda p: (int(p.getName().split("-")[1]), p.getName()))
        _join_files(spark, [p.toString() for p in listed], place(name + ".part").toString() if "://" in folder else f"{folder.rstrip('/')}/{name}.part")
        system.rename(place(name + ".part"), place(name + ".jsonl"))
    finally:
        system.delete(place("." + name), True)
        system.delete(place(name + ".part"), False)
    return f"{folder.rstrip('/')}/{name}.jsonl", n


def _join_files(spark: SparkSession, parts: list[str], out: str) -> None:
    """One task copies the parts, one after another, through a buffer; a second attempt begins the file anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from larkstream.sources.files import store

        paths = [p for b in batches for p in b.column(0).to_pylist()]
        system, bare = store(out)
        with system.open_output_stream(bare) as to:
            for p in paths:
                source, name = store(p)
                with source.open_input_stream(name) as held:
                    while data := held.read(1 << 20):
                        to.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([len(paths)], pa.int64())], ["n"])

    spark.createDataFrame([(p,) for p in parts], "path string").coalesce(1).mapInArrow(run, "n long").collect()
