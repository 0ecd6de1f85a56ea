"""Strict reading, order, append, truncate, export; the queue and its recovery."""

import pytest
from pyspark.sql import functions as F

from larkstream.operators import lookup, queue, views
from larkstream.operators.order import global_rank
from larkstream.sources import files, transcript

GOOD = '{"seg_id":"src0_000001","source_id":0,"text":"a","duration_sec":1.5,"timestamp":"2026-01-01T00:00:00Z"}'
LINES = [
    (GOOD, True),
    ("not json", False),
    ("", False),
    (GOOD.replace(',"timestamp":"2026-01-01T00:00:00Z"', ""), False),
    (GOOD.replace('"source_id":0', '"source_id":null'), False),
    (GOOD.replace('"source_id":0', '"source_id":300'), False),
    (GOOD.replace('"source_id":0', '"source_id":-1'), False),
    (GOOD.replace('"source_id":0', '"source_id":1.0'), False),
    (GOOD.replace('"source_id":0', '"source_id":"1"'), False),
    (GOOD.replace("1.5", "1"), True),
    (GOOD.replace("1.5", '"1.5"'), False),
    (GOOD.replace("1.5", "NaN"), False),
    (GOOD.replace('"src0_000001"', "7"), False),
    (GOOD.replace('"text":"a"', '"text":"a","text":"b"'), False),
    (GOOD + " x", False),
    (GOOD.replace('"', "'"), False),
    (GOOD.replace('"text":"a"', '"text":"a","more":{"k":[1]}'), True),
    ("[" + GOOD + "]", False),
    (GOOD.replace("1.5", "1e1"), True),
]


@pytest.mark.parametrize("exact", [True, False])
def test_strict_lines(spark, tmp_path, exact):
    (tmp_path / "t.jsonl").write_text("\n".join(x for x, _ in LINES) + "\n")
    got = transcript.read_entries(spark, str(tmp_path / "t.jsonl"), exact)
    assert got.count() == sum(ok for _, ok in LINES)
    decode = transcript.decode_exact if exact else transcript.decode_native
    rows = spark.createDataFrame(LINES, "line string, ok boolean").select("line", "ok", decode(F.col("line")).alias("e")).collect()
    assert [(r.line, bool(r.e and r.e.seg_id)) for r in rows] == LINES


def entries(spark, *rows):
    return spark.createDataFrame([(s, 0, t, 1.0, w) for s, t, w in rows], "seg_id string, source_id smallint, text string, duration_sec double, timestamp string")


def test_missing_is_empty(spark, tmp_path):
    assert transcript.read_entries(spark, str(tmp_path / "none")).count() == 0


def test_append_truncate_append(spark, tmp_path):
    path = str(tmp_path / "t")
    transcript.append(entries(spark, ("src0_000099", "hello", "2026-03-01T12:00:00+00:00")), path)
    assert [r.text for r in transcript.read_entries(spark, path).collect()] == ["hello"]
    transcript.truncate(spark, path)
    transcript.append(entries(spark, ("src0_000002", "b", "x")), path)
    assert [r.seg_id for r in transcript.read_entries(spark, path).collect()] == ["src0_000002"]


def test_export_order(spark, tmp_path):
    t = "2026-01-01T00:00:0"
    rows = [("src0_000003", "late", t + "2Z"), ("src0_000002", "tie2", t + "1Z"), ("src0_000001", "tie1", "2026-01-01T03:00:01+03:00"), ("src0_000009", "nano2", t + "0.000000002Z"), ("src0_000010", "nano1", t + "0.000000001Z"), ("src1_000001", "bad1", "soon"), ("bad", "bad2", "soon")]
    path = str(tmp_path / "t")
    transcript.append(entries(spark, *rows).coalesce(1), path)
    read = transcript.read_entries(spark, path)
    assert transcript.export(read, str(tmp_path / "out")) == len(rows)
    want = ["nano1", "nano2", "tie1", "tie2", "late", "bad1", "bad2"]
    assert [r.text for r in views.export_sorted(read).orderBy("rank").collect()] == want
    assert [r.text for r in transcript.read_entries(spark, str(tmp_path / "out")).orderBy("line_no").collect()] == want
    with pytest.raises(ValueError):
        transcript.export(read.where("false"), str(tmp_path / "none"))


def test_lines_come_back_in_the_order_of_appends(spark, tmp_path, monkeypatch):
    """Appends of unequal size, in several parts and, read, in several blocks."""
    path, want = str(tmp_path / "t"), []
    for k, n in enumerate([3, 400, 1, 60, 0, 900, 2]):
        rows = [(f"src0_{k:06d}", f"{k} {i} " + "x" * (i % 50), "soon") for i in range(n)]
        want += [r[1] for r in rows]
        part = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, seg_id string, text string, timestamp string").repartitionByRange(4, "i").sortWithinPartitions("i")
        assert transcript.append(part.select("seg_id", F.lit(0).cast("smallint").alias("source_id"), "text", F.lit(1.0).alias("duration_sec"), "timestamp"), path) == k + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = transcript.read_entries(spark, path)
            assert [r.text for r in read.orderBy("line_no").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    read = transcript.read_entries(spark, path)
    ranked = [r.text for r in views.export_sorted(read).orderBy("rank").collect()]  # equal times and keys: as written
    assert ranked == want
    assert len(want) == read.select("line_no").distinct().count()


def test_an_append_is_there_when_the_log_says_so(spark, tmp_path):
    path = str(tmp_path / "t")
    transcript.append(entries(spark, ("src0_000001", "a", "x")), path)
    transcript.encode(entries(spark, ("src0_000002", "lost", "x"))).write.text(f"{path}/_data/unfinished")  # a writer that died
    assert [r.text for r in transcript.read_entries(spark, path).collect()] == ["a"]
    taken = transcript._take_number(spark, path, transcript.CUT)
    assert transcript.append(entries(spark, ("src0_000003", "b", "x")), path) == taken + 1  # cut, but not yet deleted
    assert [r.text for r in transcript.read_entries(spark, path).collect()] == ["b"]
    transcript.truncate(spark, path)
    assert transcript.read_entries(spark, path).count() == 0
    assert sorted(p.name for p in (tmp_path / "t" / "_data").iterdir() if not p.name.startswith(".")) == ["unfinished"]
    transcript.append(entries(spark, ("src0_000004", "c", "x")), path)
    assert [r.text for r in transcript.read_entries(spark, path).collect()] == ["c"]


def test_edges_of_times(spark):
    from larkstream.functions import text

    valid = ["\u00a02026-01-01T00:00:00Z\u2003", "2016-12-31T23:59:60Z", "2016-12-31T23:59:60.25+00:00", "2026-01-01t00:00:00.5z", "2026-01-01 00:00:00+03:00"]
    bad = ["2016-12-31T23:59:61Z", "2026-01-01", "", "2026-01-01T00:00:00", "2026-01-01T24:00:00Z", "x2026-01-01T00:00:00Z"]
    df = spark.createDataFrame([(t,) for t in valid + bad], "t string").select("t", text.rfc3339(F.col("t")).isNotNull().alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == {t: t in valid for t in valid + bad}
    times = ["2016-12-31T23:59:59.999999999Z", "2016-12-31T23:59:60Z", "2016-12-31T23:59:60.000000001Z", "2016-12-31T23:59:60.9Z", "2017-01-01T00:00:00Z"]
    rows = spark.createDataFrame([(f"src0_{9 - k:06d}", t, 0) for k, t in enumerate(times)], "seg_id string, timestamp string, line_no int")
    assert [r.timestamp for r in views.export_sorted(rows).orderBy("rank").collect()] == times
    assert spark.createDataFrame([("\u00a0'a b'\u2003",)], "t string").select(text.unquoted(F.col("t"))).first()[0] == "a b"


def test_queue(spark, tmp_path):
    for name in ("src0_000003.wav", "src0_000001.wav", "src1_000001.wav", "odd.wav", "orphan.part"):
        (tmp_path / name).write_bytes(b"x" * 100)
    all_files = files.listing(spark, str(tmp_path))
    assert [r.name for r in queue.orphans(all_files).collect()] == ["orphan.part"]
    pending = files.segment_files(all_files)
    done = entries(spark, ("src0_000003", "t", "x"), ("src0_000003", "t", "x"))
    left = queue.unprocessed(pending, done)
    assert [r.seg_id for r in left.orderBy(*queue.recovery_order(F.col("seg_id"))).collect()] == ["src0_000001", "src1_000001", "odd"]
    assert tuple(queue.queue_stats(pending, done).first()) == (3, 300 / 1048576, 400 / 1048576)
    assert tuple(queue.queue_stats(pending.where("false"), done).first()) == (0, 0.0, 0.0)


def test_wav(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.wav").write_bytes(files.wav_bytes(np.zeros(8000)))
    (tmp_path / "b.wav").write_bytes(b"nonsense")
    rows = {r.name: r for r in files.read_wav(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].rate == 16_000 and len(rows["a.wav"].samples) == 8000 and rows["a.wav"].error is None
    assert rows["b.wav"].error
    content = spark.read.format("binaryFile").load(str(tmp_path / "a.wav"))
    assert content.select(files.header_duration(F.col("content"))).first()[0] == 0.5


def test_global_rank_spreads(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r["rank"] == r.v + 1 for r in global_rank(df, F.col("v")).collect())


def test_lookup(spark):
    """A form that names what is not there is an error; only its own rule is tried."""
    rows = [(0, "id:0", "Built-in", True), (1, "id:1", "USB Mic", True), (2, "id:2", "HDMI 2", False)]
    devices = spark.createDataFrame(rows, "pos int, id string, name string, input boolean")
    want = {
        "default": (0, 1, None), " DEFAULT ": (0, 1, None), "id:1": (1, 2, None), "id:2": (None, 2, "not an input"), "id:7": (None, 2, "no such id"),
        "micidx:1": (1, 3, None), "micidx:01": (1, 3, None), "micidx:9": (None, 3, "no such position"), "micidx:": (None, 3, "not a number"), "micidx: 1": (None, 3, "not a number"),
        "2": (None, 4, "no such position"), "01": (1, 4, None), "+1": (1, 4, None), "3": (None, 4, "no such position"), "99999999999999999999": (None, 5, "no such name"),
        "usb": (1, 5, None), "hdmi 2": (None, 5, "no such name"), "": (0, 5, None), "-1": (None, 5, "no such name"), "nope": (None, 5, "no such name"),
    }
    asked = spark.createDataFrame([(q,) for q in [*want, "usb"]], "query string")
    assert {r.query: (r.pos, r["rule"], r.error) for r in lookup.find_device(devices, asked).collect()} == want
    names = {r.query: r.name for r in lookup.find_device(devices, asked).collect()}
    assert names["usb"] == "USB Mic" and names["3"] is None
    none = lookup.find_device(devices.where("false"), asked).collect()
    assert len(none) == len(want) and all(r.pos is None and r.error for r in none)
    assert [r.pos for r in lookup.loopback_monitors(devices.withColumn("name", F.concat("name", F.lit(" Monitor"))).where("pos = 2")).collect()] == [2]
    assert {(r.pos, r.name) for r in lookup.with_default_output(devices).collect()} >= {(0, "default-output"), (1, "Built-in")}


def test_microphones_are_counted_among_inputs(spark):
    """Places and parts of names look among devices that record; an id names any device, and the first of equal ones counts."""
    rows = [(0, "id:0", "Speakers", False), (1, "id:1", "USB Mic", True), (2, "id:2", "HDMI", False), (3, "id:3", "Line speak", True), (3, "id:3", "Line speak", True), (4, "id:1", "Twin", None)]
    devices = spark.createDataFrame(rows, "pos int, id string, name string, input boolean")
    want = {"default": 1, "0": 1, "1": 3, "speak": 3, "micidx:2": 3, "micidx:3": None, "hdmi": None, "twin": None, "id:0": None, "id:1": 1, "id:3": 3}
    asked = spark.createDataFrame([(q,) for q in want], "query string")
    got = lookup.find_device(devices, asked).collect()
    assert len(got) == len(want) and {r.query: r.pos for r in got} == want
    outputs = devices.select("pos", "name")
    assert lookup.find_output(outputs, spark.createDataFrame([("4",)], "query string")).count() == 1


def test_names_are_found_by_their_rarest_gram(spark, monkeypatch):
    import random

    from larkstream.operators import names

    monkeypatch.setattr(names, "STEP", 2)
    r = random.Random(4)
    held = [(i, "".join(r.choices("abÄ1 ", k=r.randint(0, 9))) if i % 50 else None) for i in range(400)] + [(7, "aab"), (900, "aaaaaaaaaa"), (901, "aaaaaaaaaab")]
    parts = ["", "a", "ab", "AB", "ä", "aaa", "aaaaaaaaaab", "zz", "abz", "11111111", "b" * 40, None] + ["".join(r.choices("abä1 ", k=r.randint(1, 7))) for _ in range(200)]
    devices = spark.createDataFrame(held, "_pos long, _name string")
    texts = spark.createDataFrame([(p,) for p in parts], "_part string")
    want = {}
    for p in parts:
        fits = [(i, n) for i, n in held if p is not None and n is not None and p.lower() in n.lower()]
        if fits:
            want[p] = min(fits)
    for few in ((0, 0), (1000, 1000)):
        assert {x._part: tuple(x._hit) for x in names.first_with_part(texts, devices, few).collect()} == want
    assert names.first_with_part(texts, devices.where("false"), (0, 0)).count() == 0


def test_copies_of_a_name_are_indexed_once(spark, monkeypatch):
    """Lists grow with the names that differ, not with their rows, and no n-gram is counted by a sort of them all."""
    from larkstream.operators import names

    ranked, rank = [], names.global_rank
    monkeypatch.setattr(names, "global_rank", lambda df, *order, **how: ranked.append(df.count()) or rank(df, *order, **how))
    devices = spark.range(3_000).select((F.col("id") + 5).alias("_pos"), F.when(F.col("id") % 2 == 0, "large ring").otherwise("LARGE Ring").alias("_name"))
    devices = devices.unionByName(spark.createDataFrame([(None, "Hot Bolt"), (1, "hot bolt"), (5, "LARGE ring")], "_pos long, _name string"))
    texts = spark.createDataFrame([("arge",), ("E RI",), ("t bo",), ("g",), ("",), ("ring large",)], "_part string")
    got = {x._part: tuple(x._hit) for x in names.first_with_part(texts, devices, (0, 0)).collect()}
    assert got == {"arge": (5, "LARGE ring"), "E RI": (5, "LARGE ring"), "t bo": (None, "Hot Bolt"), "g": (5, "LARGE ring"), "": (None, "Hot Bolt")}
    assert max(ranked) <= 4


def test_output_lookup_and_shown_choice(spark):
    outputs = spark.createDataFrame([(0, "Speakers"), (1, "HDMI 2")], "pos int, name string")
    want = {"default": (0, 1), "Default-Output": (0, 1), "0": (0, 4), "1": (0, 4), "2": (1, 4), "3": (None, 4), " 2": (1, 5), "hdmi": (1, 5), "x": (None, 5)}
    asked = spark.createDataFrame([(q,) for q in want], "query string")
    assert {r.query: (r.pos, r["rule"]) for r in lookup.find_output(outputs, asked).collect()} == want
    devices = spark.createDataFrame([(0, "id:0", "Built-in"), (1, "id:1", "USB 7")], "pos int, id string, name string")
    want = {"id:1": 1, "micidx:1": 1, "micidx:9": 0, "1": 1, "7": 1, "usb": 1, "none": 0}
    asked = spark.createDataFrame([(q,) for q in want], "query string")
    assert {r.query: r.pos for r in lookup.selected_index(devices, asked).collect()} == want


def test_settings(tmp_path, monkeypatch):
    from larkstream.sources import settings

    s = settings.DeviceSettings("2", True, "Speakers")
    s.save(str(tmp_path / "c.json"))
    assert settings.DeviceSettings.load(str(tmp_path / "c.json")) == s
    (tmp_path / "d.json").write_text('{"mic":"0","loopback":false,"x":1}')
    assert settings.DeviceSettings.load(str(tmp_path / "d.json")).loopback_device == "default-output"
    (tmp_path / "e.json").write_text('{"mic":7}')
    with pytest.raises(ValueError):
        settings.DeviceSettings.load(str(tmp_path / "e.json"))
    monkeypatch.setenv("LARKSTREAM_CONFIG", "env.json")
    assert settings.settings_path("arg.json") == "arg.json" and settings.settings_path(None) == "env.json"
    monkeypatch.delenv("LARKSTREAM_CONFIG")
    monkeypatch.chdir(tmp_path)
    assert settings.settings_path("") is None
    (tmp_path / ".env").write_text("# x\nexport A='1'\nB=2\n\n")
    assert settings.env_file(".env") == {"A": "1", "B": "2"}
    assert settings.model_fault(" ") == "empty" and settings.model_fault(str(tmp_path / "no")) == "missing" and settings.model_fault(str(tmp_path / ".env")) == "no folder" and settings.model_fault(str(tmp_path)) == "no am folder"
    (tmp_path / "am").mkdir()
    assert settings.model_fault(str(tmp_path)) == "no model"
    (tmp_path / "am/final.mdl").write_text("")
    assert settings.model_fault(str(tmp_path)) is None


def test_environment_by_rank(tmp_path):
    from larkstream.sources import settings

    (tmp_path / ".env").write_text("A=file\nB=file\n")
    given = {"A": "system", "C": "system"}
    assert settings.environment(str(tmp_path / ".env"), True, given) == {"A": "file", "B": "file", "C": "system"}
    assert settings.environment(str(tmp_path / ".env"), False, given) == {"A": "system", "B": "file", "C": "system"}
    assert settings.environment(str(tmp_path / "none"), True, given) == given
    saved = settings.DeviceSettings("2", True, "")
    merged = lambda *a, **k: vars(settings.device_settings(*a, **k))
    assert merged(None) == {"mic": "default", "loopback": False, "loopback_device": "default-output"}
    assert merged(saved) == {"mic": "2", "loopback": True, "loopback_device": "default-output"}
    assert merged(saved, mic="", no_loopback=True, loopback=True, loopback_device="x") == {"mic": "", "loopback": False, "loopback_device": "x"}


def test_export_to_one_file(spark, tmp_path):
    from datetime import datetime

    rows = entries(spark, *[(f"src0_{k:06d}", f"t{k}", f"2026-01-01T00:{59 - k:02d}:00Z") for k in range(50)]).withColumn("line_no", F.lit(0).cast("long")).repartition(5)
    now = datetime(2026, 3, 1, 12, 0, 5)
    path, n = transcript.export_file(rows, str(tmp_path / "d"), now)
    assert path.endswith("/transcript_dump_2026-03-01_120005.jsonl") and n == 50
    lines = open(path).read().splitlines()
    assert [x.split('"text":"')[1].split('"')[0] for x in lines] == [f"t{k}" for k in range(49, -1, -1)]
    again, _ = transcript.export_file(rows, str(tmp_path / "d"), now)
    assert again != path and len([p for p in (tmp_path / "d").iterdir() if p.suffix == ".jsonl"]) == 2
    assert not [p for p in (tmp_path / "d").iterdir() if "part" in p.name or p.is_dir()]
    for none, folder in ((rows.where("false"), "d"), (rows, "")):
        with pytest.raises(ValueError):
            transcript.export_file(none, folder and str(tmp_path / folder), now)


def test_finished_files_are_deleted(spark, tmp_path):
    done = spark.createDataFrame([("src0_000001", "kept"), ("src0_000002", "error"), ("src0_000003", "silent")], "seg_id string, reason string")
    segments = done.select("seg_id", F.array(F.lit(1).cast("smallint")).alias("samples"))
    files.write_wavs(segments, str(tmp_path)).count()
    listed = files.segment_files(files.listing(spark, str(tmp_path)))
    gone = files.delete_files(queue.acknowledged(done, listed)).collect()
    assert len(gone) == 2 and all(r.gone and r.error is None for r in gone)
    assert [p.name for p in tmp_path.iterdir()] == ["src0_000002.wav"]
    assert all(r.gone for r in files.delete_files(spark.createDataFrame([(str(tmp_path / "none"),)], "path string")).collect())
    assert [r.seg_id for r in queue.still_there(done, files.segment_files(files.listing(spark, str(tmp_path)))).collect()] == ["src0_000002"]


def test_names_of_a_table_do_not_clash(spark):
    df = spark.createDataFrame([(3, 1, 2), (1, 5, 6)], "v int, part int, record int").withColumnsRenamed({"part": "part"})
    df = df.selectExpr("*", "1 AS own", "2 AS n", "3 AS shift", "4 AS k0")
    got = global_rank(df, F.col("v"))
    assert got.columns == [*df.columns, "rank"] and {r.v: (r["rank"], r.part) for r in got.collect()} == {3: (2, 1), 1: (1, 5)}
    from larkstream.operators import gate

    framed = gate.whole_frames(df.withColumn("frame", F.lit("x")), "n", ["v"], 2)
    assert {(r.v, r.frame, r.own) for r in framed.collect()} == {(1, 0, 1), (3, 0, 1)}


def test_process_segments_gives_a_reason_for_each(spark):
    from larkstream.operators import asr
    from larkstream.plans.process import process_segments

    rows = [("empty", [], []), ("silent", [0] * 640, [False, False]), ("short", [0] * 10, []), ("pass", [1] * 640, [True, True]), ("trim", [1] * 320 * 40, [i == 0 for i in range(40)])]
    df = spark.createDataFrame([(s, 0, x, f) for s, x, f in rows], "seg_id string, source_id smallint, samples array<smallint>, flags array<boolean>")
    out = process_segments(df, asr.transcriber(asr.CountingEngine), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    got = {r.seg_id: (r.reason, r.text, r.duration_sec) for r in out.collect()}
    assert got == {"empty": ("empty", None, None), "silent": ("silent", None, None), "short": ("no_text", "", 10 / 16000), "pass": ("kept", "640 samples", 0.04), "trim": ("kept", "5120 samples", 0.32)}

    class Broken:
        def name(self):
            return "broken"

        def transcribe(self, samples):
            raise OSError("no model")

    assert [r.reason for r in process_segments(df.where("seg_id = 'pass'"), asr.transcriber(Broken), F.current_timestamp()).collect()] == ["error"]


def test_segments_are_written_as_files(spark, tmp_path):
    df = spark.createDataFrame([("src0_000001", [1, -2, 3]), ("src0_000002", [])], "seg_id string, samples array<smallint>")
    assert [r.seg_id for r in files.write_wavs(df, str(tmp_path)).collect()] == ["src0_000001"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["src0_000001.wav"]
    assert [list(r.samples) for r in files.read_wav(spark, str(tmp_path)).collect()] == [[1, -2, 3]]
    assert bytes(df.select(files.encode_wav(F.col("samples")).alias("w")).first().w) == files.wav_bytes([1, -2, 3])


def test_dead_letters_add_up(spark):
    now = spark.createDataFrame([("a", "error"), ("b", "kept"), ("c", "error")], "seg_id string, reason string")
    before = spark.createDataFrame([("a", 2), ("d", 1)], "seg_id string, attempts int")
    assert {r.seg_id: (r.attempts, r.again) for r in queue.dead_letters(now, before).collect()} == {"a": (3, False), "c": (1, True), "d": (1, True)}


def test_loopback_lookup(spark):
    devices = spark.createDataFrame([(0, "id:0", "Monitor of Speakers"), (1, "id:1", "Monitor of HDMI 2")], "pos int, id string, name string")
    outputs = spark.createDataFrame([(0, "default-output"), (1, "HDMI 2"), (2, "Speakers"), (3, "Phone")], "pos int, name string")
    want = {
        "default-output": (0, 1), "default": (0, 1), "lbidx:1": (1, 3), "lbidx:7": (None, 3), "id:1": (1, 2), "id:5": (None, 2), "1": (1, 4), "2": (0, 4), "0": (0, 4),
        "02": (0, 4), "3": (None, 5), "9": (None, 5), "hdmi": (1, 5), "none": (None, 5),
    }
    asked = spark.createDataFrame([(q,) for q in want], "query string")
    assert {r.query: (r.pos, r["rule"]) for r in lookup.find_loopback(devices, outputs, asked).collect()} == want


def test_numbers_go_on_from_files_and_entries(spark):
    on_disk = spark.createDataFrame([("src0_000007.wav",), ("src0_000002.part",), ("odd.wav",)], "name string")
    got = queue.seed_numbers(on_disk, entries(spark, ("src0_000009", "t", "x"), ("src1_000003", "t", "x"), ("bad", "t", "x")))
    assert {r.source: r.max_seq for r in got.collect()} == {0: 9, 1: 3}


def test_pcm_round_trip(spark):
    df = spark.createDataFrame([([1, -2, 32767],), ([],)], "s array<smallint>")
    rows = df.select("s", files.pcm_samples(files.pcm_bytes(F.col("s"))).alias("again")).collect()
    assert all(list(r.s) == list(r.again) for r in rows)
    assert bytes(df.select(files.pcm_bytes(F.col("s")).alias("b")).first().b) == b"\x01\x00\xfe\xff\xff\x7f"


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    from larkstream.streaming.segments import append_once

    for _ in range(2):
        append_once(spark.range(3), 5, str(tmp_path / "out"))
    append_once(spark.range(2), 6, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
