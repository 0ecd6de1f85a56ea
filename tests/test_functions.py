"""Scalar functions against the stated vectors."""

import math

import pytest
from pyspark.sql import functions as F

from larkstream.functions import audio, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values, kind="double"):
    return F.lit(values).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def test_mono_drops_a_partial_frame(spark):
    assert one(spark, audio.mono(array([1.0, 3, 5, 7, 9]), 2)) == [2.0, 6.0]
    assert one(spark, audio.mono(array([]), 2)) == []
    assert one(spark, audio.mono(array([1.0, 2.0]), 1)) == [1.0, 2.0]


@pytest.mark.parametrize("n,rate", [(0, 48_000), (1, 8_000), (480, 48_000), (100, 44_100), (7, 16_000)])
def test_resample_is_linear(spark, n, rate):
    x = [math.sin(i) for i in range(n)]
    ratio = rate / 16_000
    want = []
    for i in range(math.ceil(n / ratio)) if rate != 16_000 else []:
        p = i * ratio
        a, b = x[min(int(p), n - 1)], x[min(int(p) + 1, n - 1)]
        want.append(a + (b - a) * (p - int(p)))
    assert one(spark, audio.resample(array(x), rate)) == pytest.approx(want if rate != 16_000 else x)


def test_quantise_saturates_and_truncates(spark):
    values = [(1.0, 32767), (-1.2, -32768), (2.0, 32767), (1.5 / 32767, 1), (-1.5 / 32767, -1), (float("nan"), 0)]
    for v, want in values:
        assert one(spark, audio.to_i16(F.lit(v))) == want
    assert one(spark, audio.from_i16(F.lit(-32768).cast("smallint"))) == -1.0


def test_levels(spark):
    assert one(spark, audio.level(array([], "smallint"))) == 0.0
    assert one(spark, audio.level(array([32767, -32768], "smallint"))) == 1.0
    for v, want in [(0.0, "--------"), (0.5, "####----"), (1.0, "########"), (7.0, "########"), (-1.0, "--------")]:
        assert one(spark, audio.level_meter(F.lit(v))) == want


def test_constants(spark):
    assert audio.silence_frames(0.8) == 40 and audio.pad_frames(300) == 15
    assert [one(spark, audio.backoff_ms(F.lit(k))) for k in (1, 2, 20, 21)] == [600, 1200, 12000, 12000]
    assert one(spark, audio.mebibytes(F.lit(100))) == 100 / 1048576


def test_dilation_and_trim(spark):
    flags = array([i == 40 for i in range(81)], "boolean")
    assert one(spark, F.size(F.filter(audio.dilated(flags, 15), lambda f: f))) == 31
    first = array([i == 0 for i in range(81)], "boolean")
    assert one(spark, F.size(F.filter(audio.dilated(first, 15), lambda f: f))) == 16
    samples = F.array_repeat(F.lit(1).cast("smallint"), 81 * 320 + 5)
    assert one(spark, F.size(audio.trim_to_speech(samples, flags, 300))) == 9920
    short = F.array_repeat(F.lit(0).cast("smallint"), 100)
    assert one(spark, F.size(audio.trim_to_speech(short, array([], "boolean"), 300))) == 100
    assert one(spark, audio.trim_to_speech(samples, array([False] * 81, "boolean"), 300)) is None
    assert one(spark, audio.speech_ratio(array([], "boolean"))) == 1.0


@pytest.mark.parametrize(
    "seg_id,lenient,strict",
    [
        ("src0_000042", (0, 42), (0, 42)), ("src1_000001", (1, 1), (1, 1)), ("bad", (255, 4294967295), None), ("src9_abc", (9, 4294967295), None),
        ("src300_000001", (255, 1), None), ("src1_4294967296", (1, 4294967295), None), ("src_5", (255, 5), None), ("src1_2_3", (1, 4294967295), None), ("src+1_+2", (1, 2), (1, 2)), ("", (255, 4294967295), None),
    ],
)
def test_keys(spark, seg_id, lenient, strict):
    assert tuple(one(spark, text.seg_key_lenient(F.lit(seg_id)))) == lenient
    got = one(spark, text.seg_key_strict(F.lit(seg_id)))
    assert (got and tuple(got)) == strict


def test_names(spark):
    assert one(spark, text.segment_name(F.lit(1), F.lit(7), ".part")) == "src1_000007.part"
    assert one(spark, text.segment_name(F.lit(0), F.lit(1234567))) == "src0_1234567"
    assert one(spark, text.stem(F.lit("src0_000001.wav"))) == "src0_000001"
    assert [one(spark, text.source_of_file(F.lit(n))) for n in ("src0_1.wav", "src1_1.wav", "x")] == [0, 1, 0]


def test_preview(spark):
    assert one(spark, text.preview(F.lit("é" * 80))) == "é" * 80
    assert one(spark, text.preview(F.lit("é" * 81))) == "é" * 77 + "..."


def test_truthy(spark):
    for v, want in [(None, None), ("", False), ("YES", True), ("on", True), (" 1", False), ("2", False)]:
        assert one(spark, text.truthy(F.lit(v).cast("string"))) is want


def test_transliteration(spark):
    assert [one(spark, text.physical_key(F.lit(c))) for c in "йКкz ЁÀ"] == ["q", "r", "r", "z", " ", "Ё", "À"]


def test_unquoted(spark):
    for v, want in [('  "models/foo"  ', "models/foo"), ("'bar/baz'", "bar/baz"), ('"x', '"x'), ("\"x'", "\"x'"), ('"', '"'), ("", ""), ("' a '", "a")]:
        assert one(spark, text.unquoted(F.lit(v))) == want


def test_row_height(spark):
    h = lambda w: one(spark, text.row_height(F.lit("12:34:56"), F.lit(0), F.lit("abc"), w))
    assert [h(100), h(16), h(15), h(0)] == [1, 1, 2, 1]


def test_times(spark):
    parsed = lambda t: one(spark, text.rfc3339(F.lit(t)))
    assert parsed("2026-01-01T00:00:00Z") == parsed(" 2026-01-01t03:00:00+03:00 ")
    assert all(parsed(t) is None for t in ("2026-01-01", "2026", "soon", "2026-01-01T00:00:00", "2026-13-01T00:00:00Z"))
    assert one(spark, text.rfc3339_nanos(F.lit("2026-01-01T00:00:00.123456789Z"))) == 789


def test_labels(spark):
    label = lambda *v: one(spark, text.device_label(*[F.lit(x).cast("string") for x in v]))
    assert label("mic", "maker", "7", "x") == "mic | maker | id:7 | x"
    assert label("mic", "mic", "", None) == "mic"
    assert one(spark, text.trimmed(F.lit("  a b \n"))) == "a b"
    assert one(spark, text.first_alternative(F.array(F.struct(F.lit("a").alias("text"))))) == "a"


def test_wrapped_rows(spark):
    rows = lambda x, w: one(spark, text.wrapped_rows(array(x, "string"), w))
    assert rows([], 80) == 1 and rows(["abcdefghij"], 4) == 3 and rows(["a", "", "abcde"], 4) == 4 and rows(["a", "b"], 0) == 2


def test_dump_name(spark):
    now = F.lit("2026-03-01 12:00:05").cast("timestamp")
    assert one(spark, text.dump_name(now, F.lit(False), F.lit("x"))) == "transcript_dump_2026-03-01_120005.jsonl"
    assert one(spark, text.dump_name(now, F.lit(True), F.lit("x"))) == "transcript_dump_2026-03-01_120005_x.jsonl"
