"""Text, key and time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U8, U32 = 255, 4_294_967_295
LAST = (U8, U32)  # the key of what cannot be read sorts last

#: The letters of the two keyboard layouts by place, upper row first.
LATIN_KEYS = "qwertyuiopasdfghjklzxcvbnm"
CYRILLIC_KEYS = "йцукенгшщзфывапролдячсмить"

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _number(text: Column, most: int) -> Column:
    """A decimal number (with an optional plus sign) from 0 to most; else null. The pattern runs once a text."""
    n = F.regexp_extract(text, r"^\+?([0-9]{1,20})\z", 1).try_cast("decimal(20,0)")
    return F.get(F.filter(F.array(n), lambda x: x <= most), F.lit(0)).cast("long")


def _parts(seg_id: Column) -> tuple[Column, Column, Column]:
    """Whether there are two parts after the prefix, and both: up to the first underscore, and after it."""
    rest = F.substring(seg_id, 4, 1 << 30)
    return seg_id.startswith("src") & rest.contains("_"), F.substring_index(rest, "_", 1), F.substr(rest, F.instr(rest, "_") + 1)


def seg_key_lenient(seg_id: Column) -> Column:
    """struct(source, seq); each part that cannot be read is the last one of its range."""
    ok, source, seq = _parts(seg_id)
    source, seq = F.when(ok, _number(source, U8)), F.when(ok, _number(seq, U32))
    return F.struct(F.coalesce(source, F.lit(U8).cast("long")).alias("source"), F.coalesce(seq, F.lit(U32)).alias("seq"))


def seg_key_strict(seg_id: Column) -> Column:
    """struct(source, seq), or null where any part cannot be read."""
    ok, source, seq = _parts(seg_id)
    both = F.when(ok, F.struct(_number(source, U8).alias("source"), _number(seq, U32).alias("seq")))
    return F.get(F.filter(F.array(both), lambda k: k["source"].isNotNull() & k["seq"].isNotNull()), F.lit(0))


def source_of_file(name: Column) -> Column:
    """0 or 1 by the prefix; 0 for anything else."""
    return F.when(name.startswith("src1_"), 1).otherwise(0)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.wav$", "")


def segment_name(source: Column, seq: Column, suffix: str = "") -> Column:
    """src{n}_{seq}, the number padded to six digits at least."""
    return F.format_string("src%d_%06d" + suffix, source, seq)


def rfc3339(text: Column) -> Column:
    """Timestamp (microseconds) of an RFC 3339 text; null for any other. A leap second is the last microsecond before it."""
    t = trimmed(text)
    plain = F.regexp_replace(F.upper(t), r"(?<=^.{17})60(\.\d+)?", "59.999999")
    return F.when(t.rlike(RFC3339), plain.try_cast("timestamp"))


def rfc3339_nanos(text: Column) -> Column:
    """Digits 7 to 9 of the fraction as a number, which timestamps do not hold; 0 where there are none. In a leap second
    1,000 and the nanoseconds of its fraction, so that it comes after the second before it and before the next."""
    t = trimmed(text)
    digits = F.rpad(F.regexp_extract(t, r"\.(\d+)", 1), 9, "0")
    leap = F.lit(1000) + F.coalesce(F.substring(digits, 1, 9).try_cast("int"), F.lit(0))
    return F.when(rfc3339(text).isNotNull(), F.when(t.rlike(r"^.{17}60"), leap).otherwise(F.substring(digits, 7, 3).cast("int"))).otherwise(0)


def to_rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def local_time(text: Column, otherwise: Column) -> Column:
    """HH:mm:ss in the session's zone; `otherwise` (a timestamp) for texts that are no timestamps."""
    return F.date_format(F.coalesce(rfc3339(text), otherwise), "HH:mm:ss")


def preview(text: Column) -> Column:
    """The text, or its first 77 characters and three dots if it has more than 80."""
    return F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))).otherwise(text)


def source_label(source: Column) -> Column:
    return F.when(source == 0, "mic ").when(source == 1, "sys ").otherwise("")


def log_line(time: Column, stage: Column, source: Column, chunk_sec: Column, proc_sec: Column, detail: Column) -> Column:
    return F.format_string("%s %-8s %-4s chunk=%5.2fs proc=%5.3fs %s", time, stage, F.concat(F.lit("src"), source.cast("string")), chunk_sec, proc_sec, detail)


def percent(ratio: Column) -> Column:
    return F.format_string("%.0f%%", ratio * 100)


def gate_detail(action: Column, ratio: Column, kept_sec: Column) -> Column:
    """What the gate did: passed, or trimmed to so many seconds, at which share of speech; null for drops."""
    share = F.concat(F.lit("speech "), percent(ratio))
    return F.when(action == "pass", F.concat(F.lit("pass "), share)).when(action == "trim", F.concat(F.format_string("trim → %.1fs ", kept_sec), share))


def asr_detail(text: Column, error: Column, segment_sec: Column) -> Column:
    """The preview of a recognised text with the length of its segment, where that is known, or the error."""
    hint = F.coalesce(F.format_string(" pipeline_seg=%.2fs", segment_sec), F.lit(""))
    return F.when(error.isNotNull(), F.concat(F.lit("ERROR: "), error)).otherwise(F.concat(preview(text), F.when(segment_sec.isNotNull(), hint).otherwise("")))


def row_height(time: Column, source: Column, text: Column, width: int) -> Column:
    """Lines that time, label and text take when wrapped at `width`; at least 1."""
    if width == 0:
        return F.lit(1).cast("long")
    n = F.length(time) + 1 + F.length(source_label(source)) + F.length(text)
    return F.greatest(F.lit(1), F.ceil(n / width)).cast("long")


def physical_key(char: Column) -> Column:
    """The Latin key of a character of either layout; other characters only have A-Z lower-cased."""
    given = CYRILLIC_KEYS + CYRILLIC_KEYS.upper() + LATIN_KEYS.upper()
    return F.translate(char, given, LATIN_KEYS * 3)


def truthy(value: Column) -> Column:
    """null stays null; 1, true, yes and on in any case are true, all else is false."""
    return F.when(value.isNotNull(), F.lower(value).isin("1", "true", "yes", "on"))


def unquoted(path: Column) -> Column:
    """Trimmed, without one pair of equal quotes, and trimmed again."""
    t = trimmed(path)
    bare = F.when((F.length(t) >= 2) & (t.rlike(r'(?s)^".*"$') | t.rlike(r"(?s)^'.*'$")), F.expr("null")).otherwise(t)
    return F.coalesce(bare, trimmed(F.regexp_replace(t, r"""^["']|["']$""", "")))


def device_label(name: Column, maker: Column, device_id: Column, extra: Column) -> Column:
    """name | maker | id:... | extra, without empty parts or a maker that is the name."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(" | ", name, F.when(maker != name, filled(maker)), F.concat(F.lit("id:"), filled(device_id)), filled(extra))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_alternative(alternatives: Column) -> Column:
    """Text of the first of several results; empty if there is none."""
    return F.coalesce(F.get(alternatives, F.lit(0))["text"], F.lit(""))


def merged(*by_rank: Column, default) -> Column:
    """The first that is given and not empty."""
    return F.coalesce(*[F.when(c != "", c) for c in by_rank], F.lit(default))


def merged_flag(in_args: Column, arg: Column, env: Column) -> Column:
    """A flag on the command line, else the environment's, else the argument's default."""
    return F.coalesce(F.when(in_args, arg), truthy(env), arg)


def loopback_on(told_on: Column, told_off: Column, saved: Column) -> Column:
    """Whether to record what is played: told to, or saved so, unless told not to."""
    return (F.coalesce(told_on, F.lit(False)) | F.coalesce(saved, F.lit(False))) & ~F.coalesce(told_off, F.lit(False))


def dump_name(now: Column, taken: Column, suffix: Column) -> Column:
    """Name of an export by its time; `suffix` makes it unique where it is taken."""
    plain = F.concat(F.lit("transcript_dump_"), F.date_format(now, "yyyy-MM-dd_HHmmss"))
    return F.concat(plain, F.when(taken, F.concat(F.lit("_"), suffix)).otherwise(""), F.lit(".jsonl"))


def wrapped_rows(lines: Column, width: int) -> Column:
    """Rows that an array of lines takes when wrapped at `width`, each at least 1; 1 for no lines; unwrapped for width 0."""
    if width == 0:
        total = F.size(lines).cast("long")
    else:
        total = F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.lit(1).cast("long"), F.ceil(F.length(x) / width)))
    return F.greatest(F.lit(1).cast("long"), total)
