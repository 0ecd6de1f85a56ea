"""Signal functions as Column expressions over arrays of samples; none runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
CHUNK = 512  # samples
FRAME = 320  # samples, 20 ms
EMPTY_DOUBLES = "array<double>"


def _indexes(n: Column) -> Column:
    """[0, n), and an empty array for n = 0 (sequence(0, -1) counts down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def mono(samples: Column, channels: int) -> Column:
    """Mean over the channels of each whole frame; a partial frame at the end is dropped."""
    if channels == 1:
        return samples.cast(EMPTY_DOUBLES)
    whole = F.floor(F.size(samples) / channels).cast("int")
    return F.transform(_indexes(whole), lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x.cast("double")) / channels)


def resample(samples: Column, rate: int, to: int = SAMPLE_RATE) -> Column:
    """Linear interpolation without a filter; both neighbours are clamped to the last sample."""
    values = samples.cast(EMPTY_DOUBLES)
    if rate == to:
        return values
    ratio = rate / to
    last = F.size(values) - 1

    def at(i: Column) -> Column:
        place = i.cast("double") * F.lit(ratio)
        low = F.floor(place).cast("int")
        a = F.element_at(values, F.least(low, last) + 1)
        b = F.element_at(values, F.least(low + 1, last) + 1)
        return a + (b - a) * (place - low)

    return F.transform(_indexes(F.ceil(F.size(values) / F.lit(ratio)).cast("int")), at)


def to_i16(value: Column) -> Column:
    """-1..1 to 16 bits: clamped, then cut toward zero; NaN is 0."""
    scaled = F.nanvl(value.cast("double"), F.lit(0.0)) * 32767.0
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), scaled)).cast("smallint")


def from_i16(value: Column) -> Column:
    return value.cast("float") / F.lit(32768.0).cast("float")


def level(samples: Column) -> Column:
    """Root mean square of 16-bit samples, times 12, at most 1; 0 for none."""
    n = F.size(samples)
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(n > 0, F.least(F.lit(1.0), F.sqrt(power / n) / 32768.0 * 12.0)).otherwise(0.0)


def level_meter(value: Column) -> Column:
    """Eight characters: # for each full eighth, the rest hyphens."""
    n = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(8.0), F.nanvl(value.cast("double"), F.lit(0.0)) * 8.0))).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(8) - n))


def duration_sec(samples: Column) -> Column:
    return F.size(samples) / float(SAMPLE_RATE)


def silence_frames(seconds: float) -> int:
    """Frames of silence after which a segment may end."""
    return -int(-(SAMPLE_RATE * seconds) // FRAME)


def silence_frames_of(seconds: Column) -> Column:
    """As `silence_frames`, of a column."""
    return F.ceil(seconds * SAMPLE_RATE / FRAME).cast("int")


def pad_frames(milliseconds: int) -> int:
    return (milliseconds + 19) // 20


def mebibytes(n: Column) -> Column:
    return n / float(1 << 20)


def backoff_ms(streak: Column) -> Column:
    """Delay before another try, from the number of failures in a row."""
    return F.greatest(F.lit(500), F.least(F.lit(12_000), streak * 600))


def frame_flags(samples: Column, is_speech) -> Column:
    """is_speech(frame) for each whole frame of 320 samples."""
    whole = F.floor(F.size(samples) / FRAME).cast("int")
    return F.transform(_indexes(whole), lambda i: is_speech(F.slice(samples, i * FRAME + 1, FRAME)))


def speech_ratio(flags: Column) -> Column:
    """Speech frames over all frames; 1 where there is no whole frame."""
    n = F.size(flags)
    return F.when(n > 0, F.size(F.filter(flags, lambda f: f)) / n).otherwise(1.0)


def dilated(flags: Column, pad: int) -> Column:
    """Frames within `pad` frames of a speech frame."""
    return F.transform(flags, lambda f, i: F.exists(F.slice(flags, F.greatest(i - pad, F.lit(0)) + 1, F.least(i, F.lit(pad)) + pad + 1), lambda x: x))


def trim_to_speech(samples: Column, flags: Column, pad_ms: int) -> Column:
    """Samples of the frames kept by dilation; unchanged below one frame, null without speech; a partial last frame goes."""
    kept = F.filter(F.transform(dilated(flags, pad_frames(pad_ms)), lambda k, i: F.when(k, F.slice(samples, i * FRAME + 1, FRAME))), lambda x: x.isNotNull())
    return F.when(F.size(samples) < FRAME, samples).when(F.exists(flags, lambda f: f), F.flatten(kept))
