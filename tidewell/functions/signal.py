"""Column functions on sample arrays: framing, levels, mixing, quantisation, softmax."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import params as P


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; inside a lambda a bare expression would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0 .. n-1 as an array, empty for n <= 0 (sequence() alone would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))


def pcm16_to_float(x: Column) -> Column:
    return F.transform(x, lambda v: (v / 32768.0).cast("double"))


def to_pcm16(x: Column) -> Column:
    """Rounds half to even, clipped to 16 bits."""
    return F.transform(x, lambda v: F.greatest(F.least(F.rint(v * 32768.0), F.lit(32767.0)), F.lit(-32768.0)).cast("short"))


def fit_to_clip(x: Column, n: int = P.CLIP_SAMPLES, offset: Column | int = 0) -> Column:
    """Centre crop or zero pad to n samples; offset moves the crop within the slack; an odd pad puts the extra sample right."""
    off = F.lit(offset) if isinstance(offset, int) else offset

    def fitted(y: Column) -> Column:
        size = F.size(y)
        start = F.greatest(F.lit(0), F.least(F.floor((size - n) / 2) + off, size - n)).cast("int")
        left = F.floor((n - size) / 2).cast("int")
        return F.when(size >= n, F.slice(y, start + 1, F.lit(n))).otherwise(F.concat(zeros(left), y, zeros(F.lit(n) - size - left)))

    return let(x, fitted)


def time_shift(x: Column, offset: Column, most: int, n: int = P.CLIP_SAMPLES) -> Column:
    return fit_to_clip(F.concat(zeros(F.lit(most)), x, zeros(F.lit(most))), n, offset)


def take_stream(x: Column, pad: int = P.SAMPLE_RATE) -> Column:
    """The samples with `pad` zeros on either side."""
    return F.concat(zeros(F.lit(pad)), x, zeros(F.lit(pad)))


def n_windows(size: Column, window: int = P.CLIP_SAMPLES, hop: int = P.HOP_SAMPLES) -> Column:
    return F.when(size >= window, F.floor((size - window) / hop) + 1).otherwise(0).cast("int")


def windows(x: Column, window: int = P.CLIP_SAMPLES, hop: int = P.HOP_SAMPLES) -> Column:
    """Full windows of an array, every `hop` samples."""
    return let(x, lambda y: F.transform(upto(n_windows(F.size(y), window, hop)), lambda i: F.slice(y, i * hop + 1, F.lit(window))))


def frames(x: Column) -> Column:
    return windows(x, P.FRAME_LEN, P.STRIDE_LEN)


def pre_emphasis(x: Column, a: float = P.PREEMPHASIS) -> Column:
    return F.zip_with(x, F.concat(F.array(F.lit(0.0)), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))), lambda v, w: v - a * w)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean_square(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(F.transform(x, lambda v: v * v)) / F.size(x)).otherwise(0.0)


def rms(x: Column) -> Column:
    return F.sqrt(mean_square(x))


def dbfs(x: Column, floor: float = 1e-12) -> Column:
    """Level in dB, the floor added after the square root."""
    return 20 * F.log10(rms(x) + floor)


def dbfs_inside(x: Column, floor: float = 1e-12) -> Column:
    """Level in dB, the floor added to the mean square."""
    return 20 * F.log10(F.sqrt(mean_square(x) + floor))


def dbfs_at_least(x: Column, floor: float = 1e-10) -> Column:
    """Level in dB of at least the floor."""
    return 20 * F.log10(F.greatest(rms(x), F.lit(floor)))


def decibels(level: Column) -> Column:
    """20 log10 as arithmetic has it: -inf for 0 and NaN below, where Spark's log10 gives null and a stream loses the hop."""
    return F.when(level > 0, 20 * F.log10(level)).when(level == 0, F.lit(float("-inf"))).when(level < 0, F.lit(float("nan")))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def peak_dbfs(x: Column, floor: float = 1e-12) -> Column:
    return 20 * F.log10(peak(x) + floor)


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def gain(x: Column, db: Column) -> Column:
    return let(amplitude(db), lambda a: F.transform(x, lambda v: v * a))


def clip(x: Column, most: float = 1.0) -> Column:
    return F.transform(x, lambda v: F.greatest(F.least(v, F.lit(most)), F.lit(-most)))


def to_level(x: Column, target_db: Column) -> Column:
    return let(rms(x), lambda r: F.when(r == 0, x).otherwise(clip(F.transform(x, lambda v: v * amplitude(target_db) / r))))


def mix(x: Column, background: Column, snr_db: Column, most: float | None = None) -> Column:
    """x plus the background at a signal-to-noise ratio; most caps the background's peak. A silent background adds nothing."""
    both = F.struct(x.alias("x"), background.alias("b"))

    def mixed(p: Column) -> Column:
        a, b = p["x"], p["b"]
        scale = rms(a) / amplitude(snr_db) / rms(b)
        if most is not None:
            scale = F.when(peak(b) > 0, F.least(scale, F.lit(most) / peak(b))).otherwise(scale)
        return F.when(rms(b) > 0, let(scale, lambda s: F.zip_with(a, b, lambda v, w: v + s * w))).otherwise(a)

    return let(both, mixed)


def quantise(x: Column, scale: float, zero: int) -> Column:
    return F.transform(x, lambda v: F.greatest(F.least(F.rint(v / scale + zero), F.lit(127.0)), F.lit(-128.0)).cast("byte"))


def dequantise(q: Column, scale: float, zero: int) -> Column:
    return F.transform(q, lambda v: (v.cast("double") - zero) * scale)


def softmax(x: Column) -> Column:
    e = let(x, lambda y: let(F.array_max(y), lambda m: F.transform(y, lambda v: F.exp(v - m))))
    return let(e, lambda y: let(total(y), lambda t: F.transform(y, lambda v: v / t)))


def one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == label, 1).otherwise(0))


def class_weight(label: Column, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), (label + 1).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def added_latency_ms(window: Column) -> Column:
    return (window - 1) / 2 * P.HOP_MS


def step_decay(epoch: Column, first: float, factor: float, every: int) -> Column:
    return F.lit(first) * F.pow(F.lit(factor), F.floor(epoch / every))


def printed(x: Column, form: str) -> Column:
    """An array's numbers as C prints them, rounded from their exact values, ties to even; Java's formatter rounds their
    shortest decimals half up. Null elements stay null."""

    def each(x: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [None if v is None else form % v for v in row] for row in x.to_pylist()], pa.list_(pa.string()))

    each.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<string>")(x.cast("array<double>"))


def meter(level: Column) -> Column:
    """Display meter: 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), level * 420))
