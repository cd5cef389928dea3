"""Scalar functions as Column expressions (F8 to F22). None of them uses Python at run time."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def warmup_cosine(step: Column, *, warmup: int, total: int, start: float, peak: float, final: float) -> Column:
    """Linear from start to peak over the warm-up, then half a cosine down to final."""
    up = start + (peak - start) * step / max(1, warmup)
    done = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, up).otherwise(F.greatest(F.lit(final), final + (peak - final) * 0.5 * (1 + F.cos(math.pi * done))))


def cosine_decay(step: Column, *, total: int, start: float, final: float) -> Column:
    """Half a cosine from start to final, never past it."""
    value = final + (start - final) * 0.5 * (1 + F.cos(math.pi * step / total))
    return (F.greatest if final <= start else F.least)(F.lit(final), value)


def linear_momentum(step: Column, *, total: int, start: float, final: float = 1.0) -> Column:
    return start + step * (final - start) / total


def ramp(value: Column, begin: float, end: float) -> Column:
    """0 at begin, 1 at end, held outside."""
    return _clamp01((value - begin) / (end - begin))


def blur_sigma(nimg: Column, *, start: float, fade_kimg: float) -> Column:
    """Fades to 0 over fade_kimg thousand images."""
    return F.greatest(1 - nimg / (fade_kimg * 1000), F.lit(0.0)) * start if fade_kimg > 0 else F.lit(0.0)


def beta(kind: str, t: Column, steps: int, low: float = 1e-4, high: float = 0.02) -> Column:
    """Noise variance of step t (from 0) of a schedule of so many steps."""
    x = t / (steps - 1)
    if kind == "linear":
        return low + (high - low) * x
    if kind == "quad":
        r = math.sqrt(low) + (math.sqrt(high) - math.sqrt(low)) * x
        return r * r
    if kind == "const":
        return F.lit(high) + 0 * x
    if kind == "jsd":
        return 1.0 / (steps - t)
    if kind == "sigmoid":
        return low + (high - low) / (1 + F.exp(-(-6 + 12 * x)))
    if kind == "cosine":

        def bar(u: Column) -> Column:
            c = F.cos((u / steps + 0.008) / 1.008 * (math.pi / 2))
            return c * c

        return F.least(1 - bar(t + 1) / bar(t), F.lit(0.999))
    if kind == "continuous":
        return 1 - F.exp(-low / steps - 0.5 * (high - low) * (2 * (t + 1) - 1) / (steps * steps))
    raise ValueError(f"no schedule named {kind}")


def noised(x: Column, noise: Column, kept: Column) -> Column:
    """sqrt(a) x + sqrt(1 - a) e for arrays x, e and the kept share a."""
    return F.zip_with(x, noise, lambda v, e: F.sqrt(kept) * v + F.sqrt(1 - kept) * e)


def center_crop(width: Column, height: Column) -> Column:
    """Box (left, top, side) of the largest centred square."""
    side = F.least(width, height)
    return F.struct(F.floor((width - side) / 2).cast("int").alias("left"), F.floor((height - side) / 2).cast("int").alias("top"), side.cast("int").alias("side"))


def wide_crop(width: Column, height: Column, out_width: int, out_height: int) -> Column:
    """Height of the centred crop of the output's shape, or null if the image is too small to give it."""
    rows = F.round(out_height * width / out_width).cast("int")
    return F.when((width < out_width) | (rows < out_height) | (rows > height), F.lit(None).cast("int")).otherwise(rows)


def crop_size(area: Column, scale: Column, ratio: Column) -> Column:
    """(width, height) of a crop of a share of an area and an aspect ratio."""
    target = area * scale
    return F.struct(F.round(F.sqrt(target * ratio)).cast("int").alias("w"), F.round(F.sqrt(target / ratio)).cast("int").alias("h"))


def block_size(grid_h: int, grid_w: int, scale: Column, aspect: Column) -> Column:
    """(h, w) of a mask block inside a grid: a share of its cells at an aspect ratio, always smaller than the grid."""
    cells = F.floor(grid_h * grid_w * scale)
    return F.struct(F.least(F.round(F.sqrt(cells * aspect)), F.lit(grid_h - 1)).cast("int").alias("h"), F.least(F.round(F.sqrt(cells / aspect)), F.lit(grid_w - 1)).cast("int").alias("w"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)


def parse_size(text: Column) -> Column:
    """[M, N] of `MxN` or `M,N`, or null."""
    hit = F.regexp_extract(text, r"^(\d+)[x,](\d+)$", 1)
    return F.when(hit != "", F.array(hit.cast("int"), F.regexp_extract(text, r"^(\d+)[x,](\d+)$", 2).cast("int")))


def parse_list(text: Column) -> Column:
    """Items of a comma list; empty for null, `none` and an empty text."""
    return F.when(text.isNull() | F.lower(text).isin("none", ""), F.array().cast("array<string>")).otherwise(F.split(text, ","))


def zero_padded(n: Column, width: int) -> Column:
    """Decimal digits with zeros in front; a longer number keeps all of its digits."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def run_dir(run: Column, description: Column) -> Column:
    return F.concat(zero_padded(run, 5), F.lit("-"), description)


def duration(seconds: Column) -> Column:
    """`12s`, `3m 04s`, `5h 06m 07s` or `8d 09h 10m`."""
    s = F.round(seconds).cast("long")

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    def whole(n: int) -> Column:
        return F.floor(s / n)

    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(whole(60).cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .when(s < 86400, F.concat(whole(3600).cast("string"), F.lit("h "), two(whole(60) % 60), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(whole(86400).cast("string"), F.lit("d "), two(whole(3600) % 24), F.lit("h "), two(whole(60) % 60), F.lit("m")))
    )


def args_key(args: dict) -> str:
    """MD5 of arguments in canonical form: JSON with sorted keys and no blanks."""
    return hashlib.md5(json.dumps(args, sort_keys=True, default=str, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def args_key_of(*names: str) -> Column:
    """The same key of each row's columns as arguments."""
    return F.md5(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}))


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded half away from zero. What is rounded to zero keeps its sign, as in NumPy and SQL engines; Spark's own round drops it."""
    return F.signum(x) * F.round(F.abs(x), digits)


def decibels(x: Column) -> Column:
    """10 log10(x); of zero, minus infinity; of less, NaN."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(10 * F.log10(x))


def clip_uint8(x: Column) -> Column:
    """Rounded half up and held in 0 to 255; null and NaN are held as what is too large."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x + 0.5))).cast("int")


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def public_keys(m: Column) -> Column:
    """A map less the keys that start with `_`."""
    return F.map_filter(m, lambda k, _: ~F.startswith(k, F.lit("_")))


def prefixed(m: Column, prefix: str) -> Column:
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k))


def step_features(t: Column, dim: int, period: float = 10000.0) -> Column:
    """Cosines, then sines, of t at dim / 2 falling frequencies."""
    half = dim // 2
    angles = [t * math.exp(-math.log(period) * i / half) for i in range(half)]
    return F.array(*[F.cos(a) for a in angles], *[F.sin(a) for a in angles])


def grid_features(y: Column, x: Column, dim: int) -> Column:
    """Sines and cosines of y, then of x, a quarter of dim each."""
    quarter = dim // 4
    rates = [1 / 10000 ** (i / quarter) for i in range(quarter)]
    return F.concat(*[F.array(*[f(p * r) for r in rates]) for p in (y, x) for f in (F.sin, F.cos)])


def pack(bits: Column) -> Column:
    """Up to 63 flags as a long, the first one lowest."""
    return F.aggregate(F.zip_with(bits, F.sequence(F.lit(0), F.size(bits) - 1), lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, v: a + v)


def unpack(packed: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(packed, i) == 1)
