"""Text, time, coordinate and similarity values as column expressions; kernels over arrays as vectorised UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .paths import BIDI, _c

DIGITS = 4


def folded(s: Column | str) -> Column:
    """For comparisons: case and accents do not count."""
    return F.collate(_c(s), "UNICODE_CI_AI")


def natural_key(name: Column | str) -> Column:
    """Sorts runs of digits by value and the rest by lower-case characters."""
    runs = F.regexp_extract_all(F.lower(_c(name)), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda x: F.ltrim(x, F.lit("0"))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), DIGITS, "0"), bare(x))).otherwise(x)), "")


def year_of(ms: Column | str) -> Column:
    return F.year(F.timestamp_millis(_c(ms)))


def format_unix(seconds: Column | str) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def human_size(n: Column | str) -> Column:
    """1024 steps; one decimal below 10."""
    b = _c(n)
    out = F.concat(b.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = b / F.lit(float(1024**k))
        out = F.when(b >= 1024**k, F.concat(F.when(v < 10, F.format_number(v, 1)).otherwise(F.format_string("%d", F.round(v).cast("long"))), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_duration(ms: Column | str) -> Column:
    """``m:ss``, from an hour on ``h:mm:ss``."""
    t = F.floor(_c(ms) / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(t / 60)
    return F.concat(F.when(t >= 3600, F.concat(F.floor(t / 3600).cast("string"), F.lit(":"), two(minutes % 60))).otherwise(minutes.cast("string")), F.lit(":"), two(t % 60))


def clean(s: Column | str, most: int = 400) -> Column:
    """Controls become spaces, ends are trimmed, long values end in an ellipsis."""
    t = F.trim(F.regexp_replace(_c(s), r"\p{Cc}", " "))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def clean_tag(s: Column | str) -> Column:
    """A tag's name without controls, 1 to 60 characters; null if none are left or too many."""
    t = F.trim(F.regexp_replace(_c(s), rf"[\p{{Cc}}{BIDI}]", ""))
    return F.when(F.length(t).between(1, 60), t)


def clean_codec(s: Column | str) -> Column:
    return F.left(F.regexp_replace(_c(s), r"[^A-Za-z0-9._\- ]", ""), F.lit(32))


def exif_millis(s: Column | str) -> Column:
    """``YYYY?MM?DD?HH?MM?SS`` as milliseconds of a naive time; null if out of range."""
    parts = [F.try_to_number(F.regexp_extract(_c(s), r"^(\d{4})\D(\d{2})\D(\d{2})\D(\d{2})\D(\d{2})\D(\d{2})", i), F.lit("9999")).cast("int") for i in range(1, 7)]
    y, mo, d, h, mi, sec = parts
    ok = mo.between(1, 12) & d.between(1, 31) & (h < 24) & (mi < 60) & (sec <= 60)
    day = F.unix_date(F.try_make_timestamp(y, mo, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")).cast("long")
    return F.when(ok, day * 86_400_000 + (h * 3600 + mi * 60 + sec).cast("long") * 1000)


def valid_position(lat: Column | str, lon: Column | str) -> Column:
    a, b = _c(lat), _c(lon)
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & a.between(-90, 90) & b.between(-180, 180) & ~((a == 0) & (b == 0)), F.lit(False))


def iso6709(s: Column | str) -> Column:
    """``+48.85+002.35/`` as struct<lat, lon>; null if malformed or no valid position."""
    part = lambda i: F.expr("try_cast(x as double)") if i is None else F.regexp_extract(_c(s), r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)", i)
    lat, lon = (F.nullif(part(i), F.lit("")).cast("double") for i in (1, 2))
    return F.when(valid_position(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def xmp_coordinate(s: Column | str) -> Column:
    """``48,51.5N`` or ``48,51,30N`` in degrees, negative to the south and west."""
    g = [F.nullif(F.regexp_extract(_c(s), r"^(\d+),(\d+(?:\.\d+)?)(?:,(\d+(?:\.\d+)?))?([NSEW])$", i), F.lit("")) for i in range(1, 5)]
    value = g[0].cast("double") + g[1].cast("double") / 60 + F.coalesce(g[2].cast("double"), F.lit(0.0)) / 3600
    return F.when(g[3].isin("S", "W"), -value).otherwise(value)


def sample_times(duration: Column | str, n: int) -> Column:
    """The middles of n equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k + 0.5) / n * _c(duration))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def identity_key(content: Column | str) -> Column:
    """What equal contents have in common."""
    return F.sha2(_c(content).cast("binary"), 256)


def pair_key(a: Column | str, b: Column | str) -> Column:
    """One key for both orders of a pair."""
    return F.sha2(F.concat_ws("|", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))), 256)


def similarity(mad: Column | str) -> Column:
    """A percentage from the mean absolute difference of normalised planes; 99 at most."""
    return F.least(F.lit(99), F.round(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _c(mad) / 1.13))).cast("int"))


def aspect_close(wa: Column, ha: Column, wb: Column, hb: Column, tolerance: float) -> Column:
    return F.abs(F.ln(wa / ha) - F.ln(wb / hb)) <= tolerance


_FNV_BASE, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


@F.pandas_udf(StringType())
def fnv1a(s: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, over UTF-8, as 16 hex digits; all values advance together, byte by byte."""
    raw = [x.encode() if x is not None else b"" for x in s]
    size = np.array([len(x) for x in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, first = np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(size) - size)[order]
    h = np.full(len(raw), _FNV_BASE)
    sizes = size[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, side="left"))
        h[:m] = (h[:m] ^ flat[first[:m] + k]) * _FNV_PRIME
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return pd.Series([None if x is None else f"{v:016x}" for x, v in zip(s, out, strict=True)])


def scoped_id(prefix: str, root: Column | str, rel: Column | str) -> Column:
    """An id that tells by its first letter which results it belongs to, and by the rest which file of which root."""
    return F.concat(F.lit(prefix), fnv1a(F.concat(_c(root), F.lit("\0"), _c(rel))))


def has_exif(content: Column | str) -> Column:
    """Whether the first 256 KiB hold ``Exif`` and two zero bytes, or ``Exif`` after four bytes or more."""
    head = F.substring(_c(content), 1, 262_144)
    return F.coalesce(F.contains(head, F.lit(b"Exif\0\0")) | F.contains(F.substring(head, 5, 262_144), F.lit(b"Exif")), F.lit(False))


@F.pandas_udf(StructType().add("mean", DoubleType()).add("changed", DoubleType()))
def pixel_difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Of two arrays of red, green and blue bytes: the mean difference of pixels, and the share that differ by more than 24."""
    rows = []
    for x, y in zip(a, b, strict=True):
        d = np.abs(np.asarray(x, np.float64) - np.asarray(y, np.float64)).reshape(-1, 3).mean(1)
        rows.append((d.mean(), (d > 24).mean()) if len(d) else (0.0, 0.0))
    return pd.DataFrame(rows, columns=["mean", "changed"])


def _triangle(n: int, side: int = 64) -> np.ndarray:
    """[side, n] weights that scale n samples to ``side`` with a triangle as wide as the step."""
    step = max(n / side, 1.0)
    centre = (np.arange(side) + 0.5) * n / side
    w = np.maximum(0, 1 - np.abs((np.arange(n)[None] + 0.5 - centre[:, None]) / step))
    return w / w.sum(1, keepdims=True)


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def grey_planes(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Two 64 x 64 grey planes of a decoded image (rows of blue, green, red and perhaps alpha, as Spark's image reader gives them): the
    whole, and the central 90 %. Transparent parts lie over white; null for what is no image."""
    out = []
    for w, h, n, raw in zip(width, height, channels, data, strict=True):
        if raw is None or not w or not h or w <= 0 or h <= 0:
            out.append(None)
            continue
        p = np.frombuffer(raw, np.uint8).reshape(h, w, n).astype(np.float64)
        grey = p[..., 0] if n == 1 else p[..., 2] * 0.299 + p[..., 1] * 0.587 + p[..., 0] * 0.114
        if n == 4:
            grey = grey * p[..., 3] / 255 + 255 - p[..., 3]
        y, x = h // 20, w // 20
        out.append([np.rint(_triangle(g.shape[0]) @ g @ _triangle(g.shape[1]).T).ravel().tolist() for g in (grey, grey[y : h - y, x : w - x])])
    return pd.Series(out)


def _planes(s: pd.Series, side: int = 64) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64).reshape(side, side) for x in s]) if len(s) else np.zeros((0, side, side))


_K = np.arange(8)
_DCT = np.cos(np.pi * (2 * np.arange(32)[None] + 1) * _K[:, None] / 64)


@F.pandas_udf(LongType())
def phash(planes: pd.Series) -> pd.Series:
    """A 64-bit perceptual hash of 64 x 64 grey planes: signs of low cosine coefficients against their median."""
    p = _planes(planes).reshape(-1, 32, 2, 32, 2).mean((2, 4))
    c = (_DCT @ p @ _DCT.T).reshape(-1, 64)
    middle = np.sort(c[:, 1:], 1)[:, 31:32]
    bits = (c > middle) & (np.arange(64) > 0)
    return pd.Series((bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64))


@F.pandas_udf(ArrayType(DoubleType()))
def normalized(planes: pd.Series) -> pd.Series:
    """Planes with mean 0 and deviation 1; null where the deviation is below 6, which tells nothing."""
    p = _planes(planes).reshape(len(planes), -1)
    sd = p.std(1)
    return pd.Series([((x - x.mean()) / s).tolist() if s >= 6 else None for x, s in zip(p, sd, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def blurred(planes: pd.Series) -> pd.Series:
    """A 3 x 3 mean; at edges of what there is."""
    p = np.pad(_planes(planes), ((0, 0), (1, 1), (1, 1)), constant_values=np.nan)
    stack = np.stack([p[:, i : i + 64, j : j + 64] for i in range(3) for j in range(3)])
    return pd.Series(np.nanmean(stack, 0).reshape(len(planes), -1).tolist())


def prepare(p: np.ndarray) -> np.ndarray:
    """Planes [n, 64, 64] normalised, then blurred; NaN where the deviation is below 6."""
    sd = p.std((1, 2), keepdims=True)
    z = (p - p.mean((1, 2), keepdims=True)) / np.where(sd >= 6, sd, np.nan)
    wide = np.pad(z, ((0, 0), (1, 1), (1, 1)))
    ones = np.pad(np.ones((1, 64, 64)), ((0, 0), (1, 1), (1, 1)))
    around = lambda x: sum(x[:, i : i + 64, j : j + 64] for i in range(3) for j in range(3))
    return around(wide) / around(ones)


def differences(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For planes [n, 64, 64] the mean absolute difference, and the largest mean of an 8 x 8 block."""
    d = np.abs(a - b)
    return d.mean((1, 2)), d.reshape(-1, 8, 8, 8, 8).mean((2, 4)).max((1, 2))


@F.pandas_udf(StructType().add("mad", DoubleType()).add("block", DoubleType()))
def plane_difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The mean absolute difference, and the largest mean of an 8 x 8 block."""
    return pd.DataFrame(dict(zip(("mad", "block"), differences(_planes(a), _planes(b)), strict=True)))


@F.pandas_udf(StructType().add("mad", DoubleType()).add("block", DoubleType()))
def prepared_difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """``plane_difference`` of two raw planes, normalised and blurred; null if one is null or tells nothing."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full((2, len(a)), np.nan)
    if known.any():
        out[:, known] = differences(prepare(_planes(a[known])), prepare(_planes(b[known])))
    return pd.DataFrame({"mad": out[0], "block": out[1]}).astype(object).where(lambda x: x.notna(), None)
