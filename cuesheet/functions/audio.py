"""Sample arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def db(x: Column) -> Column:
    return 20.0 * F.log10(F.greatest(x, F.lit(EPS)))


def power_db(z: Column) -> Column:
    """Loudness of a mean square, on the LUFS scale."""
    return -0.691 + 10.0 * F.log10(F.greatest(z, F.lit(EPS)))


def frame_len(sr: Column, frame_ms: float = 20.0) -> Column:
    return F.greatest(F.lit(1), F.floor(sr * frame_ms / 1000.0)).cast("int")


def sum_squares(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a.cast("double") + b.cast("double")) / 2.0)


def int16_to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x / 32768.0).cast("float"))


def int32_to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x / 2147483648.0).cast("float"))


def to_int16(samples: Column) -> Column:
    """Clip to ±1, scale, cut the fraction."""
    one = F.lit(1.0).cast("float")
    return F.transform(
        samples, lambda x: (F.least(F.greatest(x.cast("float"), -one), one) * F.lit(32767.0).cast("float")).cast("smallint")
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the dot product of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return 1.0 - F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(sum_squares(v))
    return F.transform(v, lambda x: x.cast("double") / (norm + 1e-9))
