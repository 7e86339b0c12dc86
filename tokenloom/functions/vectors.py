"""Vector and codec expressions over ARRAY columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residual range of the 4-bit code and the strength of its companding.
MU, RANGE = 255.0, 0.25


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column | str) -> Column:
    """v over its length; a zero vector is left as it is."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def compand(x: Column) -> Column:
    """Mu-law companding of a residual to [-1, 1]."""
    return F.signum(x) * F.log(1.0 + MU * F.abs(x / RANGE)) / F.log(F.lit(MU + 1))


def expand(y: Column) -> Column:
    return F.signum(y) * (F.pow(F.lit(MU + 1), F.abs(y)) - 1.0) / MU * RANGE


def level_of(x: Column) -> Column:
    """4-bit level of a residual, 0..15; what lies beyond the range saturates."""
    scaled = compand(x) * 7.5 + 7.5
    away = F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5))
    return F.least(F.greatest(away, F.lit(0)), F.lit(15)).cast("int")


def value_of(level: Column) -> Column:
    return expand((level.cast("double") - 7.5) / 7.5)


def encode_levels(v: Column | str) -> Column:
    return F.transform(v, lambda x: level_of(x.cast("double")))


def decode_levels(v: Column | str) -> Column:
    return F.transform(v, value_of)


def relative_bucket(distance: Column, buckets: int = 32, furthest: int = 128) -> Column:
    """Bidirectional relative-position bucket: exact for near positions, logarithmic beyond."""
    half = buckets // 2
    exact = half // 2
    far = F.abs(distance)
    log = exact + F.floor(F.log(far / float(exact)) / F.log(F.lit(furthest / exact)) * (half - exact))
    return (F.when(distance > 0, half).otherwise(0) + F.when(far < exact, far).otherwise(F.least(log, F.lit(half - 1)))).cast("long")


def level_capacity(level: Column | int, base: int = 1024, fanout: int = 16) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return (base * F.pow(F.lit(float(fanout)), level + 1)).cast("long")


def cluster_count(n: int, train: int, coefficient: float = 16.0) -> int:
    """Number of clusters for n rows of which train are a sample."""
    k = max(int(coefficient * n**0.5 + 0.5), 1)
    if train < k:
        k = max(train // 4, 1)
    return min(k, train)


def reciprocal_rank(rank: Column | str, k: int = 60) -> Column:
    """1 / (k + rank); 0 for an absent rank."""
    return F.coalesce(1.0 / (k + F.col(rank) if isinstance(rank, str) else k + rank), F.lit(0.0))


def join_ints(v: Column | str) -> Column:
    return F.array_join(v, ",")


def split_ints(text: Column | str) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ","), lambda x: x.cast("int")))
