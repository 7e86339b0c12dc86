"""Document filters as a small algebra that compiles to one Column.

A filter is two-valued: what is missing or null makes a leaf false, and its
negation true. column() may be null for false, as a WHERE takes it, so that
Catalyst can push plain comparisons into the scan; a negation makes its part
two-valued first, which is enough because "and" and "or" are monotone.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Membership lists up to this length are literals; longer ones become a semi-join.
INLINE_IDS = 1000


class Filter:
    def column(self) -> Column:
        raise NotImplementedError

    def truth(self) -> Column:
        return F.coalesce(self.column(), F.lit(False))

    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class All(Filter):
    def column(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class UuidIn(Filter):
    uuids: tuple[str, ...]

    def column(self) -> Column:
        return F.col("uuid").isin(list(self.uuids)) if self.uuids else F.lit(False)


@dataclass(frozen=True)
class DateRange(Filter):
    """Inclusive at both ends; None leaves an end open."""

    start: dt.datetime | None = None
    end: dt.datetime | None = None

    def column(self) -> Column:
        parts = [F.col("date") >= F.lit(self.start)] if self.start is not None else []
        parts += [F.col("date") <= F.lit(self.end)] if self.end is not None else []
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class MetadataEquals(Filter):
    key: str
    value: str

    def column(self) -> Column:
        return F.col("metadata")[self.key] == self.value


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...] = ()

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...] = ()

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def column(self) -> Column:
        return ~self.part.truth()


def apply(docs: DataFrame, filter: Filter) -> DataFrame:
    """docs that match. A long list of uuids at the top is joined instead of spelt out."""
    if isinstance(filter, UuidIn) and len(filter.uuids) > INLINE_IDS:
        ids = docs.sparkSession.createDataFrame([(u,) for u in filter.uuids], "uuid string")
        return docs.join(ids, "uuid", "left_semi")
    return docs.where(filter.column())
