"""Sorting by collation, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.values import STRING, TIME, Value


def sort_value(v: Value) -> Column:
    """What a value sorts by: texts by code point with missing ones empty, times with missing ones at the epoch, numbers as they are."""
    if v.kind == STRING:
        return F.coalesce(v.col, F.lit(""))
    if v.kind == TIME:
        return F.coalesce(v.col, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return v.col


def direction(key: Column, rising: bool) -> Column:
    """Numbers before missing ones, and the other way round when falling."""
    return key.asc_nulls_last() if rising else key.desc_nulls_first()


def limited(df: DataFrame, keys: list[tuple[Column, bool]], limit: int, offset: int) -> DataFrame:
    """Sort, skip and take; limit 0 takes all. A sort with a limit is planned as a top-k."""
    if keys:
        df = df.orderBy(*[direction(k, up) for k, up in keys])
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df
