"""Points in intervals: an equi-join on time bins, then the exact test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], ts: str, start: str, end: str,
                  unit: str = "day", strategy: str | None = None) -> DataFrame:
    """Every point with every interval of the same ``by`` that holds it (``start <= ts <= end``).

    An interval is copied into each bin (``unit``) that it touches, a point lies in one bin, so points
    are neither copied nor compared with intervals of other times: what is multiplied by key alone
    and filtered afterwards grows with the length of the history. A hot bin is split by adaptive
    execution's skew join. Rows with a null key, time or bound match nothing. ``strategy`` pins the
    join (``merge`` where the intervals are too many to broadcast on an estimate)."""
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    whole = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))
    bins = intervals.where(whole).withColumn(
        "_bin", F.explode(F.sequence(F.date_trunc(unit, start), F.date_trunc(unit, end), step)))
    if strategy:
        bins = bins.hint(strategy)
    placed = points.withColumn("_bin", F.date_trunc(unit, ts))
    return placed.join(bins, [*by, "_bin"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("_bin")


def counts_by_interval(points: DataFrame, intervals: DataFrame, by: Sequence[str], ts: str, start: str, end: str,
                       keys: Sequence[str], aggs: dict[str, Column], unit: str = "day", strategy: str | None = None) -> DataFrame:
    """``aggs`` over the points of every interval, one row for each row of ``keys`` (with nulls
    where an interval holds no point)."""
    found = interval_join(points, intervals, by, ts, start, end, unit, strategy)
    per = found.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return intervals.select(*keys).join(per, list(keys), "left")
