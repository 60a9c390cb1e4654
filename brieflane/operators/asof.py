"""As-of join: the last row of the right side at or before each row of the left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, take: dict[str, str],
              unit: str = "day", strict: bool = False, within: Column | None = None) -> DataFrame:
    """``left`` with the columns ``take`` (right name -> new name) of the last right row of the same
    ``by`` at or before ``left_ts`` (before it, if ``strict``; not older than the interval ``within``,
    if given). Left rows without one keep nulls, as do those with a null key or time. Of right rows
    of one time the greatest (by time, then ``take``) counts.

    Both sides are united and sorted by key and time range (``unit``), not by key alone, so a hot key
    is as many tasks as it has ranges; choose a unit that bounds what one holds. What comes over from
    earlier ranges is one row for each key and range, found by a partial aggregate, and joined to rows
    that lie in that partitioning already.
    """
    by, none = list(by), F.lit(None)
    known = [F.col(c).isNotNull() for c in by]
    right_row = F.struct(F.col(right_ts).alias("_at"), *[F.col(c) for c in take])
    asked = left.select(*by, F.col(left_ts).alias("_ts"), F.struct(*left.columns).alias("_l"))
    whole = F.col("_ts").isNotNull()
    for k in known:
        whole = whole & k
    ticks = right.where(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).alias("_ts"), right_row.alias("_r"))
    for k in known:
        ticks = ticks.where(k)
    kind_l, kind_r = asked.schema["_l"].dataType, ticks.schema["_r"].dataType
    rows = (asked.where(whole).withColumns({"_r": none.cast(kind_r), "_side": F.lit(0 if strict else 1)})
            .unionByName(ticks.withColumns({"_l": none.cast(kind_l), "_side": F.lit(1 if strict else 0)}))
            .withColumn("_range", F.date_trunc(unit, "_ts")))
    here = Window.partitionBy(*by, "_range").orderBy("_ts", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("_in", F.last("_r", ignorenulls=True).over(here)).where(F.col("_l").isNotNull())
    ranges = rows.groupBy(*by, "_range").agg(F.max("_r").alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(*by, "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    found = inside.join(carried, [*by, "_range"]).select("_l", "_ts", F.coalesce("_in", "_before").alias("_r"))
    if within is not None:
        found = found.withColumn("_r", F.when(F.col("_r._at") >= F.col("_ts") - within, F.col("_r")))
    out = found.select("_l", "_r").unionByName(asked.where(~F.coalesce(whole, F.lit(False))).select("_l", none.cast(kind_r).alias("_r")))
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(name) for c, name in take.items()])
