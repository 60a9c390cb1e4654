"""Engagement trend per entity on a calendar of time windows (K1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("entity", "entity_pos", "timeframe")


def daily(relevant: DataFrame, until: Column | None = None, ts_col: str = "created_utc") -> DataFrame:
    """Posts and engagement per entity and day, from its first day with posts to the day of
    ``until`` (default: its last one). A day without posts has a row with zeros.

    Days with posts are counted first (partial aggregate); the calendar then holds one row for
    each entity and day, whatever the number of posts."""
    keys = [c for c in KEYS if c in relevant.columns]
    counted = (relevant.groupBy(*keys, F.to_date(ts_col).alias("day"))
               .agg(F.count("*").alias("n_posts"), F.sum("engagement").cast("bigint").alias("engagement")))
    ends = F.max("day") if until is None else F.greatest(F.max("day"), F.first(F.to_date(until)))
    spine = counted.groupBy(*keys).agg(F.min("day").alias("_first"), ends.alias("_last"))
    spine = spine.select(*keys, F.explode(F.sequence("_first", "_last")).alias("day"))
    zero = F.lit(0).cast("bigint")
    out = spine.join(counted.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumnRenamed("day", "_day"),
                     [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("day") == F.col("_day")], "left")
    return out.select(*keys, "day", F.coalesce("n_posts", zero).alias("n_posts"), F.coalesce("engagement", zero).alias("engagement"))


def engagement_trend(relevant: DataFrame, until: Column | None = None, ts_col: str = "created_utc") -> DataFrame:
    """Posts and engagement per entity and day, and the change against the day before (which counts
    0 where it had no posts)."""
    d = daily(relevant, until, ts_col)
    keys = [c for c in KEYS if c in d.columns]
    prev = F.lag("engagement").over(Window.partitionBy(*keys).orderBy("day"))
    return d.select("entity", F.col("day").cast("timestamp_ntz").alias("day_start"), "n_posts", "engagement", prev.alias("prev_engagement"),
                    (F.col("engagement") - prev).alias("change"))


def window_trend(relevant: DataFrame, days: int = 7, step: int = 1, baseline: int = 3, until: Column | None = None,
                 ts_col: str = "created_utc") -> DataFrame:
    """Sliding windows of ``days`` days, one every ``step`` days counted back from the last day:
    posts and engagement of the window, the change against the window just before it (the ``days``
    days that end where it begins), and the mean of the last ``baseline`` such windows with the ratio to
    it. A window needs all its days on the entity's calendar; what lies before it may be missing
    (null) or, for the baseline, partly there (mean of the whole windows that are)."""
    d = daily(relevant, until, ts_col)
    keys = [c for c in KEYS if c in d.columns]
    w = Window.partitionBy(*keys).orderBy("day")
    span = w.rowsBetween(1 - days, 0)
    d = d.select(*keys, "day", F.row_number().over(w).alias("_n"), F.count("*").over(Window.partitionBy(*keys)).alias("_all"),
                 F.sum("n_posts").over(span).alias("n_posts"), F.sum("engagement").over(span).alias("engagement"))
    before = [F.lag("engagement", days * i).over(w) for i in range(1, baseline + 1)]
    whole = [F.when(F.col("_n") >= days * (i + 1), b) for i, b in enumerate(before, 1)]
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in whole), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0).cast("bigint")) for x in whole), F.lit(0).cast("bigint"))
    d = d.select(*keys, "day", "_n", "_all", "n_posts", "engagement", whole[0].alias("prev_engagement"),
                 F.when(n > 0, total / n).alias("baseline"))
    d = d.where((F.col("_n") >= days) & ((F.col("_all") - F.col("_n")) % step == 0))
    return d.select(*keys, F.date_sub("day", days - 1).alias("first_day"), F.col("day").alias("last_day"), "n_posts", "engagement",
                    "prev_engagement", (F.col("engagement") - F.col("prev_engagement")).alias("change"), F.round("baseline", 6).alias("baseline"),
                    F.when(F.col("baseline") > 0, F.round(F.col("engagement") / F.col("baseline"), 6)).alias("ratio"))
