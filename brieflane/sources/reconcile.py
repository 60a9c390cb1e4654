"""Incremental ingest: landed posts against the stored table, day by day.

The stored table is partitioned by the day of creation. A run compares what landed with the days it
touches, and writes only the days in which something is new or different. It may be repeated: what
a run has written is unchanged to the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brieflane.session import discard, intermediate, names_in

#: What a row is to a run: new, different from the stored one, equal to it, or stored only.
KINDS = ("inserted", "changed", "unchanged", "kept")


def stored_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored rows with their ``day`` (no rows before the first run)."""
    whole = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
    return spark.read.schema(whole).parquet(path) if names_in(spark, path) else spark.createDataFrame([], whole)


def newest(landed: DataFrame, key: str, fetched: str | None) -> DataFrame:
    """One row for each id: its last fetch (of equals, and without a fetch time, the greatest row)."""
    cols = [c for c in landed.columns if c not in (key, fetched)]
    order = [F.col(fetched)] if fetched else []
    best = landed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, F.struct(*cols).alias("_row"))).alias("_b"))
    return best.select(key, "_b._row.*")


def _fingerprint(cols: Sequence[str]) -> Column:
    return F.struct(*[F.xxhash64(F.lit(seed), *[F.struct(F.col(c).isNull(), F.col(c)) for c in cols]).alias(f"h{seed}") for seed in (1, 2)])


def compare(stored: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """Every row of the touched days as it should be stored, with its kind. The rows meet by day and
    id (full outer join) and are told apart by two 64-bit hashes of all columns. The landed rows lie
    by id since ``newest``: the day is a condition of the join, so that it does not move them again."""
    cols = [c for c in landed.columns if c not in (key, "day")]
    new = landed.select(F.col("day").alias("_nd"), F.col(key).alias("_nk"), F.struct(*cols).alias("_new"), _fingerprint(cols).alias("_hn"))
    touched = landed.select("day").distinct()
    old = stored.join(touched, "day", "left_semi").select(F.col("day").alias("_od"), F.col(key).alias("_ok"), F.struct(*cols).alias("_old"), _fingerprint(cols).alias("_ho"))
    kind = (F.when(F.col("_old").isNull(), F.lit("inserted")).when(F.col("_new").isNull(), F.lit("kept"))
            .when(F.col("_hn") == F.col("_ho"), F.lit("unchanged")).otherwise(F.lit("changed")))
    both = new.hint("merge").join(old, (F.col("_nk") == F.col("_ok")) & (F.datediff("_nd", "_od") == 0), "full_outer")
    return both.select(F.coalesce("_nd", "_od").alias("day"), F.coalesce("_nk", "_ok").alias(key), kind.alias("kind"), F.coalesce("_new", "_old").alias("_row")).select("day", key, "kind", "_row.*")


def reconcile(path: str, landed: DataFrame, day: Column, key: str = "id", fetched: str | None = None) -> DataFrame:
    """Brings ``landed`` into the table at ``path`` and returns (day, kind, n) of the touched days.
    A row without a day counts to 1970-01-01, one without an id is left out (a dead letter).

    The comparison is written to the shared folder first: the days to write are read from it, not
    from the table that is being written, and a run that breaks off leaves whole days."""
    spark = landed.sparkSession
    one = newest(landed.withColumn("day", F.coalesce(day, F.lit("1970-01-01").cast("date"))), key, fetched)
    schema = T.StructType([f for f in one.schema.fields if f.name != "day"])
    place = intermediate(spark, "reconcile")
    rows = compare(stored_table(spark, path, schema), one, key)
    rows.write.option("compression", "zstd").parquet(place)
    rows = spark.read.schema(rows.schema).parquet(place)
    counts = rows.groupBy("day", "kind").agg(F.count("*").alias("n"))
    table = counts.schema
    done = counts.collect()  # four rows a day at most
    dirty = sorted({r["day"] for r in done if r["kind"] in ("inserted", "changed")})
    if dirty:
        out = rows.where(F.col("day").isin(dirty)).drop("kind").select(*schema.names, "day")
        (out.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy("day").parquet(path))
    discard(spark, place)
    return spark.createDataFrame(done, table)
