"""Sinks (J2, J3): TF-IDF features to Parquet, reports to JSON.

Paths must be on shared storage (the cluster's warehouse or checkpoint folder), never
a machine-local folder. Writes are plain DataFrame writes: each task writes its own
files and the job commit makes them visible, so a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(tfidf: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The long TF-IDF table (doc_id, term, tf, idf, tfidf) as Parquet."""
    tfidf.write.mode(mode).parquet(path)


def export_reports(reports: DataFrame, path: str, key: str = "entity", buckets: int = 64, mode: str = "overwrite") -> None:
    """One JSON record per report row (null fields kept), in ``buckets`` folders by a hash of
    the key: a reader who wants one entity reads one folder, and names of any form are safe."""
    out = reports.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out.write.mode(mode).option("ignoreNullFields", "false").partitionBy("bucket").json(path)


def land_posts_by_day(posts: DataFrame, path: str, day_col: str = "day", mode: str = "overwrite") -> None:
    """Landed posts partitioned by creation day, so timeframe filters prune partitions
    (read back and pass ``day_col`` to ``fetch_posts`` / ``relevant_posts``)."""
    posts.withColumn(day_col, F.to_date("created_utc")).write.mode(mode).partitionBy(day_col).parquet(path)


def land_posts_bucketed(posts: DataFrame, table: str, path: str, buckets: int = 64, mode: str = "overwrite") -> DataFrame:
    """Landed posts as a table partitioned by creation day and bucketed by request (subreddit, search
    term): a search plan of any size meets the posts without shuffling them, as only the plan is
    dealt to the buckets. ``path`` must be on shared storage; returns the table."""
    (posts.withColumn("day", F.to_date("created_utc")).write.mode(mode).format("parquet").option("path", path)
     .partitionBy("day").bucketBy(buckets, "subreddit", "search_term").sortBy("subreddit", "search_term").saveAsTable(table))
    return posts.sparkSession.table(table)
