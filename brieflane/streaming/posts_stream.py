"""Structured Streaming ingest of landed forum responses (K3).

Landed JSON envelopes are read as a file stream, unwrapped with the same ingest as the
batch path, de-duplicated on post id within an event-time watermark, and written to a
Parquet table with a checkpoint (exactly-once file sink; a restarted query resumes from
its checkpoint). ``availableNow`` processes everything landed so far and stops.

- ``windowed_counts``: posts per fetch window, subreddit and day of creation, as two chained
  stateful operators (de-duplication, windowed aggregate) in append mode.
- ``late_posts``: what came after its window was closed, found by comparing landing and table.
- ``split_sinks``: every micro-batch into a table of good posts and one of dead letters.
- ``keep_top_posts``: live top posts, one table for each micro-batch.

All folders live under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brieflane.operators import ranking
from brieflane.session import discard, intermediate, names_in
from brieflane.sources import ingest

RESPONSE_SCHEMA = T.StructType([
    T.StructField("response_id", T.StringType()), T.StructField("subreddit", T.StringType()),
    T.StructField("search_term", T.StringType()), T.StructField("page", T.LongType()),
    T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])


def shared_folder(spark: SparkSession, name: str) -> str:
    return intermediate(spark, name)


def land_responses(responses: DataFrame, landing: str, fetched_epoch: int, deliveries: int = 2,
                   later: Column | None = None) -> None:
    """Write responses as JSON files, ``deliveries`` times (re-delivery = exact copies),
    stamped with the fetch time (delivery i one hour after delivery i - 1; a response ``later``
    seconds after the others, if given). The files are gzipped. What is delivered more than once is
    computed once."""
    names = [f.name for f in RESPONSE_SCHEMA if f.name != "fetched_at"]
    first = responses.select(*names, (F.lit(0) if later is None else later).alias("later"))
    if deliveries > 1:
        spark, path = responses.sparkSession, intermediate(responses.sparkSession, "responses")
        first.write.option("compression", "zstd").parquet(path)
        first = spark.read.schema(first.schema).parquet(path)
    for i in range(deliveries):
        stamped = first.withColumn("fetched_at", F.timestamp_seconds(F.lit(fetched_epoch + 3600 * i) + F.col("later")))
        (stamped.select(*[f.name for f in RESPONSE_SCHEMA]).write.mode("append").option("compression", "gzip")
         .json(f"{landing}/delivery={i}"))
    if deliveries > 1:
        discard(spark, path)


def empty_poll(spark: SparkSession) -> DataFrame:
    """A usable response without posts."""
    return spark.createDataFrame([("poll", None, None, None, 200, "{}")], "response_id string, subreddit string, "
                                 "search_term string, page bigint, status int, body string")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_landing(spark: SparkSession, landing: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming DataFrame of landed responses."""
    return (spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("recursiveFileLookup", "true").json(landing))


def unique_posts(raw: DataFrame, watermark: str) -> DataFrame:
    """Typed posts of a stream of responses, each id once within the watermark, with ``fetched_at``.

    The watermark is taken from the usable responses, so a poll that brings no posts moves it on
    too: an inner explode would let the optimizer drop such a response below the watermark."""
    parsed = ingest.parse_post_envelopes(raw.withWatermark("fetched_at", watermark))
    # posts without an id cannot be told apart: they are dead letters (``split_sinks``), not one id
    posts = ingest.envelope_posts(parsed, carry=("fetched_at",), outer=True).where(F.col("id").isNotNull())
    return posts.dropDuplicatesWithinWatermark(["id"])


def stream_posts(spark: SparkSession, landing: str, watermark: str = "2 days",
                 max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming DataFrame of unique typed posts from landed responses.

    The watermark is on the fetch time, not the post's creation time: a search returns
    posts of any age, so creation time is arbitrarily out of order, while re-deliveries
    of a post arrive within the watermark delay of each other in fetch time. State for a
    post id is dropped once the fetch-time watermark passes it."""
    return unique_posts(read_landing(spark, landing, max_files_per_trigger), watermark).drop("fetched_at")


def windowed_counts(posts: DataFrame, window: str = "1 day") -> DataFrame:
    """Posts and engagement per fetch window, subreddit and day of creation, from a stream (or a
    table) of unique posts with ``fetched_at``.

    On a stream a window is emitted once, when the watermark has passed its end (append mode): what
    is written is final, and sums over it (``daily_totals``) stay right however old the posts are
    that a later fetch brings. A post belongs to the window in which it was first fetched."""
    return (posts.groupBy(F.window("fetched_at", window).alias("w"), "subreddit", F.to_date("created_utc").alias("created_day"))
            .agg(F.count("*").alias("n_posts"), F.sum(F.col("score") + F.col("num_comments")).cast("bigint").alias("engagement"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "subreddit", "created_day",
                    "n_posts", "engagement"))


def daily_totals(counts: DataFrame) -> DataFrame:
    """Posts and engagement per subreddit and day of creation, over all closed windows."""
    return (counts.groupBy("subreddit", "created_day")
            .agg(F.sum("n_posts").alias("n_posts"), F.sum("engagement").cast("bigint").alias("engagement")))


def late_posts(landing: DataFrame, written: DataFrame) -> DataFrame:
    """Good posts of the landed responses (a batch read of the landing) that the table of unique
    posts lacks: they came later than the watermark allows, or wait for the next run. One row for
    each id, its first fetch."""
    posts = ingest.envelope_posts(ingest.parse_post_envelopes(landing), carry=("fetched_at",)).where(F.col("id").isNotNull())
    first = posts.groupBy("id").agg(F.min_by(F.struct(*[c for c in posts.columns if c != "id"]), "fetched_at").alias("p"))
    return first.join(written.select("id"), "id", "left_anti").select("id", "p.*")


def run_available_now(stream: DataFrame, out: str, checkpoint: str) -> None:
    q = (stream.writeStream.format("parquet").outputMode("append").option("compression", "zstd")
         .option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Batch ids of the tables ``prefix``-n in a folder, rising."""
    return sorted(int(n[len(prefix) + 1:]) for n in names_in(spark, folder) if n.startswith(f"{prefix}-") and n[len(prefix) + 1:].isdigit())


def keep_top_posts(stream: DataFrame, folder: str, checkpoint: str, k: int = 10) -> DataFrame:
    """Live top posts per subreddit by engagement: every micro-batch merges its k best with the
    k best so far and writes them as a table of its own, named by the batch, so a batch that is
    run again writes the same. The last two tables are kept (a batch needs the one before it).
    Returns the last table, also where nothing new had landed."""
    spark = stream.sparkSession
    order = [F.col("engagement").desc(), F.col("id")]
    cols = ["subreddit", "id", "title", "engagement"]
    ranked = "subreddit string, id string, title string, engagement bigint, rank bigint"

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("engagement", ranking.engagement(F.col("score"), F.col("num_comments"))).select(*cols)
        if batch_id > 0:
            new = new.unionByName(spark.read.parquet(f"{folder}/top-{batch_id - 1}").select(*cols))
        ranking.top_k(new, ["subreddit"], order, k).write.mode("overwrite").parquet(f"{folder}/top-{batch_id}")
        for old in _numbered(spark, folder, "top"):
            if old < batch_id - 1:
                discard(spark, f"{folder}/top-{old}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    done = _numbered(spark, folder, "top")
    return spark.read.parquet(f"{folder}/top-{done[-1]}") if done else spark.createDataFrame([], ranked)


LETTER = "kind string, record_id string, reason string, content string"


def post_letters(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a batch of responses. A response that cannot be used is one dead letter, and
    so is each bad post of a usable one, a post without an id included; every other post is good."""
    parsed = ingest.parse_post_envelopes(responses)
    kids = ingest.envelope_children(parsed, carry=("fetched_at",))
    kids = kids.withColumn("reason", F.coalesce("reason", F.when(F.col("id").isNull(), F.lit("no id"))))
    reason = ingest.response_reason()
    whole = parsed.where(reason.isNotNull()).select(
        F.lit("post_response").alias("kind"), F.col("response_id").alias("record_id"), reason.alias("reason"), F.col("body").alias("content"))
    record = F.concat_ws("#", "response_id", F.col("resp_pos").cast("string"))
    single = kids.where(F.col("reason").isNotNull()).select(
        F.lit("post").alias("kind"), record.alias("record_id"), "reason", F.to_json(F.struct("id", "title", "subreddit")).alias("content"))
    return kids.where(F.col("reason").isNull()).drop("reason"), whole.unionByName(single)


def split_sinks(raw: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes every micro-batch of responses into two tables, ``good`` and ``bad`` (dead letters),
    each in a folder named by the batch. A batch that failed between the two, or after them, is run
    again with the same id and writes the same folders anew, so nothing is lost or counted twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = post_letters(batch)
        for name, part in (("good", good), ("bad", bad)):
            write_part(part, f"{folder}/{name}/batch={batch_id}")

    q = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def write_part(part: DataFrame, path: str) -> None:
    part.write.mode("overwrite").option("compression", "zstd").parquet(path)


def daily_counts(posts: DataFrame) -> DataFrame:
    """Posts and engagement per subreddit per day."""
    return (posts.groupBy("subreddit", F.window("created_utc", "1 day").alias("w"))
            .agg(F.count("*").alias("n_posts"),
                 F.sum(F.col("score") + F.col("num_comments")).cast("bigint").alias("engagement"))
            .select("subreddit", F.col("w.start").alias("day_start"), "n_posts", "engagement"))
