"""Extensions the reproduced code only hints at (K2 classifier, K3 streaming)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brieflane import sinks
from brieflane.operators import classify
from brieflane.plans import q_report
from brieflane.plans.oracle_views import with_views
from brieflane.plans.registry import query
from brieflane.sources import fixtures as fx
from brieflane.streaming import posts_stream


@query("quality_classifier")
def quality_classifier(spark, sf_dir):
    """K2: held-out predictions of a logistic regression on hashed TF-IDF features of labelled
    documents (whole texts), with class weights and a threshold from a validation fold."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    labeled = docs.join(fx.read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "inner")
    _, _, pred = classify.quality_model(labeled)
    return pred.select("doc_id", "quality", "prediction", F.round("p", 6).alias("p_quality"))


@query("quality_held_out", f"""
SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)
WHERE quality IS NOT NULL AND substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN {classify.HELD_OUT}""")
def quality_held_out(spark, sf_dir):
    """K2: the rows that the classifier is measured on."""
    rows = fx.read(spark, sf_dir, "documents").select("doc_id").join(
        fx.read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.where(classify.held_out("doc_id") & F.col("quality").isNotNull())


@query("stream_posts_daily", with_views(["posts"], """
SELECT subreddit, date_trunc('day', created_utc) AS day_start, count(*) AS n_posts,
       CAST(sum(score + num_comments) AS BIGINT) AS engagement
FROM (SELECT subreddit, created_utc, score, num_comments FROM posts
      UNION ALL SELECT 'src7', TIMESTAMP '2024-01-01 00:00:00', 1, 2) GROUP BY 1, 2"""))
def stream_posts_daily(spark, sf_dir):
    """K3: landed responses (delivered twice) -> file stream -> ingest -> watermark
    de-dup -> Parquet sink (availableNow); then posts and engagement per subreddit-day.
    Equals the batch result on the same posts."""
    out = posts_stream.shared_folder(spark, "stream-out")
    posts_stream.run_available_now(_landed_stream(spark, sf_dir), out, posts_stream.shared_folder(spark, "stream-ckpt"))
    return posts_stream.daily_counts(spark.read.parquet(out))


FETCHED = fx.EPOCH_2024 + 31 * 86400  # fetched just after the 30-day data window


def _files_per_trigger(spark):
    """Files of a micro-batch: ``brieflane.stream.filesPerTrigger`` (small in tests, so that state is carried)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", posts_stream.ROCKSDB)
    return int(spark.conf.get("brieflane.stream.filesPerTrigger", "1000"))


def _landed(spark, sf_dir, deliveries=2):
    landing = posts_stream.shared_folder(spark, "landing")
    posts_stream.land_responses(fx.post_responses(spark, sf_dir), landing, FETCHED, deliveries)
    return landing


def _landed_stream(spark, sf_dir):
    """The landed responses, delivered twice, as a stream of posts."""
    n = _files_per_trigger(spark)
    return posts_stream.stream_posts(spark, _landed(spark, sf_dir), max_files_per_trigger=n)


@query("stream_windowed_counts", with_views(["posts"], f"""
SELECT TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST({FETCHED} + (day * 86400) AS BIGINT)) AS window_start,
       subreddit, CAST(created_utc AS DATE) AS created_day, count(*) AS n_posts,
       CAST(sum(score + num_comments) AS BIGINT) AS engagement
FROM (SELECT subreddit, created_utc, score, num_comments, CAST(floor(resp_order / 100) AS BIGINT) % 3 AS day FROM posts
      UNION ALL SELECT 'src7', TIMESTAMP '2024-01-01 00:00:00', 1, 2, 0) GROUP BY 1, 2, 3"""))
def stream_windowed_counts(spark, sf_dir):
    """K3: landed responses, delivered twice over three days -> file stream -> ingest -> watermark
    -> de-dup -> counts per fetch day, subreddit and day of creation, all in the stream (append
    mode). A last poll that finds nothing closes the windows. Equals the batch result."""
    n = _files_per_trigger(spark)
    landing, out = (posts_stream.shared_folder(spark, name) for name in ("landing", "windowed"))
    responses = fx.post_responses(spark, sf_dir).withColumn("late_by", F.greatest(F.col("page"), F.lit(0)) % 3 * 86400)
    posts_stream.land_responses(responses, landing, FETCHED, 2, F.col("late_by"))
    posts_stream.land_responses(posts_stream.empty_poll(spark), f"{landing}/close", FETCHED + 30 * 86400, 1)
    posts = posts_stream.unique_posts(posts_stream.read_landing(spark, landing, n), "5 days")
    posts_stream.run_available_now(posts_stream.windowed_counts(posts), out, posts_stream.shared_folder(spark, "windowed-ckpt"))
    counts = spark.read.parquet(out)
    return counts.select(fx.epoch_to_ntz(F.unix_seconds("window_start")).alias("window_start"), "subreddit", "created_day",
                         "n_posts", "engagement")


@query("stream_dead_letters", """
SELECT 'post' AS kind, CAST(NULL AS VARCHAR) AS reason, CAST(2 * (count(*) + 1) AS BIGINT) AS n FROM documents
UNION ALL SELECT * FROM (VALUES ('post', 'bad score', CAST(4 AS BIGINT)), ('post', 'bad created_utc', 2),
  ('post_response', 'malformed JSON', 2), ('post_response', 'HTTP 503', 2), ('post_response', 'HTTP without status', 2),
  ('post_response', 'empty body', 4))""")
def stream_dead_letters(spark, sf_dir):
    """A8 in the stream: every micro-batch into a table of good posts and one of dead letters;
    good + bad = input (each response is delivered twice)."""
    n, folder = _files_per_trigger(spark), posts_stream.shared_folder(spark, "letters")
    raw = posts_stream.read_landing(spark, _landed(spark, sf_dir), n)
    posts_stream.split_sinks(raw, folder, posts_stream.shared_folder(spark, "letters-ckpt"))
    good = spark.read.parquet(f"{folder}/good").select(F.lit("post").alias("kind"), F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(f"{folder}/bad").select("kind", "reason")
    return good.unionByName(bad).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query("stream_top_posts", with_views(["posts"], """
SELECT subreddit, id, title, CAST(score + num_comments AS BIGINT) AS engagement,
       CAST(row_number() OVER (PARTITION BY subreddit ORDER BY score + num_comments DESC, id) AS BIGINT) AS rank
FROM (SELECT subreddit, id, title, score, num_comments FROM posts UNION ALL SELECT 'src7', 'ok', 't', 1, 2) QUALIFY rank <= 10"""))
def stream_top_posts(spark, sf_dir):
    """K3: live top posts per subreddit, merged micro-batch by micro-batch."""
    return posts_stream.keep_top_posts(_landed_stream(spark, sf_dir), posts_stream.shared_folder(spark, "top-posts"),
                                       posts_stream.shared_folder(spark, "top-ckpt"))


@query("report_export", with_views(["entity_reports"], """
SELECT entity, entity_pos, timeframe, n_posts, n_articles, n_videos, status, error, digest FROM entity_reports"""))
def report_export(spark, sf_dir):
    """Report rows exported as JSON to the shared folder and read back."""
    cols = ["entity", "entity_pos", "timeframe", "n_posts", "n_articles", "n_videos", "status", "error", "digest"]
    reports = q_report.entity_reports(spark, sf_dir).select(*cols)
    path = posts_stream.shared_folder(spark, "reports")
    sinks.export_reports(reports, path)
    return spark.read.schema(reports.schema).json(path).select(*cols)
