"""Landing and counting: reconciliation, bucketed posts, intervals, distinct counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brieflane import sinks
from brieflane.operators import config as cfgops
from brieflane.operators import distinct, intervals
from brieflane.plans import api, indexes, q_sources
from brieflane.plans.oracle_views import lit, register_view, sql_window_days, with_views
from brieflane.plans.registry import query
from brieflane.sources import fixtures as fx
from brieflane.sources import ingest, reconcile
from brieflane.streaming import posts_stream

POST_COLUMNS = ["id", "title", "subreddit", "score", "num_comments", "created_utc", "search_term"]


@query("ingest_reconcile", with_views(["posts"], """
SELECT CAST(created_utc AS DATE) AS day,
       CASE WHEN resp_order % 13 = 0 AND resp_order % 7 = 0 THEN NULL WHEN resp_order % 13 = 0 THEN 'kept'
            WHEN resp_order % 7 = 0 THEN 'inserted' WHEN resp_order % 11 = 0 THEN 'changed' ELSE 'unchanged' END AS kind,
       count(*) AS n
FROM posts WHERE NOT (resp_order % 13 = 0 AND resp_order % 7 = 0)
  AND CAST(created_utc AS DATE) IN (SELECT CAST(created_utc AS DATE) FROM posts WHERE resp_order % 13 <> 0) GROUP BY 1, 2"""))
def ingest_reconcile(spark, sf_dir):
    """A landing against the stored days. Stored are all posts but one in seven, one in eleven
    with another score; one in thirteen does not land again; every landed post comes twice."""
    p = fx.posts(spark, sf_dir)
    n, path = F.col("resp_order"), posts_stream.shared_folder(spark, "stored-posts")
    old = p.where(n % 7 != 0).withColumn("score", F.col("score") + F.when((n % 11 == 0) & (n % 13 != 0), 1).otherwise(0))
    day = F.to_date("created_utc")
    reconcile.reconcile(path, old.select(*POST_COLUMNS), day)
    landed = p.where(n % 13 != 0).select(*POST_COLUMNS)
    return reconcile.reconcile(path, landed.unionByName(landed), day)


@query("posts_bucketed", with_views(["fetched"], "SELECT entity, entity_pos, id, created_utc FROM fetched"))
def posts_bucketed(spark, sf_dir):
    """Posts each entity's plan retrieves, from a table bucketed by request."""
    name = f"brieflane_posts_{uuid.uuid4().hex}"
    p = fx.posts(spark, sf_dir).select("id", "subreddit", "search_term", "created_utc")
    posts = sinks.land_posts_bucketed(p, name, posts_stream.shared_folder(spark, "bucketed"), buckets=8)
    cfg = cfgops.config_lookup(fx.analyzed_entities(spark), fx.config_table(spark))
    found = api.fetch_posts(posts, cfg, api.anchor_of(posts, "created_utc"), day_col="day")
    return found.select("entity", "entity_pos", "id", "created_utc")


register_view("request_spans", ("anchor",), f"""
  SELECT request_id, subreddit, search_term, span_end - to_days(CAST({sql_window_days('timeframe')} AS INTEGER)) AS span_start, span_end
  FROM (SELECT p_partkey AS request_id, 'src' || CAST(p_partkey % 10 AS VARCHAR) AS subreddit,
               (['en', 'de', 'fr', 'es'])[CAST(p_size % 4 AS INTEGER) + 1] AS search_term,
               ({fx.REQUEST_TIMEFRAMES!r})[CAST(p_size % {len(fx.REQUEST_TIMEFRAMES)} AS INTEGER) + 1] AS timeframe,
               (SELECT anchor_ts FROM anchor) - to_hours(CAST((p_partkey * 7) % 480 AS INTEGER)) AS span_end
        FROM part)""")


@query("posts_by_interval", with_views(["posts", "request_spans"], """
SELECT r.request_id, count(p.id) AS n_posts, coalesce(CAST(sum(p.score + p.num_comments) AS BIGINT), 0) AS engagement,
       min(p.created_utc) AS first_post, max(p.created_utc) AS last_post
FROM request_spans r LEFT JOIN posts p ON r.subreddit = p.subreddit AND r.search_term = p.search_term
 AND p.created_utc >= r.span_start AND p.created_utc <= r.span_end GROUP BY 1"""))
def posts_by_interval(spark, sf_dir):
    """B3 + C4: posts of every request inside its own time span (one request for each catalogue part,
    spans of its timeframe that end at its own time), by time bins."""
    p = fx.posts(spark, sf_dir)
    spans = fx.request_spans(spark, sf_dir, api.anchor_of(p, "created_utc"))
    points = p.select("id", "subreddit", "search_term", "created_utc", (F.col("score") + F.col("num_comments")).alias("engagement"))
    out = intervals.counts_by_interval(
        points, spans, ["subreddit", "search_term"], "created_utc", "span_start", "span_end", ["request_id"],
        {"n_posts": F.count("*"), "engagement": F.sum("engagement").cast("bigint"), "first_post": F.min("created_utc"),
         "last_post": F.max("created_utc")}, strategy="merge")
    zero = F.lit(0).cast("bigint")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("n_posts", "engagement")})


SETS = [["entity", "source", "day"], ["entity", "source"], ["entity"], ["source"], ["day"], []]
register_view("gathered_rows", ("fetched", "news_hits", "video_hits"), """
  SELECT entity, 'post' AS source, CAST(created_utc AS DATE) AS day, id AS record, subreddit AS origin FROM fetched
  UNION ALL SELECT entity, 'article', CAST(publishedAt AS DATE), CAST(article_id AS VARCHAR), source FROM news_hits WHERE language = 'en'
  UNION ALL SELECT entity, 'video', CAST(published_at AS DATE), video_id, channel_title FROM video_hits""")


def gathered_rows(spark, sf_dir):
    """What the analysed entities gather, as narrow rows (entity, source, day, record, origin), written
    once to the shared folder."""
    p, entities = fx.posts(spark, sf_dir), fx.analyzed_entities(spark)
    anchor = api.anchor_of(p, "created_utc")
    posts = api.fetch_posts(p, cfgops.config_lookup(entities, fx.config_table(spark)), anchor)
    news = api.news_for_entities(q_sources.articles(spark, sf_dir), entities, index=indexes.of_articles(spark, sf_dir))
    facts = ingest.video_facts(fx.video_search(spark, sf_dir), fx.video_stats(spark, sf_dir))
    videos = api.videos_for_entities(facts, entities, anchor)

    def slim(df, source, day, record, origin):
        return df.select("entity", F.lit(source).alias("source"), F.to_date(day).alias("day"),
                         F.col(record).cast("string").alias("record"), F.col(origin).alias("origin"))

    rows = (slim(posts, "post", "created_utc", "id", "subreddit")
            .unionByName(slim(news, "article", "publishedAt", "article_id", "source"))
            .unionByName(slim(videos, "video", "published_at", "video_id", "channel_title")))
    path = posts_stream.shared_folder(spark, "gathered")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


_SETS = ", ".join("(" + ", ".join(s) + ")" for s in SETS)
_LEVEL = "concat_ws(',', " + ", ".join(f"CASE WHEN grouping({k}) = 0 THEN {lit(k)} END" for k in SETS[0]) + ")"


@query("distinct_counts", with_views(["gathered_rows"], f"""
SELECT {_LEVEL} AS level, entity, source, day, count(*) AS n_rows, count(DISTINCT record) AS n_record,
       count(DISTINCT origin) AS n_origin
FROM gathered_rows GROUP BY GROUPING SETS ({_SETS})"""))
def distinct_counts(spark, sf_dir):
    """G1 at several levels: rows, distinct records and distinct origins per entity, source and day,
    and all coarser levels, in one pass."""
    out = distinct.distinct_levels(gathered_rows(spark, sf_dir), SETS, ["record", "origin"])
    return out.withColumn("n_rows", F.col("n_rows").cast("bigint"))


@query("distinct_sketches", with_views(["gathered_rows"], """
SELECT entity, source, count(*) AS n_rows, count(DISTINCT record) AS n_record, true AS within
FROM gathered_rows GROUP BY 1, 2"""))
def distinct_sketches(spark, sf_dir):
    """G1 from stored daily sketches: records per entity and source merged over all days, beside the
    exact count, and whether the estimate lies within four standard errors (and one record) of it."""
    rows, path = gathered_rows(spark, sf_dir), posts_stream.shared_folder(spark, "sketches")
    distinct.daily_sketches(rows, ["entity", "source", "day"], ["record"]).write.partitionBy("day").parquet(path)
    about = distinct.merged(spark.read.parquet(path), ["entity", "source"], ["record"]).drop("n_rows")
    exact = rows.groupBy("entity", "source").agg(F.count("*").alias("n_rows"), F.count_distinct("record").alias("n_record"))
    within = F.abs(F.col("about_record") - F.col("n_record")) <= 4 * distinct.standard_error() * F.col("n_record") + 1
    return exact.join(about, ["entity", "source"]).select("entity", "source", "n_rows", "n_record", within.alias("within"))
