"""Forum-post queries: relevance, engagement, keep-best, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from brieflane import fixed
from brieflane.operators import config as cfgops
from brieflane.operators import filters, ranking, trend
from brieflane.plans import api, indexes
from brieflane.plans.oracle_views import register_view, sql_relevant, with_views
from brieflane.plans.registry import query
from brieflane.sources import fixtures as fx


def _cfg(spark):
    return cfgops.config_lookup(fx.analyzed_entities(spark), fx.config_table(spark))


def _relevant(spark, sf_dir):
    p = fx.posts(spark, sf_dir)
    return api.relevant_posts(p, _cfg(spark), api.anchor_of(p, "created_utc"))


@query("top_posts_engagement", with_views(["top_posts"], """
SELECT entity, rank, id, subreddit, title, score, num_comments, engagement, search_term, created_utc
FROM top_posts"""))
def top_posts_engagement(spark, sf_dir):
    """Flagship: top 10 relevant, de-duplicated posts per entity by engagement."""
    return api.top_posts_by_engagement(_relevant(spark, sf_dir)).select(*api.POST_OUT)


def _fetched(spark, sf_dir, with_time: bool):
    p = fx.posts(spark, sf_dir)
    anchor = api.anchor_of(p, "created_utc") if with_time else None
    return api.fetch_posts(p, _cfg(spark), anchor)


@query("relevance_filter", with_views(["plan", "posts"], f"""
SELECT pl.entity, p.id, p.subreddit, p.search_term, p.title
FROM posts p JOIN plan pl ON p.subreddit = pl.subreddit AND p.search_term = pl.search_term
WHERE coalesce({sql_relevant('p.title', 'pl.keywords', 'pl.companies')}, false)"""))
def relevance_filter(spark, sf_dir):
    """C1 over every post each entity's plan retrieves (all time)."""
    f = filters.relevance_filter(_fetched(spark, sf_dir, with_time=False))
    return f.select("entity", "id", "subreddit", "search_term", "title")


@query("timeframe_filter", with_views(["fetched"], """
SELECT entity, id, created_utc FROM fetched"""))
def timeframe_filter(spark, sf_dir):
    """C4: fetched posts inside each entity's timeframe window before the anchor."""
    return _fetched(spark, sf_dir, with_time=True).select("entity", "id", "created_utc")


@query("engagement_rank", with_views(["relevant"], """
SELECT entity, id, title, engagement, sub_pos, term_pos, resp_order FROM relevant
ORDER BY entity, engagement DESC, sub_pos, term_pos, resp_order"""))
def engagement_rank(spark, sf_dir):
    """Relevant posts in engagement order (desc) with arrival order on ties.

    A global sort (range-partitioned), so an entity holding most rows is still spread."""
    r = _relevant(spark, sf_dir)
    return (r.select("entity", "id", "title", "engagement", "sub_pos", "term_pos", "resp_order")
            .orderBy("entity", F.col("engagement").desc(), "sub_pos", "term_pos", "resp_order"))


@query("dedup_best", with_views(["best_posts"], """
SELECT entity, title, id, subreddit, engagement FROM best_posts"""))
def dedup_best(spark, sf_dir):
    """The most engaging copy of each title per entity."""
    b = api.best_posts(_relevant(spark, sf_dir))
    return b.select("entity", "title", "id", "subreddit", "engagement")


@query("top_posts_score", with_views(["top_posts_score"], """
SELECT entity, rank, subreddit, title, score, num_comments AS comments, search_term FROM top_posts_score"""))
def top_posts_score(spark, sf_dir):
    """Per entity, the 10 highest-scoring fetched posts (no relevance, no de-dup)."""
    t = api.top_posts_by_score(_fetched(spark, sf_dir, with_time=True))
    return t.select("entity", "rank", "subreddit", "title", "score",
                    F.col("num_comments").alias("comments"), "search_term")


@query("request_cap", with_views(["posts"], """
SELECT subreddit, search_term, id, title,
       CAST(row_number() OVER (PARTITION BY subreddit, search_term ORDER BY resp_order) AS BIGINT) AS resp_rank
FROM posts QUALIFY resp_rank <= 10"""))
def request_cap(spark, sf_dir):
    """At most 10 posts per (subreddit, search term) request in response order."""
    p = fx.posts(spark, sf_dir)
    c = ranking.request_cap(p, ["subreddit", "search_term"], F.col("resp_order"), fixed.POSTS_PER_REQUEST_PLAIN)
    return c.select("subreddit", "search_term", "id", "title", "resp_rank")


@query("subreddit_discovery", with_views(["posts", "cfg_lookup"], """
WITH kw AS (SELECT entity, unnest(keywords) AS term FROM cfg_lookup),
hits AS (SELECT DISTINCT k.entity, p.id, p.subreddit
         FROM posts p JOIN kw k ON length(k.term) > 0 AND contains(lower(p.title), k.term)),
counts AS (SELECT entity, subreddit, CAST(count(*) AS BIGINT) AS n_relevant FROM hits GROUP BY 1, 2)
SELECT entity, subreddit, n_relevant,
       CAST(row_number() OVER (PARTITION BY entity ORDER BY n_relevant DESC, subreddit) AS BIGINT) AS rank
FROM counts QUALIFY rank <= 5"""))
def subreddit_discovery(spark, sf_dir):
    """For every entity, the 5 subreddits with most posts matching its keywords
    (over all posts, not only configured subreddits), from the titles' word index."""
    p = fx.posts(spark, sf_dir)
    return api.discover_subreddits(p, _cfg(spark), index=indexes.of_posts(spark, sf_dir))


register_view("trend_days", ("relevant", "anchor"), """
  SELECT s.entity, s.entity_pos, s.timeframe, s.day, coalesce(c.n_posts, 0) AS n_posts, coalesce(c.engagement, 0) AS engagement
  FROM (SELECT entity, entity_pos, timeframe, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day
        FROM (SELECT entity, entity_pos, timeframe, min(CAST(created_utc AS DATE)) AS first_day,
                     (SELECT CAST(anchor_ts AS DATE) FROM anchor) AS last_day FROM relevant GROUP BY 1, 2, 3)) s
  LEFT JOIN (SELECT entity_pos, CAST(created_utc AS DATE) AS day, count(*) AS n_posts, CAST(sum(engagement) AS BIGINT) AS engagement
             FROM relevant GROUP BY 1, 2) c ON s.entity_pos = c.entity_pos AND s.day = c.day""")


@query("engagement_trend", with_views(["trend_days"], """
SELECT entity, CAST(day AS TIMESTAMP) AS day_start, CAST(n_posts AS BIGINT) AS n_posts, CAST(engagement AS BIGINT) AS engagement,
       CAST(lag(engagement) OVER w AS BIGINT) AS prev_engagement,
       CAST(engagement - lag(engagement) OVER w AS BIGINT) AS change
FROM trend_days WINDOW w AS (PARTITION BY entity_pos ORDER BY day)"""))
def engagement_trend(spark, sf_dir):
    """K1: relevant posts and engagement per entity per day up to the anchor, change vs the day
    before; a day without posts counts 0."""
    p = fx.posts(spark, sf_dir)
    anchor = api.anchor_of(p, "created_utc")
    return trend.engagement_trend(api.relevant_posts(p, _cfg(spark), anchor), anchor)


@query("engagement_windows", with_views(["trend_days"], """
WITH n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY entity_pos) AS days,
         sum(n_posts) OVER (w ROWS 2 PRECEDING) AS wp, sum(engagement) OVER (w ROWS 2 PRECEDING) AS we
  FROM trend_days WINDOW w AS (PARTITION BY entity_pos ORDER BY day)),
b AS (SELECT a.entity_pos, a.i, avg(p.we) AS baseline, max(CASE WHEN p.i = a.i - 3 THEN p.we END) AS prev
      FROM n a JOIN n p ON a.entity_pos = p.entity_pos AND p.i IN (a.i - 3, a.i - 6, a.i - 9, a.i - 12) AND p.i >= 3 GROUP BY 1, 2)
SELECT n.entity, n.timeframe, n.day - 2 AS first_day, n.day AS last_day, CAST(wp AS BIGINT) AS n_posts, CAST(we AS BIGINT) AS engagement,
       CAST(b.prev AS BIGINT) AS prev_engagement, CAST(we - b.prev AS BIGINT) AS change, round(b.baseline, 6) AS baseline,
       CASE WHEN b.baseline > 0 THEN round(we / b.baseline, 6) END AS ratio
FROM n LEFT JOIN b USING (entity_pos, i) WHERE n.i >= 3 AND (n.days - n.i) % 2 = 0"""))
def engagement_windows(spark, sf_dir):
    """K1: three-day windows every two days per entity, against the window before and the mean of
    the last four."""
    p = fx.posts(spark, sf_dir)
    anchor = api.anchor_of(p, "created_utc")
    out = trend.window_trend(api.relevant_posts(p, _cfg(spark), anchor), days=3, step=2, baseline=4, until=anchor)
    return out.drop("entity_pos")


_WORDS = "'[^\\p{L}\\p{N}]+'"


@query("relevance_word_match", with_views(["plan", "posts"], f"""
SELECT pl.entity, p.id, p.subreddit, p.search_term, p.title
FROM posts p JOIN plan pl ON p.subreddit = pl.subreddit AND p.search_term = pl.search_term
WHERE len(list_filter(pl.keywords, lambda k: CASE WHEN contains(k, ' ')
          THEN contains(' ' || lower(p.title) || ' ', ' ' || k || ' ')
          ELSE list_contains(regexp_split_to_array(lower(p.title), {_WORDS}), k) END)) > 0
   OR len(list_filter(coalesce(pl.companies, CAST([] AS VARCHAR[])),
          lambda c: list_contains(regexp_split_to_array(upper(lower(p.title)), {_WORDS}), c))) > 0"""))
def relevance_word_match(spark, sf_dir):
    """K4: C1 with whole-word matching instead of substrings (over all fetched posts)."""
    f = filters.relevance_filter(_fetched(spark, sf_dir, with_time=False), word_boundary=True)
    return f.select("entity", "id", "subreddit", "search_term", "title")
