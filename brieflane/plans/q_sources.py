"""Ingest and per-source selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brieflane import fixed
from brieflane.operators import filters
from brieflane.plans import api, indexes
from brieflane.plans.oracle_views import (lit, register_view, sql_epoch_ntz, sql_iso, sql_window_days,
                                          str_list, with_views)
from brieflane.plans.registry import query
from brieflane.sources import fixtures as fx
from brieflane.sources import ingest

E = fx.EPOCH_2024

# ------------------------------------------------------------------ DuckDB twins
register_view("article_raw", (), f"""
  SELECT page_id AS article_id,
         CASE WHEN page_id % 50 <> 7 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
         trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS description,
         CASE WHEN contains(url, 'utm_source=') THEN strftime(ts, '%Y/%m/%d %H:%M') ELSE {sql_iso('ts')} END AS publishedAt,
         CASE WHEN page_id % 50 <> 11 THEN regexp_extract(url, '^https?://([^/?#:]+)', 1) END AS source_name,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS language
  FROM (SELECT *, {sql_epoch_ntz(f'{E} + (page_id % 30) * 86400 + (page_id * 7919) % 86400')} AS ts FROM pages)""")

register_view("articles_typed", ("article_raw",), """
  SELECT article_id, title, description, try_strptime(publishedAt, '%Y-%m-%dT%H:%M:%SZ') AS publishedAt,
         source_name AS source, language
  FROM article_raw""")

register_view("articles", ("articles_typed",), "SELECT * FROM articles_typed WHERE publishedAt IS NOT NULL")

register_view("conv_facts", (), """
  SELECT conv_id, arg_min(text, turn) AS first_text,
         arg_min(role, turn) FILTER (WHERE turn >= 1) AS second_role,
         count(*) AS n_turns, count(*) FILTER (WHERE role = 'assistant') AS n_assistant
  FROM conversations GROUP BY conv_id""")

register_view("video_search", ("conv_facts",), f"""
  SELECT CAST(conv_id AS VARCHAR) AS video_id, first_text AS title,
         coalesce(second_role, 'unknown') AS channel_title,
         {sql_iso(sql_epoch_ntz(f'{E} + (conv_id % 30) * 86400 + (conv_id * 104729) % 86400'))} AS publishedAt,
         conv_id AS search_pos
  FROM conv_facts""")

register_view("video_stats", ("conv_facts",), """
  SELECT CAST(conv_id AS VARCHAR) AS video_id,
         CASE WHEN n_turns > 2 THEN CAST((conv_id * 7919) % 100000 AS VARCHAR) END AS viewCount
  FROM conv_facts WHERE n_assistant > 0""")

register_view("segments", (), """
  SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS position, text FROM conversations""")

register_view("transcripts", ("segments",), """
  SELECT video_id, string_agg(text, ' ' ORDER BY position) AS transcript_text, count(*) AS n_segments
  FROM segments GROUP BY video_id""")

register_view("videos", ("video_search", "video_stats", "transcripts"), """
  SELECT s.video_id, s.title, s.channel_title, try_strptime(s.publishedAt, '%Y-%m-%dT%H:%M:%SZ') AS published_at,
         s.search_pos, coalesce(TRY_CAST(st.viewCount AS BIGINT), 0) AS view_count,
         coalesce(t.transcript_text, '') AS transcript_text
  FROM video_search s JOIN video_stats st USING (video_id) LEFT JOIN transcripts t USING (video_id)""")

_iron = "[" + ", ".join(str_list(g) for g in fixed.IRON_NEWS_QUERY) + "]"
register_view("entity_queries", ("analyzed",), f"""
  SELECT entity, entity_pos,
         CASE WHEN lower(entity) = 'iron' THEN {_iron} ELSE [[lower(entity)]] END AS cnf
  FROM analyzed""")

register_view("news_hits", ("articles", "entity_queries"), """
  SELECT q.entity, q.entity_pos, a.*
  FROM articles a JOIN entity_queries q
    ON len(list_filter(q.cnf, lambda g: len(list_filter(g, lambda t:
           contains(lower(coalesce(a.title, '') || ' ' || coalesce(a.description, '')), t))) > 0)) = len(q.cnf)""")

register_view("recent_news", ("news_hits",), f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY entity_pos ORDER BY publishedAt DESC, article_id) AS BIGINT) AS rank
  FROM news_hits WHERE language = 'en' QUALIFY rank <= {fixed.RECENT_NEWS}""")

register_view("video_hits", ("videos", "analyzed", "anchor"), f"""
  SELECT a.entity, a.entity_pos, v.* FROM videos v JOIN analyzed a ON contains(lower(v.title), lower(a.entity))
  CROSS JOIN anchor an
  WHERE v.published_at >= an.anchor_ts - to_days(CAST({sql_window_days('a.timeframe')} AS INTEGER))""")

register_view("top_videos", ("video_hits",), f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY entity_pos ORDER BY view_count DESC, video_id) AS BIGINT) AS rank,
         CASE WHEN length(transcript_text) > 0 THEN substr(transcript_text, 1, {fixed.TRANSCRIPT_SUMMARY_CHARS}) || '...'
              ELSE {lit(fixed.NO_TRANSCRIPT)} END AS transcript_summary
  FROM video_hits QUALIFY rank <= {fixed.TOP_VIDEOS}""")


# ------------------------------------------------------------------ Spark builders
def articles(spark, sf_dir):
    return ingest.articles_good(ingest.typed_articles(fx.article_responses(spark, sf_dir)))


def videos(spark, sf_dir):
    tr = ingest.assemble_transcripts(fx.transcript_segments(spark, sf_dir))
    return ingest.enrich_videos(fx.video_search(spark, sf_dir), fx.video_stats(spark, sf_dir), tr)


def video_cards(spark, sf_dir):
    """Videos with the bounded transcript summary instead of the whole transcript."""
    heads = ingest.transcript_heads(fx.transcript_segments(spark, sf_dir), fixed.TRANSCRIPT_SUMMARY_CHARS)
    return ingest.enrich_video_cards(fx.video_search(spark, sf_dir), fx.video_stats(spark, sf_dir), heads,
                                     api.summary_from_head)


def video_ids(spark, sf_dir):
    """Ids of enriched videos (search items that have statistics)."""
    s = fx.video_search(spark, sf_dir).select(F.col("id.videoId").alias("video_id"))
    return s.join(fx.video_stats(spark, sf_dir).select("video_id"), "video_id", "inner")


def fmt_ts(c):
    """F7."""
    return api.fmt_ts(F.col(c) if isinstance(c, str) else c)


# ------------------------------------------------------------------ queries
@query("ingest_envelope_posts", with_views(["posts"], """
SELECT id, title, subreddit, score, num_comments, created_utc, selftext, search_term,
       subreddit || '/' || search_term || '/' || CAST(CAST(floor(resp_order / 100) AS BIGINT) AS VARCHAR) AS response_id,
       CAST(row_number() OVER (PARTITION BY subreddit, search_term, floor(resp_order / 100) ORDER BY resp_order) - 1 AS BIGINT) AS resp_pos
FROM posts
UNION ALL SELECT 'ok', 't', 'src7', 1, 2, TIMESTAMP '2024-01-01 00:00:00', '', 'en', 'bad/children', 0"""))
def ingest_envelope_posts(spark, sf_dir):
    """A1/A2: parse every landed response envelope back into typed posts."""
    return ingest.envelope_posts(ingest.parse_post_envelopes(fx.post_responses(spark, sf_dir)))


@query("ingest_quarantine", with_views(["article_raw"], """
SELECT 'post_response' AS kind, 'bad/truncated' AS record_id, 'malformed JSON' AS reason
UNION ALL SELECT 'post_response', 'bad/unavailable', 'HTTP 503'
UNION ALL SELECT 'post_response', 'bad/no-status', 'HTTP without status'
UNION ALL SELECT 'post_response', 'bad/no-body', 'empty body'
UNION ALL SELECT 'post_response', 'bad/blank', 'empty body'
UNION ALL SELECT 'post', 'bad/children#1', 'bad score'
UNION ALL SELECT 'post', 'bad/children#2', 'bad score'
UNION ALL SELECT 'post', 'bad/children#3', 'bad created_utc'
UNION ALL SELECT 'article', CAST(article_id AS VARCHAR), 'unparsable publishedAt'
FROM article_raw WHERE try_strptime(publishedAt, '%Y-%m-%dT%H:%M:%SZ') IS NULL"""))
def ingest_quarantine(spark, sf_dir):
    """Records set aside with a reason — malformed or non-200 forum responses
    and articles whose publication time does not parse — while the rest continues."""
    parsed = ingest.parse_post_envelopes(fx.post_responses(spark, sf_dir))
    q2 = ingest.articles_quarantine(ingest.typed_articles(fx.article_responses(spark, sf_dir)))
    q3 = ingest.videos_quarantine(fx.video_search(spark, sf_dir), fx.video_stats(spark, sf_dir))
    return (ingest.envelope_quarantine(parsed).unionByName(ingest.children_quarantine(parsed))
            .unionByName(q2).unionByName(q3))


@query("ingest_balance", """
SELECT 'post_response' AS kind, CAST(count(*) + 8 AS BIGINT) AS n_input, CAST(count(*) + 3 AS BIGINT) AS n_good,
       CAST(5 AS BIGINT) AS n_quarantined
FROM (SELECT DISTINCT source, lang, floor(doc_id / 100) FROM documents)
UNION ALL SELECT 'post', CAST(count(*) + 4 AS BIGINT), CAST(count(*) + 1 AS BIGINT), CAST(3 AS BIGINT) FROM documents
""")
def ingest_balance(spark, sf_dir):
    """Good + quarantined = input, for responses and for the posts in usable ones."""
    parsed = ingest.parse_post_envelopes(fx.post_responses(spark, sf_dir))
    reason = ingest.response_reason()
    kids = ingest.envelope_children(parsed)

    def line(df, kind, bad):
        return df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_input"), F.count_if(~bad).alias("n_good"),
                      F.count_if(bad).alias("n_quarantined"))
    return line(parsed, "post_response", reason.isNotNull()).unionByName(line(kids, "post", F.col("reason").isNotNull()))


@query("articles_extract", with_views(["articles"], """
SELECT article_id, coalesce(title, '') AS title, coalesce(description, '') AS description, publishedAt,
       coalesce(source, '') AS source, language FROM articles"""))
def articles_extract(spark, sf_dir):
    """A3: typed articles (defaults, nested source name, ISO-Z time)."""
    a = ingest.article_defaults(articles(spark, sf_dir))
    return a.select("article_id", "title", "description", "publishedAt", "source", "language")


@query("language_filter", with_views(["articles"], """
SELECT article_id, title, language FROM articles WHERE language = 'en'"""))
def language_filter(spark, sf_dir):
    """English articles only."""
    a = articles(spark, sf_dir)
    return a.where(filters.language_is(F.col("language"), "en")).select("article_id", "title", "language")


@query("news_boolean_query", with_views(["news_hits"], """
SELECT entity, article_id, title FROM news_hits"""))
def news_boolean_query(spark, sf_dir):
    """B7 + C3: articles matching each entity's boolean news query (CNF of substrings
    over title and description), from the articles' word index."""
    hits = api.news_matches(articles(spark, sf_dir), fx.analyzed_entities(spark), indexes.of_articles(spark, sf_dir))
    return hits.select("entity", "article_id", "title")


@query("recent_news", with_views(["recent_news"], """
SELECT entity, rank, title, description, source, strftime(publishedAt, '%Y-%m-%d %H:%M:%S') AS publishedAt
FROM recent_news"""))
def recent_news(spark, sf_dir):
    """The 5 most recent matching English articles per entity."""
    r = api.recent_news(articles(spark, sf_dir), fx.analyzed_entities(spark), index=indexes.of_articles(spark, sf_dir))
    return r.select("entity", "rank", "title", "description", "source", fmt_ts("publishedAt").alias("publishedAt"))


@query("transcript_assembly", with_views(["transcripts"], """
SELECT video_id, transcript_text, CAST(n_segments AS BIGINT) AS n_segments FROM transcripts"""))
def transcript_assembly(spark, sf_dir):
    """A5: ordered transcript text per video."""
    return ingest.assemble_transcripts(fx.transcript_segments(spark, sf_dir))


@query("videos_enriched", with_views(["videos"], """
SELECT video_id, title, channel_title, published_at, view_count, transcript_text FROM videos"""))
def videos_enriched(spark, sf_dir):
    """A4: search items with statistics (inner) and transcripts (left, default '')."""
    return videos(spark, sf_dir).select("video_id", "title", "channel_title", "published_at",
                                        "view_count", "transcript_text")


@query("transcript_summary", with_views(["videos"], f"""
SELECT video_id,
       CASE WHEN length(transcript_text) > 0 THEN substr(transcript_text, 1, {fixed.TRANSCRIPT_SUMMARY_CHARS}) || '...'
            ELSE {lit(fixed.NO_TRANSCRIPT)} END AS transcript_summary
FROM videos"""))
def transcript_summary_q(spark, sf_dir):
    """transcript summary for every enriched video (from bounded transcript heads)."""
    return video_cards(spark, sf_dir).select("video_id", "transcript_summary")


@query("top_videos", with_views(["top_videos"], """
SELECT entity, rank, title, channel_title AS channel, view_count AS views,
       strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, video_id, transcript_summary
FROM top_videos"""))
def top_videos(spark, sf_dir):
    """Per entity, the 5 most viewed matching videos. Titles are matched before any
    transcript is touched; heads are built for the chosen videos only."""
    anchor = api.anchor_of(fx.posts(spark, sf_dir), "created_utc")
    cards = ingest.video_facts(fx.video_search(spark, sf_dir), fx.video_stats(spark, sf_dir))
    t = api.with_summaries(api.top_videos(cards, fx.analyzed_entities(spark), anchor), fx.transcript_segments(spark, sf_dir))
    return t.select("entity", "rank", "title", F.col("channel_title").alias("channel"),
                    F.col("view_count").alias("views"), fmt_ts("published_at").alias("published_at"),
                    "video_id", "transcript_summary")
