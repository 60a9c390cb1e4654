"""Per-entity report queries (C8, G1, H1–H3, H5–H8) over the analysed entities."""

from __future__ import annotations

from brieflane import fixed
from brieflane.plans import api, indexes, q_sources
from brieflane.plans.oracle_views import lit, register_view, with_views
from brieflane.plans.registry import query
from brieflane.sources import fixtures as fx
from brieflane.sources import ingest

_POST_FMT = f"printf({lit(fixed.POST_LINE)}, subreddit, title, score, num_comments, search_term)"
_NEWS_FMT = f"printf({lit(fixed.NEWS_LINE)}, coalesce(title, {lit(fixed.NO_TITLE)}), coalesce(source, {lit(fixed.UNKNOWN)}))"
_VIDEO_FMT = (f"printf({lit(fixed.VIDEO_LINE)}, coalesce(title, {lit(fixed.NO_TITLE)}), "
              f"coalesce(channel_title, {lit(fixed.UNKNOWN)}), coalesce(view_count, 0))")
_TS = "'%Y-%m-%d %H:%M:%S'"

register_view("news_english", ("news_hits",), "SELECT * FROM news_hits WHERE language = 'en'")

register_view("report_parts", ("analyzed", "fetched", "news_english", "video_hits", "top_posts",
                               "top_posts_score", "recent_news", "top_videos"), f"""
  SELECT a.entity, a.entity_pos, a.timeframe,
    (SELECT count(*) FROM fetched f WHERE f.entity_pos = a.entity_pos) AS n_posts,
    (SELECT count(*) FROM news_english n WHERE n.entity_pos = a.entity_pos) AS n_articles,
    (SELECT count(*) FROM video_hits v WHERE v.entity_pos = a.entity_pos) AS n_videos,
    (SELECT string_agg({_POST_FMT}, chr(10) ORDER BY rank) FROM top_posts t WHERE t.entity_pos = a.entity_pos) AS post_lines,
    (SELECT string_agg({_NEWS_FMT}, chr(10) ORDER BY rank)
       FROM recent_news r WHERE r.entity_pos = a.entity_pos) AS news_lines,
    (SELECT string_agg(printf({lit(fixed.NEWS_LINE_PLAIN)}, coalesce(title, ''), coalesce(description, '')), chr(10) ORDER BY rank)
       FROM recent_news r WHERE r.entity_pos = a.entity_pos) AS news_lines_plain,
    (SELECT string_agg({_VIDEO_FMT}, chr(10) ORDER BY rank)
       FROM top_videos v WHERE v.entity_pos = a.entity_pos) AS video_lines,
    coalesce((SELECT to_json(list({{'subreddit': subreddit, 'title': title, 'score': score,
                                    'comments': num_comments, 'search_term': search_term}} ORDER BY rank))
              FROM top_posts_score t WHERE t.entity_pos = a.entity_pos), '[]') AS tp_json,
    coalesce((SELECT to_json(list({{'title': coalesce(title, ''), 'description': coalesce(description, ''),
                                    'source': coalesce(source, ''), 'publishedAt': strftime(publishedAt, {_TS})}} ORDER BY rank))
              FROM recent_news r WHERE r.entity_pos = a.entity_pos), '[]') AS rn_json,
    coalesce((SELECT to_json(list({{'title': title, 'channel': channel_title, 'views': view_count,
                                    'published_at': strftime(published_at, {_TS}), 'video_id': video_id,
                                    'transcript_summary': transcript_summary}} ORDER BY rank))
              FROM top_videos v WHERE v.entity_pos = a.entity_pos), '[]') AS tv_json
  FROM analyzed a""")

_INSTR = ", ".join(lit(x) for x in fixed.BRIEF_INSTRUCTIONS)
_PLAIN_INSTR = ", ".join(lit(x) for x in fixed.PLAIN_BRIEF_INSTRUCTIONS)
_POST_TEXT = f"coalesce(post_lines, {lit(fixed.NO_REDDIT)})"
_NEWS_TEXT = f"coalesce(news_lines_plain, {lit(fixed.NO_NEWS)})"
register_view("entity_reports", ("report_parts",), f"""
  SELECT entity, entity_pos, timeframe, n_posts, n_articles, n_videos,
         CASE WHEN n_posts = 0 AND n_articles = 0 THEN 'no_data' ELSE 'ok' END AS status,
         CASE WHEN n_posts = 0 AND n_articles = 0 THEN {lit(fixed.NO_DATA_ERROR)} END AS error,
         coalesce(post_lines, {lit(fixed.NO_REDDIT)}) AS post_lines,
         coalesce(news_lines, {lit(fixed.NO_NEWS)}) AS news_lines,
         coalesce(news_lines_plain, {lit(fixed.NO_NEWS)}) AS news_lines_plain,
         coalesce(video_lines, {lit(fixed.NO_YOUTUBE)}) AS video_lines,
         '{{"top_posts":' || tp_json || ',"recent_news":' || rn_json || ',"top_videos":' || tv_json || '}}' AS digest,
         concat_ws(chr(10), {lit(fixed.BRIEF_HEAD)} || entity || ':', '', {lit(fixed.BRIEF_SECTIONS[0])}, tp_json,
                   '', {lit(fixed.BRIEF_SECTIONS[1])}, rn_json, '', {lit(fixed.BRIEF_SECTIONS[2])}, tv_json, '', {_INSTR}) AS brief,
         concat_ws(chr(10), {lit(fixed.PLAIN_BRIEF_HEAD)} || entity || ':', '', {lit(fixed.POSTS_SECTION)}, {_POST_TEXT},
                   '', {lit(fixed.NEWS_SECTION)}, {_NEWS_TEXT}, '', {_PLAIN_INSTR}) AS brief_plain,
         {lit(fixed.ERROR_PREFIX)} || chr(10) || chr(10) || {lit(fixed.POSTS_SECTION)} || chr(10) || {_POST_TEXT}
           || chr(10) || chr(10) || {lit(fixed.NEWS_SECTION)} || chr(10) || {_NEWS_TEXT} AS fallback
  FROM report_parts""")


def entity_reports(spark, sf_dir):
    return api.analyze_entities(_sources(spark, sf_dir), fx.analyzed_entities(spark))


def _sources(spark, sf_dir):
    facts = ingest.video_facts(fx.video_search(spark, sf_dir), fx.video_stats(spark, sf_dir))
    return api.Sources(posts=fx.posts(spark, sf_dir), articles=q_sources.articles(spark, sf_dir), videos=facts,
                       config=fx.config_table(spark), segments=fx.transcript_segments(spark, sf_dir),
                       news_index=indexes.of_articles(spark, sf_dir))


def _q(name: str, cols: list[str], doc: str):
    sql = with_views(["entity_reports"], f"SELECT {', '.join(cols)} FROM entity_reports")

    def fn(spark, sf_dir):
        return entity_reports(spark, sf_dir).select(*cols)

    fn.__doc__ = doc
    fn.__name__ = name
    query(name, sql)(fn)


@query("source_counts", with_views(["entity_reports"], "SELECT entity, n_posts, n_articles, n_videos FROM entity_reports"))
def source_counts(spark, sf_dir):
    """G1: rows per source per entity."""
    entities = fx.analyzed_entities(spark)
    return api.source_counts(entities, api.gather(_sources(spark, sf_dir), entities)).select("entity", "n_posts", "n_articles", "n_videos")


_q("entity_status", ["entity", "n_posts", "n_articles", "status", "error"],
   "C8: per-entity empty-input guard (no posts and no articles -> no_data).")
_q("post_lines", ["entity", "post_lines"], "H1: top-post lines per entity (fallback text when none).")
_q("news_lines", ["entity", "news_lines", "news_lines_plain"],
   "H2: recent-news lines per entity ('- title (Source: s)' and the plain '- title: description').")
_q("video_lines", ["entity", "video_lines"], "H3: top-video lines per entity.")
_q("entity_digest", ["entity", "digest"], "H5: JSON digest of the three top lists.")
_q("entity_brief", ["entity", "brief"], "H6: brief text for an external model.")
_q("entity_brief_plain", ["entity", "timeframe", "brief_plain"], "H6: the plain brief.")
_q("entity_fallback", ["entity", "fallback"], "H7: raw-data text used when no analysis is available.")


@query("entity_raw_data", with_views(["fetched", "news_english", "video_hits"], f"""
SELECT entity, timeframe, 'Reddit Posts' AS section, CAST(sub_pos AS BIGINT) AS o1, CAST(term_pos AS BIGINT) AS o2, resp_order AS o3,
       {_POST_FMT} AS line FROM fetched
UNION ALL SELECT n.entity, a.timeframe, 'News Articles', 0, 0, article_id, {_NEWS_FMT}
FROM news_english n JOIN analyzed a ON a.entity_pos = n.entity_pos
UNION ALL SELECT v.entity, a.timeframe, 'YouTube Videos', 0, 0, search_pos, {_VIDEO_FMT}
FROM video_hits v JOIN analyzed a ON a.entity_pos = v.entity_pos"""))
def entity_raw_data(spark, sf_dir):
    """H7, full form: every gathered post, article and video of an entity as a line."""
    return api.raw_data_rows(_sources(spark, sf_dir), fx.analyzed_entities(spark)).select(
        "entity", "timeframe", "section", "o1", "o2", "o3", "line")


@query("entity_report", with_views(["entity_reports"], """
SELECT entity, timeframe, n_posts, n_articles, n_videos, status, error,
       CASE WHEN status = 'ok' THEN fallback END AS analysis
FROM entity_reports"""))
def entity_report(spark, sf_dir):
    """The entity report row (analysis = raw-data fallback until a model fills it)."""
    return entity_reports(spark, sf_dir).select("entity", "timeframe", "n_posts", "n_articles", "n_videos",
                                                "status", "error", "analysis")
