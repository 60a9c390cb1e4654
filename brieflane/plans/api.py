"""Entity-level plans: what a caller runs for many entities in one job.

``analyze_entities`` and ``analyze_markets`` take an entities DataFrame
(entity, timeframe, entity_pos) and landed source tables and return one DataFrame. What belongs
to the entities is written to the shared folder while the plan is built (``gather``). An entity may come with several timeframes: everything is keyed by the whole
row (``ENTITY_KEYS``). The building blocks below are reused by the query registry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflane import fixed
from brieflane.operators import config as cfgops
from brieflane.operators import filters, ranking
from brieflane.operators.word_index import WordIndex
from brieflane.session import written

ENTITY_KEYS = ("entity", "entity_pos", "timeframe")


def anchor_of(df: DataFrame, ts_col: str) -> Column:
    """The analysis anchor (replaces `now()`): latest timestamp of a landed table, as a
    scalar subquery (one partial aggregate, no join)."""
    return df.agg(F.max(ts_col)).scalar()


# ----------------------------------------------------------------------------- posts
def fetch_posts(posts: DataFrame, cfg: DataFrame, anchor: Column | None = None,
                day_col: str | None = None, per_request_cap: int | None = None) -> DataFrame:
    """Posts each entity's search plan retrieves: a post belongs to an entity when its
    (subreddit, search term) is one of the entity's requests (B3 + C6), and when it lies
    inside the entity's timeframe window before ``anchor`` (B5, B6, C4).

    The plan side is sum(|subreddits| x |terms|) rows over the entities, so it is
    broadcast by Catalyst's size check; the posts side is never shuffled for it.
    Before the join the scan is bounded by the widest window among the entities (a
    scalar subquery over the entity table); when landed posts are partitioned by a
    date column, ``day_col`` turns that bound into partition pruning.
    ``per_request_cap`` (A9) keeps the first n posts of every (entity row, subreddit, term)
    request in response order, within the entity's own window; landed responses are already
    what the API returned, so the default applies none.
    """
    plan = cfgops.search_plan(cfg, keep=(*ENTITY_KEYS, "keywords", "companies"))
    if anchor is not None:
        widest = cfg.agg(F.max(cfgops.window_days(F.col("timeframe")))).scalar()
        lower = cfgops.cutoff(anchor, widest)
        posts = posts.where(F.col("created_utc") >= lower)
        if day_col is not None:
            posts = posts.where(F.col(day_col) >= F.to_date(lower))
    j = posts.join(plan, ["subreddit", "search_term"], "inner")
    if anchor is not None:
        cut = cfgops.cutoff(anchor, cfgops.window_days(F.col("timeframe")))
        j = j.where(filters.within_window(F.col("created_utc"), cut))
    if per_request_cap is not None:
        j = ranking.request_cap(j, [*ENTITY_KEYS, "subreddit", "search_term"], F.col("resp_order"),
                                per_request_cap).drop("resp_rank")
    return j


#: D1 order: engagement desc, then arrival (subreddit, term, position in the response).
ARRIVAL = ("sub_pos", "term_pos", "resp_order")


def engagement_order() -> list[Column]:
    return [F.col("engagement").desc(), *[F.col(c) for c in ARRIVAL]]


def relevant_posts(posts: DataFrame, cfg: DataFrame, anchor: Column | None,
                   word_boundary: bool = False, day_col: str | None = None) -> DataFrame:
    """Fetched posts that pass the relevance filter (C1), with engagement."""
    f = fetch_posts(posts, cfg, anchor, day_col)
    f = filters.relevance_filter(f, word_boundary=word_boundary)
    return f.withColumn("engagement", ranking.engagement(F.col("score"), F.col("num_comments")))


def best_posts(rel: DataFrame) -> DataFrame:
    """Keep the most engaging copy of every title per entity (arrival order on ties)."""
    cols = [*ENTITY_KEYS, "title", "id", "subreddit", "search_term", "score", "num_comments",
            "engagement", "created_utc", "sub_pos", "term_pos", "resp_order"]
    return ranking.dedup_best(rel.select(*cols), ENTITY_KEYS, "title", engagement_order())


#: What tells the rows of a stored table of fetched posts apart.
PLACE = (*ENTITY_KEYS, "id", *ARRIVAL)


def texts_of(chosen: DataFrame, stored: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``chosen`` rows with the columns ``cols`` of the stored table they come from. The chosen rows
    are written first: their true size decides whether the stored ones stay where they are."""
    few = written(chosen, "chosen")
    own = stored.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(PLACE)], *cols)
    on = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(PLACE)]
    names = [f"_{i}" for i in range(len(PLACE))]
    found = own.join(few.select(*PLACE).distinct(), on, "left_semi").dropDuplicates(names)  # rows of one place are copies
    return few.join(found, on).drop(*names)


def top_posts_by_engagement(rel: DataFrame, k: int = fixed.TOP_POSTS) -> DataFrame:
    """D3: top-k de-duplicated posts per entity by engagement."""
    return ranking.top_k(best_posts(rel), ENTITY_KEYS, engagement_order(), k)


def ranked_places(stored: DataFrame, k: int) -> DataFrame:
    """D2 + D3 without texts: places and engagement of the top-k de-duplicated posts."""
    narrow = stored.select(*PLACE, "engagement", F.xxhash64("title").alias("_h1"), F.xxhash64(F.lit("second"), "title").alias("_h2"))
    best = ranking.top_k(narrow, [*ENTITY_KEYS, "_h1", "_h2"], engagement_order(), 1, rank_col="_r").drop("_r", "_h1", "_h2")
    return ranking.top_k(best, ENTITY_KEYS, engagement_order(), k)


def top_of_stored(stored: DataFrame, k: int = fixed.TOP_POSTS) -> DataFrame:
    """As ``top_posts_by_engagement``, from a stored table of relevant posts. Titles take no part in
    ranking: rows of hashes, numbers and ids go through both windows, and the titles of the chosen
    posts are looked up in the table."""
    return texts_of(ranked_places(stored, k), stored, ["title", "subreddit", "search_term", "score", "num_comments", "created_utc"])


POST_OUT = ["entity", "rank", "id", "subreddit", "title", "score", "num_comments",
            "engagement", "search_term", "created_utc"]


def top_posts_by_score(fetched: DataFrame, k: int = fixed.TOP_POSTS) -> DataFrame:
    """Top-k fetched posts per entity by score (no relevance filter, no de-dup)."""
    order = [F.col("score").desc(), *[F.col(c) for c in ARRIVAL]]
    return ranking.top_k(fetched, ENTITY_KEYS, order, k)


# ---------------------------------------------------------------------------- reports
class Sources:
    """Landed, typed source tables an analysis reads. ``videos`` are facts per video (see
    ``ingest.video_facts``); ``segments`` are transcript segments, from which the chosen
    videos get their ``transcript_summary``; ``news_index`` is the word index of the articles, if
    they have one."""

    def __init__(self, posts: DataFrame, articles: DataFrame, videos: DataFrame, config: DataFrame,
                 charts: DataFrame | None = None, segments: DataFrame | None = None, news_index: WordIndex | None = None):
        self.posts, self.articles, self.videos, self.config, self.charts = posts, articles, videos, config, charts
        self.segments, self.news_index = segments, news_index


def news_text() -> Column:
    """What a news query looks at; a word index of articles holds this text."""
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))


def news_matches(articles: DataFrame, entities: DataFrame, index: WordIndex | None = None) -> DataFrame:
    """B7 + C3: articles whose title and description satisfy an entity's boolean query, by the
    articles' word ``index`` where there is one."""
    q = entities.select(*ENTITY_KEYS, cfgops.news_query(F.col("entity")).alias("cnf"))
    match = index.matches if index else filters.substring_matches
    return filters.cnf_matches(articles, "article_id", news_text(), q, ENTITY_KEYS, match=match)


def discover_subreddits(posts: DataFrame, cfg: DataFrame, k: int = fixed.TOP_SUBREDDITS, index: WordIndex | None = None) -> DataFrame:
    """Per entity, the k subreddits with most posts whose title holds one of its keywords
    (over all posts, not only configured subreddits), by the titles' word ``index`` where there is one."""
    p = posts.select("id", "subreddit", F.lower("title").alias("ltitle"))
    kw = cfg.select("entity", F.explode("keywords").alias("term")).where(F.length("term") > 0).distinct()
    match = index.matches if index else filters.substring_matches
    hits = match(p, F.col("ltitle"), kw, "term", "id").select("entity", "id", "subreddit").distinct()
    counts = hits.groupBy("entity", "subreddit").agg(F.count("*").alias("n_relevant"))
    top = ranking.top_k(counts, ["entity"], [F.col("n_relevant").desc(), F.col("subreddit")], k)
    return top.select("entity", "subreddit", "n_relevant", "rank")


def news_for_entities(articles: DataFrame, entities: DataFrame, cap: int | None = None, index: WordIndex | None = None) -> DataFrame:
    """Articles a news search returns per entity: boolean match, English only; ``cap`` keeps
    the first n in landed (relevance) order, as a search that returns so many would."""
    hits = news_matches(articles.where(filters.language_is(F.col("language"), "en")), entities, index)
    if cap is None:
        return hits
    return ranking.request_cap(hits, ENTITY_KEYS, F.col("article_id"), cap).drop("resp_rank")


def videos_for_entities(videos: DataFrame, entities: DataFrame, anchor: Column | None = None,
                        cap: int | None = None) -> DataFrame:
    """Videos a search returns per entity: title contains the entity, published inside
    the entity's timeframe window before ``anchor`` (C4); ``cap`` keeps the first n in
    search order. ``search_term`` is the entity searched for."""
    ents = entities.select(*ENTITY_KEYS, F.lower("entity").alias("term"))
    hits = filters.substring_matches(videos, F.lower(F.col("title")), ents, "term", "video_id").drop("term")
    if anchor is not None:
        cut = cfgops.cutoff(anchor, cfgops.window_days(F.col("timeframe")))
        hits = hits.where(filters.within_window(F.col("published_at"), cut))
    hits = hits.withColumn("search_term", F.col("entity"))
    if cap is None:
        return hits
    return ranking.request_cap(hits, ENTITY_KEYS, F.col("search_pos"), cap).drop("resp_rank")


def with_summaries(videos: DataFrame, segments: DataFrame | None) -> DataFrame:
    """F9 for chosen videos: transcript heads are built for their ids only."""
    from brieflane.sources import ingest

    if "transcript_summary" in videos.columns:
        return videos
    if segments is None:
        return videos.withColumn("transcript_summary", F.lit(fixed.NO_TRANSCRIPT))
    ids = videos.select("video_id").distinct()
    heads = ingest.transcript_heads(segments.join(ids, "video_id", "left_semi"), fixed.TRANSCRIPT_SUMMARY_CHARS)
    out = videos.join(heads, "video_id", "left")
    summary = summary_from_head(F.coalesce(F.col("transcript_chars"), F.lit(0)), F.col("transcript_head"))
    return out.withColumn("transcript_summary", summary).drop("transcript_chars", "transcript_head")


def recent_news(articles: DataFrame, entities: DataFrame, k: int = fixed.RECENT_NEWS, index: WordIndex | None = None) -> DataFrame:
    """I3 news: per entity, the k newest of the articles its news search returns."""
    news = news_for_entities(articles, entities, index=index)
    return ranking.top_k(news, ENTITY_KEYS, [F.col("publishedAt").desc(), F.col("article_id")], k)


def top_videos(videos: DataFrame, entities: DataFrame, anchor: Column | None = None,
               k: int = fixed.TOP_VIDEOS) -> DataFrame:
    """I3 videos: per entity, the k most viewed of the videos its search returns."""
    vids = videos_for_entities(videos, entities, anchor)
    return ranking.top_k(vids, ENTITY_KEYS, [F.col("view_count").desc(), F.col("video_id")], k)


def text_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """I3 text features: long-form TF-IDF (doc_id, term, tf, idf, tfidf) of a text column."""
    from brieflane.operators import text as tx
    return tx.tfidf(docs, id_col, text_col)


def transcript_summary(t: Column) -> Column:
    """first 500 characters plus '...', or the no-transcript text."""
    return summary_from_head(F.length(t), F.substring(t, 1, fixed.TRANSCRIPT_SUMMARY_CHARS))


def summary_from_head(chars: Column, head: Column) -> Column:
    """F9 from the transcript's length and its first 500 characters."""
    return F.when(chars > 0, F.concat(head, F.lit("..."))).otherwise(F.lit(fixed.NO_TRANSCRIPT))


def fmt_ts(c: Column) -> Column:
    """F7."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


class Gathered:
    """What the entities' searches found: ``posts`` (with engagement and whether they are relevant),
    ``news`` and ``videos``, keyed by the entity rows, as stored tables."""

    def __init__(self, posts: DataFrame, news: DataFrame, videos: DataFrame):
        self.posts, self.news, self.videos = posts, news, videos


def gather(src: Sources, entities: DataFrame, anchor: Column | None = None) -> Gathered:
    """The posts, articles and videos that belong to each entity row, each found by one pass over its
    source and written to the shared folder. Counts and lists are built from these tables: numbers
    and ids are read without the texts, and no source is read again."""
    anchor = anchor if anchor is not None else anchor_of(src.posts, "created_utc")
    posts = fetch_posts(src.posts, cfgops.config_lookup(entities, src.config), anchor)
    posts = posts.select(*PLACE, "title", "subreddit", "search_term", "score", "num_comments", "created_utc",
                         ranking.engagement(F.col("score"), F.col("num_comments")).alias("engagement"),
                         filters.is_relevant(F.col("title"), F.col("keywords"), F.col("companies")).alias("relevant"))
    news = news_for_entities(src.articles, entities, index=src.news_index)
    videos = videos_for_entities(src.videos, entities, anchor)
    return Gathered(written(posts, "posts"), written(news, "news"), written(videos, "videos"))


def source_counts(entities: DataFrame, found: Gathered) -> DataFrame:
    """G1: rows per source of each entity row (0 where there are none)."""
    from brieflane.operators import report as rp

    keys = list(ENTITY_KEYS)
    parts = [df.groupBy(*keys).agg(F.count("*").alias(name))
             for df, name in ((found.posts, "n_posts"), (found.news, "n_articles"), (found.videos, "n_videos"))]
    zero = F.lit(0).cast("bigint")
    return rp.attach(entities.select(*keys), parts, keys).select(
        *keys, *[F.coalesce(c, zero).alias(c) for c in ("n_posts", "n_articles", "n_videos")])


def raw_data_rows(src: Sources, entities: DataFrame, anchor: Column | None = None) -> DataFrame:
    """H7, full form: every gathered post, article and video as a line, as rows (entity keys,
    section, arrival order, line), so an entity's raw data is never one string."""
    from brieflane.operators import report as rp

    found = gather(src, entities, anchor)
    posts, news, videos = found.posts, found.news, found.videos
    keys = [F.col(c) for c in ENTITY_KEYS]
    no = F.lit(0).cast("bigint")
    return (posts.select(*keys, F.lit("Reddit Posts").alias("section"), F.col("sub_pos").cast("bigint").alias("o1"),
                         F.col("term_pos").cast("bigint").alias("o2"), F.col("resp_order").alias("o3"), rp.post_line_of().alias("line"))
            .unionByName(news.select(*keys, F.lit("News Articles").alias("section"), no.alias("o1"), no.alias("o2"),
                                     F.col("article_id").alias("o3"), rp.news_line(F.col("title"), F.col("source")).alias("line")))
            .unionByName(videos.select(*keys, F.lit("YouTube Videos").alias("section"), no.alias("o1"), no.alias("o2"),
                                       F.col("search_pos").alias("o3"), rp.video_line_of().alias("line"))))


def analyze_entities(src: Sources, entities: DataFrame, anchor: Column | None = None,
                     analyses: DataFrame | None = None, found: Gathered | None = None) -> DataFrame:
    """I1 for many entities at once: one report row per row of ``entities``, from what ``gather``
    found (``found``, if it was called before).

    ``entities``: (entity, timeframe, entity_pos). ``anchor`` replaces `now()` for the
    timeframe windows (default: latest post time). Columns: counts per source (G1),
    status/error (C8), post/news/video lines (H1–H3), JSON digest (H5), briefs (H6),
    raw-data fallback of the top posts and their news (H7; every gathered row is in
    ``raw_data_rows``) and analysis (H8): the model's text from ``analyses``
    (entity keys, analysis) when given, else the fallback.
    """
    from brieflane.operators import report as rp

    found = found or gather(src, entities, anchor)
    news, vids, keys = found.news, found.videos, list(ENTITY_KEYS)
    top_posts = top_of_stored(found.posts.where("relevant"))
    post_lines = rp.ranked_lists(top_posts, keys, "rank", {}, {"post_lines": rp.post_line_of()})
    by_score = top_posts_by_score(found.posts.select(*PLACE, "score"))
    score_lists = rp.ranked_lists(
        texts_of(by_score, found.posts, ["title", "subreddit", "search_term", "num_comments"]), keys, "rank",
        {"top_posts": F.struct("subreddit", "title", "score", F.col("num_comments").alias("comments"),
                               "search_term")}, {})
    news_lists = rp.ranked_lists(
        ranking.top_k(news, keys, [F.col("publishedAt").desc(), F.col("article_id")], fixed.RECENT_NEWS), keys, "rank",
        {"recent_news": F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "source")], fmt_ts(F.col("publishedAt")).alias("publishedAt"))},
        {"news_lines": rp.news_line(F.col("title"), F.col("source")),
         "news_lines_plain": rp.news_line_plain(F.col("title"), F.col("description"))})
    best = ranking.top_k(vids, keys, [F.col("view_count").desc(), F.col("video_id")], fixed.TOP_VIDEOS)
    video_lists = rp.ranked_lists(
        with_summaries(best, src.segments), keys, "rank",
        {"top_videos": F.struct("title", F.col("channel_title").alias("channel"),
                                F.col("view_count").alias("views"),
                                fmt_ts(F.col("published_at")).alias("published_at"), "video_id",
                                F.col("transcript_summary"))},
        {"video_lines": rp.video_line_of()})

    parts = [post_lines, score_lists, news_lists, video_lists]
    if analyses is not None:
        own = [c for c in keys if c in analyses.columns]
        parts.append(analyses.select(*own, F.col("analysis").alias("model_analysis")))
    j = rp.attach(source_counts(entities, found), parts, keys)
    if analyses is None:
        j = j.withColumn("model_analysis", F.lit(None).cast("string"))
    n_p, n_a, n_v = F.col("n_posts"), F.col("n_articles"), F.col("n_videos")
    tp = rp.empty_if_null(F.col("top_posts"), "struct<subreddit:string,title:string,score:bigint,"
                                             "comments:bigint,search_term:string>")
    rn = rp.empty_if_null(F.col("recent_news"), "struct<title:string,description:string,source:string,"
                                              "publishedAt:string>")
    tv = rp.empty_if_null(F.col("top_videos"), "struct<title:string,channel:string,views:bigint,"
                                             "published_at:string,video_id:string,transcript_summary:string>")
    no_data = (n_p == 0) & (n_a == 0)
    post_text = rp.with_fallback_text(F.col("post_lines"), fixed.NO_REDDIT)
    plain_news = rp.with_fallback_text(F.col("news_lines_plain"), fixed.NO_NEWS)
    fallback = rp.fallback_text(post_text, plain_news)
    return j.select(
        *keys, n_p.alias("n_posts"), n_a.alias("n_articles"), n_v.alias("n_videos"),
        F.when(no_data, F.lit("no_data")).otherwise(F.lit("ok")).alias("status"),
        F.when(no_data, F.lit(fixed.NO_DATA_ERROR)).alias("error"),
        post_text.alias("post_lines"),
        rp.with_fallback_text(F.col("news_lines"), fixed.NO_NEWS).alias("news_lines"),
        plain_news.alias("news_lines_plain"),
        rp.with_fallback_text(F.col("video_lines"), fixed.NO_YOUTUBE).alias("video_lines"),
        rp.json_of(F.struct(tp.alias("top_posts"), rn.alias("recent_news"), tv.alias("top_videos"))).alias("digest"),
        rp.brief_text(F.col("entity"), rp.json_of(tp), rp.json_of(rn), rp.json_of(tv)).alias("brief"),
        rp.plain_brief_text(F.col("entity"), post_text, plain_news).alias("brief_plain"),
        fallback.alias("fallback"),
        F.when(~no_data, F.coalesce(F.col("model_analysis"), fallback)).alias("analysis"),
    )


def analyze_markets(entities: DataFrame, config: DataFrame, charts: DataFrame) -> DataFrame:
    """I2 for many entities at once: one market report row per entity."""
    from brieflane.operators import market
    req = cfgops.resolve_symbols(entities, config)
    return market.market_reports(market.symbol_quotes(req, charts))
