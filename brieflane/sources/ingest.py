"""Typed ingest of landed responses with fault isolation.

Bad input never fails a job: a malformed body, an unparsable date or a non-200
response is routed to a quarantine frame with a reason, and the rest continues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflane import schemas
from brieflane.sources.fixtures import epoch_to_ntz

JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
ISO = "yyyy-MM-dd'T'HH:mm:ssZ"
ISO_Z_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
LAST_EPOCH = 253402300800  # the end of year 9999


def epoch_seconds_to_ntz(x: Column) -> Column:
    """Fractional epoch seconds -> TIMESTAMP_NTZ (UTC); null beyond year 9999 either way."""
    sane = F.when(F.abs(x) < LAST_EPOCH, x)
    micros = (sane * F.lit(1_000_000)).try_cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_iso_z(s: Column) -> Column:
    """ISO-8601 'yyyy-MM-ddTHH:mm:ssZ' with a literal Z -> TIMESTAMP_NTZ; null when unparsable.
    No zone is involved, so the session's plays no part."""
    instant = F.try_to_timestamp(F.concat(F.substring(s, 1, 19), F.lit("+0000")), F.lit(ISO))
    return F.when(s.rlike(ISO_Z_SHAPE), epoch_to_ntz(F.unix_seconds(instant)))


# ------------------------------------------------------------------------ forum posts
def parse_post_envelopes(responses: DataFrame) -> DataFrame:
    """Responses with the body parsed (``j``); non-200 responses are kept unparsed."""
    return responses.withColumn(
        "j", F.when(F.col("status") == 200, F.from_json("body", schemas.POST_ENVELOPE, JSON_OPTS)))


def response_reason() -> Column:
    """Why a response cannot be used; null if it can. Every response is one or the other."""
    status = F.coalesce(F.col("status").cast("string"), F.lit("without status"))
    return (F.when(~F.col("status").eqNullSafe(200), F.concat(F.lit("HTTP "), status))
            .when(F.col("body").isNull() | (F.trim("body") == ""), F.lit("empty body"))
            .when(F.col("j").isNull() | F.col("j._corrupt_record").isNotNull(), F.lit("malformed JSON")))


def envelope_children(parsed: DataFrame, carry: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """Every child of the usable responses, typed, with ``reason`` where a value of it is bad.
    ``outer`` gives a response without children a row, too (with reason ``no data``)."""
    explode = F.posexplode_outer if outer else F.posexplode
    kids = parsed.where(response_reason().isNull()).select(
        "response_id", F.col("subreddit").alias("req_subreddit"), "search_term", *carry,
        explode(F.col("j.data.children")).alias("resp_pos", "c"))
    d = F.col("c.data")
    score, comments = d["score"].try_cast("bigint"), d["num_comments"].try_cast("bigint")
    epoch = epoch_seconds_to_ntz(F.coalesce(d["created_utc"].try_cast("double"), F.when(d["created_utc"].isNull(), F.lit(0.0))))
    reason = (F.when(F.col("c").isNull() | d.isNull(), F.lit("no data"))
              .when(d["score"].isNotNull() & score.isNull(), F.lit("bad score"))
              .when(d["num_comments"].isNotNull() & comments.isNull(), F.lit("bad num_comments"))
              .when(epoch.isNull(), F.lit("bad created_utc")))
    return kids.select(
        d["id"].alias("id"), d["title"].alias("title"),
        F.coalesce(d["subreddit"], F.col("req_subreddit")).alias("subreddit"),
        F.coalesce(score, F.lit(0).cast("bigint")).alias("score"),
        F.coalesce(comments, F.lit(0).cast("bigint")).alias("num_comments"),
        epoch.alias("created_utc"), F.coalesce(d["selftext"], F.lit("")).alias("selftext"),
        "search_term", "response_id", F.col("resp_pos").cast("bigint").alias("resp_pos"), *carry, reason.alias("reason"))


def envelope_posts(parsed: DataFrame, carry: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """A1 + A2: unwrap data.children[].data into typed posts with defaults.

    Missing `data`/`children` (or null children) yields no rows; missing counts and
    times become 0, missing body text '', missing subreddit the searched one.
    ``carry`` names response-level columns copied onto every post. ``outer`` changes no row; on
    a stream it lets responses without posts move the watermark."""
    good = envelope_children(parsed, carry, outer).where(F.col("reason").isNull()).drop("reason")
    return schemas.conform(good, schemas.POSTS)


def envelope_quarantine(parsed: DataFrame) -> DataFrame:
    """A8 + A10: responses that could not be used, with a reason."""
    return parsed.select(F.lit("post_response").alias("kind"), F.col("response_id").alias("record_id"),
                         response_reason().alias("reason")).where(F.col("reason").isNotNull())


def children_quarantine(parsed: DataFrame) -> DataFrame:
    """Single posts of usable responses that could not be typed, with a reason."""
    bad = envelope_children(parsed).where(F.col("reason").isNotNull())
    record = F.concat_ws("#", "response_id", F.col("resp_pos").cast("string"))
    return bad.select(F.lit("post").alias("kind"), record.alias("record_id"), "reason")


# --------------------------------------------------------------------------- articles
def typed_articles(raw: DataFrame) -> DataFrame:
    """A3: article fields, nested source name, parsed publication time. Missing texts stay null:
    lines have their own text for them (H2), tables and the digest ``article_defaults``."""
    return schemas.conform(raw.select(
        "article_id", "title", "description",
        parse_iso_z(F.col("publishedAt")).alias("publishedAt"),
        F.col("source.name").alias("source"),
        F.col("language"),
        F.col("publishedAt").alias("publishedAt_raw"),
    ), schemas.ARTICLES)


def article_defaults(articles: DataFrame) -> DataFrame:
    """Missing title, description and source as empty texts."""
    return articles.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "description", "source")})


def articles_good(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("publishedAt").isNotNull()).drop("publishedAt_raw")


def articles_quarantine(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("publishedAt").isNull()).select(
        F.lit("article").alias("kind"), F.col("article_id").cast("string").alias("record_id"),
        F.lit("unparsable publishedAt").alias("reason"))


# ----------------------------------------------------------------------------- videos
def assemble_transcripts(segments: DataFrame) -> DataFrame:
    """A5: segment texts joined with one space in position order, one row per video.

    The text is the output, so a video's segments meet in one row; runs of ``PIECE`` positions
    are joined first, so what meets there is few pieces, not many small structs."""
    run = segments.groupBy("video_id", F.floor(F.col("position") / PIECE).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.count("text").alias("n_texts"), F.count("*").alias("n"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("n_texts") > 0, F.struct("run", "text"))))
    return run.groupBy("video_id").agg(F.array_join(F.transform(pieces, lambda s: s["text"]), " ").alias("transcript_text"),
                                       F.sum("n").alias("n_segments"))


PIECE = 256


def typed_videos(search: DataFrame, stats: DataFrame) -> DataFrame:
    """A4: search items with the first statistics of their video (by view count text, if several
    landed), typed, with ``reason`` where a value does not parse. Without statistics there is no
    video; a missing view count is 0."""
    w = Window.partitionBy("video_id").orderBy(F.col("viewCount").asc_nulls_last())
    one = stats.select("video_id", "viewCount").withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    term = F.col("search_term") if "search_term" in search.columns else F.lit(None).cast("string")
    s = search.select(F.col("id.videoId").alias("video_id"), F.col("snippet.title").alias("title"),
                      F.col("snippet.channelTitle").alias("channel_title"),
                      parse_iso_z(F.col("snippet.publishedAt")).alias("published_at"), "search_pos", term.alias("search_term"))
    views = F.col("viewCount").try_cast("bigint")
    reason = (F.when(F.col("published_at").isNull(), F.lit("unparsable publishedAt"))
              .when(F.col("viewCount").isNotNull() & views.isNull(), F.lit("unparsable viewCount")))
    return s.join(one, "video_id").select(
        "video_id", "title", "channel_title", "published_at", "search_pos", "search_term",
        F.coalesce(views, F.lit(0).cast("bigint")).alias("view_count"), reason.alias("reason"))


def video_facts(search: DataFrame, stats: DataFrame) -> DataFrame:
    """A4 without transcripts: the good rows of ``typed_videos``."""
    return typed_videos(search, stats).where(F.col("reason").isNull()).drop("reason")


def videos_quarantine(search: DataFrame, stats: DataFrame) -> DataFrame:
    """Videos set aside with a reason."""
    bad = typed_videos(search, stats).where(F.col("reason").isNotNull())
    return bad.select(F.lit("video").alias("kind"), F.col("video_id").alias("record_id"), "reason")


def enrich_videos(search: DataFrame, stats: DataFrame, transcripts: DataFrame) -> DataFrame:
    """A4: video facts ⟕ transcript ('' if missing)."""
    t = transcripts.select("video_id", "transcript_text")
    j = (video_facts(search, stats).join(t, "video_id", "left")
         .withColumn("transcript_text", F.coalesce("transcript_text", F.lit(""))))
    return schemas.conform(j, schemas.VIDEOS)


# ----------------------------------------------------------------------------- quotes
def one_chart_each(parsed: DataFrame) -> DataFrame:
    """One parsed response per symbol: one with both prices before one that parsed, before any other
    200 response, before the rest; then by status and a hash of what was read. A truncated response
    never stands before a good one, whatever their order."""
    usable = F.col("status").eqNullSafe(200) & ~F.col("malformed")
    priced = usable & F.col("current_price").isNotNull() & F.col("previous_close").isNotNull()
    read = F.xxhash64("current_price", "previous_close", "last_volume", "n_bars")
    w = Window.partitionBy("symbol").orderBy(priced.desc(), usable.desc(), F.col("status").eqNullSafe(200).desc(), "status", read)
    return parsed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def parse_charts(charts: DataFrame) -> DataFrame:
    """First result's meta and the last element of its first volume array.

    Every response keeps its row and ``status``; only 200 responses are parsed (A10),
    the fields of the others stay null."""
    j = F.when(F.col("status") == 200, F.from_json("body", schemas.CHART_ENVELOPE, JSON_OPTS))
    p = charts.withColumn("j", j)
    r0 = F.try_element_at(F.col("j.chart.result"), F.lit(1))
    q0 = F.try_element_at(r0["indicators"]["quote"], F.lit(1))
    vol = q0["volume"]
    return p.select(
        "symbol", "status",
        r0["meta"]["regularMarketPrice"].alias("current_price"),
        r0["meta"]["previousClose"].alias("previous_close"),
        F.when(F.size(vol) > 0, F.try_element_at(vol, F.lit(-1))).alias("last_volume"),
        F.when(vol.isNull(), F.lit(0)).otherwise(F.size(vol)).cast("bigint").alias("n_bars"),
        F.coalesce(F.col("j._corrupt_record").isNotNull(), F.lit(False)).alias("malformed"),
    )


def transcript_heads(segments: DataFrame, n_chars: int) -> DataFrame:
    """Per video: the assembled transcript's length and first ``n_chars`` characters,
    without assembling it. The head needs at most ``n_chars + 1`` segments (each adds a
    separator), taken per video by a top-k whose partial limit runs before the shuffle,
    so a video with millions of segments ships only that many rows."""
    from brieflane.operators import ranking

    seg = segments.where(F.col("text").isNotNull())
    size = seg.groupBy("video_id").agg(
        (F.sum(F.length("text")) + F.count("*") - 1).alias("transcript_chars"))
    head = ranking.top_k(seg, ["video_id"], [F.col("position")], n_chars + 1, rank_col="_r")
    prefix = head.groupBy("video_id").agg(F.substring(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))),
                                 lambda s: s["text"]), " "), 1, n_chars).alias("transcript_head"))
    return size.join(prefix, "video_id", "left")


def enrich_video_cards(search: DataFrame, stats: DataFrame, heads: DataFrame, summary) -> DataFrame:
    """A4 for reports: like ``enrich_videos`` but with the transcript summary (F9) built
    from bounded heads instead of the whole transcript. ``summary(chars, head)``."""
    j = video_facts(search, stats).join(heads, "video_id", "left")
    return j.select("video_id", "title", "channel_title", "published_at", "search_pos", "search_term", "view_count",
                    summary(F.coalesce(F.col("transcript_chars"), F.lit(0)), F.col("transcript_head"))
                    .alias("transcript_summary"))
