"""Landed source tables built from the driver's synthetic parquet.

The library itself starts from landed tables (posts, article responses, video search
results, statistics, transcript segments, chart responses). Here those tables are derived
from the synthetic test data so that every query's work grows with the input:

* posts            <- documents     (one post per document)
* post_responses   <- posts         (JSON envelopes, <= 100 posts each, plus bad rows)
* article_responses<- pages         (title/host/description extracted from the html)
* video_search / video_stats / transcript_segments <- conversations
* quote_days / chart_responses <- events (one symbol per user, one bar per day)

Each builder has a DuckDB twin in :mod:`brieflane.plans.oracle_views`; keep them in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brieflane.sources.literal import values_table

EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC
PAGE_SIZE = 100  # posts per landed response envelope (ids are dense, so <= 100 per page)

# Fixture search configurations for the synthetic prose (not part of the reproduced
# behaviour; they give the synthetic forum sources an owner). Subreddits are the
# synthetic `documents.source` values, search terms the document languages.
FIXTURE_CONFIGS: dict[str, dict] = {
    "tion": {
        "subreddits": ["src0", "src1", "src2", "src3", "src4"],
        "search_terms": ["en", "fr"],
        "companies": ["U1", "U2", "U3", "U5", "U8", "HEHE"],
        "keywords": ["tion", "rewh", "orre", "ev"],
    },
    "sch": {
        "subreddits": ["src5", "src6", "src7", "src8", "src9"],
        "search_terms": ["de", "en"],
        "companies": None,  # no companies -> default ticker
        "keywords": ["sch", "ung"],
    },
    "odd": {  # its symbols are those of ODD_CHARTS
        "subreddits": ["src10"],
        "search_terms": ["en"],
        "companies": ["BIG", "TWICE"],
        "keywords": ["odd"],
    },
}

# Entities analysed by the report queries: the fixture owners, the configured entries,
# and the calls named by the reproduced test scripts (four of them have no entry).
ANALYZED_ENTITIES: list[tuple[str, str]] = [
    ("tion", "1mo"),
    ("sch", "1y"),
    ("eau", "1w"),
    ("iron", "1w"),
    ("electric vehicles", "1mo"),
    ("ev commodities", "1d"),
    ("precious metals", "1w"),
    ("energy commodities", "3mo"),
    ("lithium", "1w"),
    ("Tesla", "1w"),
    ("artificial intelligence", "1mo"),
    ("cryptocurrency", "3mo"),
    ("tion", "1d"),  # a second timeframe of an entity above
    ("cryptocurrency", "1w"),
    ("odd", "1w"),
]

# Timeframe codes assigned to catalogue-derived requests (includes unknown codes).
REQUEST_TIMEFRAMES = ["1d", "1w", "1mo", "3mo", "1y", "day", "1day", "xyz"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table, one DataFrame per session and path (kept on the session, so it
    lives and dies with it): file listing and footer reads happen once."""
    path = f"{sf_dir}/{name}.parquet"
    try:
        cache = spark.__dict__.setdefault("_brieflane_reads", {})
    except (AttributeError, TypeError):  # a session type without instance attributes
        return spark.read.parquet(path)
    if path not in cache:
        cache[path] = spark.read.parquet(path)
    return cache[path]


def epoch_to_ntz(epoch: Column) -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ in UTC, independent of the session time zone."""
    return F.timestamp_add("SECOND", epoch, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


# ----------------------------------------------------------------------------- posts
def posts_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with `created_utc` as epoch seconds, as landed in the JSON envelopes."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("title"),
        F.col("source").alias("subreddit"),
        F.pmod("n_chars", F.lit(1000)).cast("bigint").alias("score"),
        F.pmod(F.col("doc_id") * 37, F.lit(200)).cast("bigint").alias("num_comments"),
        (F.lit(EPOCH_2024) + F.pmod("doc_id", F.lit(30)) * 86400
         + F.pmod(F.col("doc_id") * 7919, F.lit(86400))).cast("bigint").alias("created_epoch"),
        F.col("text").alias("selftext"),
        F.col("lang").alias("search_term"),
        F.col("doc_id").alias("resp_order"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed `posts` table (id, title, subreddit, score, num_comments, created_utc,
    selftext, search_term, resp_order)."""
    p = posts_epoch(spark, sf_dir)
    return p.select("id", "title", "subreddit", "score", "num_comments",
                    epoch_to_ntz(F.col("created_epoch")).alias("created_utc"),
                    "selftext", "search_term", "resp_order")


#: A response with one good post and three bad ones.
BAD_CHILDREN = ('{"data":{"children":[{"data":{"id":"ok","title":"t","score":1,"num_comments":2,"created_utc":1704067200}},'
                '{"data":{"id":"b1","score":"abc"}},{"data":{"id":"b2","score":12.5}},{"data":{"id":"b3","created_utc":1e15}}]}}')


def post_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed forum responses: one JSON envelope per (subreddit, search term, page).

    Pages hold <= PAGE_SIZE posts because ids are dense, so no envelope grows with skew.
    Extra rows model a truncated body, an empty object, null children, a non-200 status, a
    missing status, a missing and an empty body, and a response with bad posts among good ones.
    """
    p = posts_epoch(spark, sf_dir).withColumn("page", F.floor(F.col("resp_order") / PAGE_SIZE))
    # title and body of a post are one text, which goes through the shuffle once; so does the subreddit
    child = F.struct("resp_order", "id", "title", "score", "num_comments", "created_epoch")
    data = lambda c: F.struct(F.struct(
        c["id"].alias("id"), c["title"].alias("title"), F.col("subreddit"), c["score"].alias("score"),
        c["num_comments"].alias("num_comments"), c["created_epoch"].alias("created_utc"), c["title"].alias("selftext")).alias("data"))
    env = (p.groupBy("subreddit", "search_term", "page")
           .agg(F.sort_array(F.collect_list(child)).alias("cs"))
           .select(
               F.concat_ws("/", "subreddit", "search_term", F.col("page").cast("string")).alias("response_id"),
               "subreddit", "search_term", F.col("page").cast("bigint").alias("page"),
               F.lit(200).alias("status"),
               F.to_json(F.struct(F.struct(F.transform("cs", data).alias("children")).alias("data"))).alias("body")))
    bad = values_table(
        spark,
        [("bad/truncated", "src0", "en", -1, 200, '{"data":{"children":[{"data":{"id":"x"'),
         ("bad/empty", "src1", "en", -2, 200, "{}"),
         ("bad/null-children", "src2", "en", -3, 200, '{"data":{"children":null}}'),
         ("bad/unavailable", "src3", "en", -4, 503, "<html>Service Unavailable</html>"),
         ("bad/no-status", "src4", "en", -5, None, "{}"), ("bad/no-body", "src5", "en", -6, 200, None),
         ("bad/blank", "src6", "en", -7, 200, " "), ("bad/children", "src7", "en", -8, 200, BAD_CHILDREN)],
        [("response_id", "string"), ("subreddit", "string"), ("search_term", "string"),
         ("page", "bigint"), ("status", "int"), ("body", "string")])
    return env.unionByName(bad)


# -------------------------------------------------------------------------- articles
def article_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw news articles (nested `source.name`, ISO-Z `publishedAt` string, language).

    Pages reached through a feed link (`?utm_source=`) carry a non-ISO date, which the
    typed ingest cannot parse and routes to quarantine. One in fifty has no title, one no source.
    """
    pg = read(spark, sf_dir, "pages")
    ts = epoch_to_ntz(F.lit(EPOCH_2024) + F.pmod("page_id", F.lit(30)) * 86400
                      + F.pmod(F.col("page_id") * 7919, F.lit(86400)))
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    loose = F.date_format(ts, "yyyy/MM/dd HH:mm")
    return pg.select(
        F.col("page_id").alias("article_id"),
        F.when(F.pmod("page_id", F.lit(50)) != 7, F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"),
        F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "),
                                r"[ \t\n\x0B\f\r]+", " ")).alias("description"),
        F.when(F.col("url").contains("utm_source="), loose).otherwise(iso).alias("publishedAt"),
        F.struct(F.when(F.pmod("page_id", F.lit(50)) != 11, F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)).alias("name")).alias("source"),
        F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("language"),
        F.col("url"),
    )


# ---------------------------------------------------------------------------- videos
def _conversation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first_text"),
        F.min_by(F.when(F.col("turn") >= 1, F.col("role")),
                 F.when(F.col("turn") >= 1, F.col("turn"))).alias("second_role"),
        F.count("*").alias("n_turns"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
    )


def video_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video search items: nested `id.videoId`, `snippet.{title, channelTitle, publishedAt}`."""
    f = _conversation_facts(spark, sf_dir)
    ts = epoch_to_ntz(F.lit(EPOCH_2024) + F.pmod("conv_id", F.lit(30)) * 86400
                      + F.pmod(F.col("conv_id") * 104729, F.lit(86400)))
    return f.select(
        F.struct(F.col("conv_id").cast("string").alias("videoId")).alias("id"),
        F.struct(F.col("first_text").alias("title"),
                 F.coalesce("second_role", F.lit("unknown")).alias("channelTitle"),
                 F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"),
        F.col("conv_id").alias("search_pos"),
    )


def video_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per video; absent for conversations without an assistant turn, and
    without a view count for conversations of two turns or fewer."""
    f = _conversation_facts(spark, sf_dir)
    return f.where(F.col("n_assistant") > 0).select(
        F.col("conv_id").cast("string").alias("video_id"),
        F.when(F.col("n_turns") > 2,
               F.pmod(F.col("conv_id") * 7919, F.lit(100000)).cast("string")).alias("viewCount"))


def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments (video_id, position, text): every turn of every conversation."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("position"), "text")


# ---------------------------------------------------------------------------- quotes
def quote_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per symbol from the event stream: last value of the day (price), event
    count (volume), and whether the day closed on an error event (no price)."""
    e = read(spark, sf_dir, "events")
    day = F.to_date("ts")
    return (e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
                      day.alias("day"))
            .agg(F.max_by("value", "ts").alias("close"),
                 F.max_by("event_type", "ts").alias("last_type"),
                 F.count("*").alias("volume")))


def quote_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as they come in (symbol, ts, price): the events that are neither errors nor sign-ups."""
    e = read(spark, sf_dir, "events").where(~F.col("event_type").isin("signup", "error"))
    symbol = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return e.groupBy(symbol.alias("symbol"), "ts").agg(F.max("value").alias("price"))


def quote_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which a symbol's quote is asked for: a user's sign-up events."""
    e = read(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select("event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("at"))


#: Prices beyond 2^43, and a symbol with a truncated response beside a good one.
ODD_CHARTS = [
    ("BIG", 200, '{"chart":{"result":[{"meta":{"regularMarketPrice":1e17,"previousClose":3e18},"indicators":{"quote":[{"volume":[9]}]}}]}}'),
    ("TWICE", 200, '{"chart":{"result":[{"meta":{"regularMarketPrice":2.675,"previousCl'),
    ("TWICE", 200, '{"chart":{"result":[{"meta":{"regularMarketPrice":2.675,"previousClose":0.125},"indicators":{"quote":[{"volume":[1200]}]}}]}}'),
]


def chart_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart JSON per symbol: meta.regularMarketPrice (latest close, missing if the last
    event was an error), meta.previousClose (prior day close) and the daily volume array.
    ``ODD_CHARTS`` come with them."""
    d = quote_days(spark, sf_dir)
    bars = d.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("day", "close", "last_type", "volume"))).alias("bars"))
    last = F.element_at("bars", -1)
    prev = F.try_element_at("bars", F.lit(-2))
    meta = F.struct(
        F.when(last["last_type"] != "error", last["close"]).alias("regularMarketPrice"),
        prev["close"].alias("previousClose"))
    quote = F.struct(F.transform("bars", lambda b: b["volume"]).alias("volume"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(
        meta.alias("meta"), F.struct(F.array(quote).alias("quote")).alias("indicators")))
        .alias("result")).alias("chart")))
    odd = values_table(spark, ODD_CHARTS, [("symbol", "string"), ("status", "int"), ("body", "string")])
    return bars.select("symbol", F.lit(200).alias("status"), body.alias("body")).unionByName(odd)


# ------------------------------------------------------------------ configs, entities
def _cfg_row(entity: str, c: dict) -> tuple:
    return (entity, c["subreddits"], c["search_terms"], c["companies"], c["keywords"])


def config_table(spark: SparkSession) -> DataFrame:
    """entity_config (entity, subreddits, search_terms, companies, keywords): the fixed
    configured entries plus the fixture owners of the synthetic sources."""
    from brieflane.fixed import REFERENCE_CONFIGS
    rows = [_cfg_row(k, v) for k, v in REFERENCE_CONFIGS.items()]
    rows += [_cfg_row(k, v) for k, v in FIXTURE_CONFIGS.items()]
    arr = "array<string>"
    return values_table(spark, rows, [("entity", "string"), ("subreddits", arr), ("search_terms", arr),
                                      ("companies", arr), ("keywords", arr)])


def analyzed_entities(spark: SparkSession) -> DataFrame:
    """The entities the report queries analyse (entity, timeframe, entity_pos)."""
    rows = [(e, tf, i) for i, (e, tf) in enumerate(ANALYZED_ENTITIES)]
    return values_table(spark, rows, [("entity", "string"), ("timeframe", "string"), ("entity_pos", "int")])


def entity_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis requests (request_id, entity, timeframe): one per catalogue part (its name
    is the entity, its size picks a timeframe code) plus the analysed entities."""
    part = read(spark, sf_dir, "part")
    codes = F.array(*[F.lit(c) for c in REQUEST_TIMEFRAMES])
    from_parts = part.select(
        F.col("p_partkey").alias("request_id"),
        F.col("p_name").alias("entity"),
        F.element_at(codes, (F.pmod("p_size", F.lit(len(REQUEST_TIMEFRAMES))) + 1).cast("int")).alias("timeframe"))
    named = analyzed_entities(spark).select(
        (-F.col("entity_pos") - 1).cast("bigint").alias("request_id"), "entity", "timeframe")
    return from_parts.unionByName(named)


def request_spans(spark: SparkSession, sf_dir: str, anchor: Column) -> DataFrame:
    """Requests with time spans (request_id, subreddit, search_term, span_start, span_end): one per
    catalogue part, for its own request and timeframe, ending at its own time before ``anchor``."""
    from brieflane.operators import config as cfgops

    part = read(spark, sf_dir, "part")
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))
    end = anchor - F.make_dt_interval(F.lit(0), F.pmod(F.col("p_partkey") * 7, F.lit(480)).cast("int"))
    spans = part.select(
        F.col("p_partkey").alias("request_id"), F.concat(F.lit("src"), F.pmod("p_partkey", F.lit(10)).cast("string")).alias("subreddit"),
        pick(["en", "de", "fr", "es"], F.col("p_size")).alias("search_term"), pick(REQUEST_TIMEFRAMES, F.col("p_size")).alias("timeframe"),
        end.alias("span_end"))
    return spans.select("request_id", "subreddit", "search_term",
                        cfgops.cutoff(F.col("span_end"), cfgops.window_days(F.col("timeframe"))).alias("span_start"), "span_end")


def anchor_ts(p: DataFrame) -> DataFrame:
    """One-row frame with the analysis anchor: the latest post time (replaces `now()`)."""
    return p.agg(F.max("created_utc").alias("anchor_ts"))

