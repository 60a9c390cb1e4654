"""Explicit schemas (no inference anywhere).

Counts and views are widened to LongType: 32-bit counters reject values >= 2^31.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def _f(name, dtype):
    return T.StructField(name, dtype, True)


POSTS = T.StructType([
    _f("id", S), _f("title", S), _f("subreddit", S), _f("score", L), _f("num_comments", L),
    _f("created_utc", T.TimestampNTZType()), _f("selftext", S), _f("search_term", S),
])

VIDEOS = T.StructType([
    _f("video_id", S), _f("title", S), _f("channel_title", S),
    _f("published_at", T.TimestampNTZType()), _f("view_count", L),
    _f("transcript_text", S), _f("search_term", S),
])

ARTICLES = T.StructType([
    _f("title", S), _f("description", S), _f("publishedAt", T.TimestampNTZType()), _f("source", S),
])

# Forum search response: data.children[].data.{...}; created_utc in epoch seconds. Numbers are
# read as text, so that one bad value spoils one post and not its response.
POST_DATA = T.StructType([
    _f("id", S), _f("title", S), _f("subreddit", S), _f("score", S),
    _f("num_comments", S), _f("created_utc", S), _f("selftext", S),
])
POST_ENVELOPE = T.StructType([
    _f("data", T.StructType([
        _f("children", T.ArrayType(T.StructType([_f("data", POST_DATA)]))),
    ])),
    _f("_corrupt_record", S),
])

# Quote chart response: chart.result[0].{meta, indicators.quote[0].volume[]}.
CHART_ENVELOPE = T.StructType([
    _f("chart", T.StructType([
        _f("result", T.ArrayType(T.StructType([
            _f("meta", T.StructType([_f("regularMarketPrice", D), _f("previousClose", D)])),
            _f("indicators", T.StructType([
                _f("quote", T.ArrayType(T.StructType([_f("volume", T.ArrayType(L))]))),
            ])),
        ]))),
    ])),
    _f("_corrupt_record", S),
])


def conform(df, schema: T.StructType, keep_extra: bool = True):
    """The schema's columns first, in order and cast to its types (missing -> null);
    other columns follow when ``keep_extra``."""
    from pyspark.sql import functions as F
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    extra = [c for c in df.columns if c not in {f.name for f in schema.fields}] if keep_extra else []
    return df.select(*cols, *extra)
