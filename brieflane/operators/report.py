"""Report building, one row per entity.

Every list here is a top-k list (<= 10 items per entity), so per-entity collection is
bounded; ordering is carried as a rank and restored with ``array_sort``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflane import fixed


def post_line(sub: Column, title: Column, score: Column, comments: Column, term: Column) -> Column:
    """H1: '- [sub] title (Score: s, Comments: c, Search term: t)'."""
    return F.format_string(fixed.POST_LINE, sub, title, score, comments, term)


def post_line_of() -> Column:
    return post_line(F.col("subreddit"), F.col("title"), F.col("score"), F.col("num_comments"), F.col("search_term"))


def news_line(title: Column, source: Column) -> Column:
    """H2: '- title (Source: name)', with the texts for missing fields."""
    return F.format_string(fixed.NEWS_LINE, F.coalesce(title, F.lit(fixed.NO_TITLE)), F.coalesce(source, F.lit(fixed.UNKNOWN)))


def news_line_plain(title: Column, description: Column) -> Column:
    """H2, plain variant: '- title: description', missing ones empty."""
    return F.format_string(fixed.NEWS_LINE_PLAIN, F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))


def video_line(title: Column, channel: Column, views: Column) -> Column:
    """H3: '- title (Channel: c, Views: v)', with the texts for missing fields."""
    return F.format_string(fixed.VIDEO_LINE, F.coalesce(title, F.lit(fixed.NO_TITLE)), F.coalesce(channel, F.lit(fixed.UNKNOWN)),
                           F.coalesce(views, F.lit(0).cast("bigint")))


def video_line_of() -> Column:
    return video_line(F.col("title"), F.col("channel_title"), F.col("view_count"))


def attach(entities: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join per-entity parts onto the entity list, null-safe (every row keeps its place)."""
    out = entities
    for i, p in enumerate(parts):
        own = [k for k in keys if k in p.columns]
        p = p.withColumnsRenamed({k: f"_{k}_{i}" for k in own})
        on = [out[k].eqNullSafe(p[f"_{k}_{i}"]) for k in own]
        out = out.join(p, on, "left").drop(*[f"_{k}_{i}" for k in own])
    return out


def json_of(c: Column) -> Column:
    """JSON with null fields kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def with_fallback_text(c: Column, fallback: str) -> Column:
    return F.coalesce(c, F.lit(fallback))


def empty_if_null(c: Column, elem_type: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{elem_type}>"))


def brief_text(entity: Column, posts_json: Column, news_json: Column, videos_json: Column) -> Column:
    """H6: the brief handed to an external model."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit(fixed.BRIEF_HEAD), entity, F.lit(":")),
        F.lit(""), F.lit(fixed.BRIEF_SECTIONS[0]), posts_json,
        F.lit(""), F.lit(fixed.BRIEF_SECTIONS[1]), news_json,
        F.lit(""), F.lit(fixed.BRIEF_SECTIONS[2]), videos_json,
        F.lit(""), *[F.lit(x) for x in fixed.BRIEF_INSTRUCTIONS])


def plain_brief_text(entity: Column, post_lines: Column, news_lines: Column) -> Column:
    """H6, plain variant: the lines themselves, with its own instructions."""
    return F.concat_ws(
        "\n", F.concat(F.lit(fixed.PLAIN_BRIEF_HEAD), entity, F.lit(":")),
        F.lit(""), F.lit(fixed.POSTS_SECTION), post_lines, F.lit(""), F.lit(fixed.NEWS_SECTION), news_lines,
        F.lit(""), *[F.lit(x) for x in fixed.PLAIN_BRIEF_INSTRUCTIONS])


def fallback_text(post_lines: Column, news_lines: Column) -> Column:
    """H7, plain variant: raw-data text used when no analysis is available."""
    return F.concat(F.lit(f"{fixed.ERROR_PREFIX}\n\n{fixed.POSTS_SECTION}\n"), post_lines,
                    F.lit(f"\n\n{fixed.NEWS_SECTION}\n"), news_lines)


def ranked_lists(df: DataFrame, keys: Sequence[str], rank: str, arrays: dict[str, Column],
                 lines: dict[str, Column]) -> DataFrame:
    """G4 + F11 in one aggregate: per key, each ``arrays`` item as an array and each
    ``lines`` item joined with '\\n', all in rank order. ``df`` holds the top k of each key."""
    fields = ([F.col(rank).alias("r")] + [c.alias(f"a_{n}") for n, c in arrays.items()]
              + [c.alias(f"l_{n}") for n, c in lines.items()])
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_s"))

    def field(name):
        return lambda s: s[name]

    out = ([F.transform("_s", field(f"a_{n}")).alias(n) for n in arrays]
           + [F.array_join(F.transform("_s", field(f"l_{n}")), "\n").alias(n) for n in lines])
    return g.select(*keys, *out)
