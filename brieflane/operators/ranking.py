"""Ordering, keep-best de-duplication and top-k.

Scale notes
* Keep-best is a top-1 per key, where a key is the hash of the text, never the text.
* Top-k per group is ``row_number() <= k``; Catalyst inserts a partial
  ``WindowGroupLimit`` before the exchange, so each map task ships at most k rows per
  group and a group holding a third of the input never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def engagement(score: Column, comments: Column) -> Column:
    """Score + comments (missing counts as 0)."""
    return (F.coalesce(score, F.lit(0)) + F.coalesce(comments, F.lit(0))).cast("bigint")


def dedup_best(df: DataFrame, keys: Sequence[str], text: str, order: Sequence[Column]) -> DataFrame:
    """Per ``keys`` and ``text``, the first row under ``order`` (unique within a group for a
    deterministic answer). Texts meet by two 64-bit hashes, so rows are sorted and dealt by
    fixed-width keys, however long the texts are."""
    hashed = df.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(F.lit("second"), F.col(text)))
    return top_k(hashed, [*keys, "_h1", "_h2"], order, 1, rank_col="_r").drop("_r", "_h1", "_h2")


def top_k(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group under ``order`` with a 1-based rank."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    return ranked.where(F.col(rank_col) <= k).withColumn(rank_col, F.col(rank_col).cast("bigint"))


def request_cap(df: DataFrame, request_cols: Sequence[str], position: Column, n: int) -> DataFrame:
    """At most ``n`` results per request, in response (relevance) order."""
    return top_k(df, request_cols, [position], n, rank_col="resp_rank")
