"""Distinct counts at several levels, exact and from stored sketches (G1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12


def standard_error(lg_k: int = LG_K) -> float:
    return 1.04 / (1 << lg_k) ** 0.5


def distinct_levels(rows: DataFrame, sets: Sequence[Sequence[str]], counted: Sequence[str]) -> DataFrame:
    """Per grouping set: the keys (null where they are not grouped by), ``level`` (their names),
    ``n_rows`` and ``n_<column>`` (distinct values). One pass over the rows for all sets; distinct
    values are made unique per group before they are counted, in two partial aggregates."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    # rows are counted per finest group and value first, so an often repeated value is one row
    slim = rows.groupBy(*keys, *counted).agg(F.count("*").alias("_n"))
    out = slim.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        *[F.grouping(k).alias(f"_g_{k}") for k in keys], F.sum("_n").alias("n_rows"),
        *[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in counted])
    level = F.concat_ws(",", *[F.when(F.col(f"_g_{k}") == 0, F.lit(k)) for k in keys])
    return out.select(level.alias("level"), *keys, "n_rows", *[f"n_{c}" for c in counted])


def daily_sketches(rows: DataFrame, keys: Sequence[str], counted: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Per ``keys`` (the finest level, with the day): rows and a mergeable sketch of each counted
    column. A day's sketches are stored once, beside its exact counts, and never change."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[
        F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"sketch_{c}") for c in counted])


def merged(sketches: DataFrame, keys: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """A coarser level from stored sketches, without the rows: ``n_rows`` (exact) and ``about_<column>``."""
    unions = [F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"about_{c}") for c in counted]
    return sketches.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), *unions)
