"""Salted joins: ``salted_join`` spreads a hot key of the large side over ``salts`` partitions and
replicates the (one-row-per-key) small side to match, so a key holding a third of all
rows is processed by ``salts`` tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS_CONF = "brieflane.skew.salts"  # session setting; raise it on large clusters
DEFAULT_SALTS = 16


def default_salts(df: DataFrame) -> int:
    """Salt count for hot-key splitting: the session's ``brieflane.skew.salts`` or 16."""
    return int(df.sparkSession.conf.get(SALTS_CONF, str(DEFAULT_SALTS)))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], salts: int | None = None,
                how: str = "inner", salt_source: Column | None = None,
                small_hint: str | None = None) -> DataFrame:
    """Equi-join ``big`` to ``small`` on ``keys`` with the big side spread over ``salts``.

    ``small`` must be keyed (at most one row per key, or small per key): it is
    replicated ``salts`` times. ``salt_source`` picks the salt of a big row (default: a
    hash of all its columns). ``small_hint`` (e.g. ``"shuffle_hash"``) pins the join
    strategy when ``small`` grows with the data and must not be broadcast on an estimate.
    """
    salts = salts or default_salts(big)
    src = salt_source if salt_source is not None else F.xxhash64(*[F.col(c) for c in big.columns])
    # Non-nullable on purpose: a nullable salt makes the optimizer push an inferred
    # isnotnull(...) below ``big``'s aggregates, which stops AQE from reusing their shuffles.
    b = big.withColumn("_salt", F.coalesce(F.pmod(src, F.lit(salts)).cast("int"), F.lit(0)))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if small_hint:
        s = s.hint(small_hint)
    return b.join(s, [*keys, "_salt"], how).drop("_salt")
