"""Entity configuration and search plan.

All lookups are equi-joins against the configuration table. That table is a dimension
with one row per configured entity, so Catalyst's size estimate lets it broadcast; a
large entity list simply becomes a shuffled join (AQE re-plans either way).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflane import fixed


def _str_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# ----------------------------------------------------------------------------- B2
def generated_subreddits(entity: Column) -> Column:
    """Base subreddits, plus the entity with spaces removed when that is alphanumeric."""
    squashed = F.replace(entity, F.lit(" "), F.lit(""))
    base = _str_array(fixed.GENERATED_BASE_SUBREDDITS)
    return F.when(squashed.rlike(r"^[\p{L}\p{N}]+$"), F.array_append(base, squashed)).otherwise(base)


def generated_terms(entity: Column) -> Column:
    return F.transform(_str_array(fixed.GENERATED_TERM_SUFFIXES),
                       lambda s: F.concat(entity, F.lit(" "), s))


def generated_keywords(entity: Column) -> Column:
    return F.array_prepend(_str_array(fixed.GENERATED_EXTRA_KEYWORDS), entity)


def generate_config(entities: DataFrame, entity_col: str = "entity") -> DataFrame:
    """B2: a generated configuration for every row (entity case kept)."""
    e = F.col(entity_col)
    return entities.select(
        "*",
        generated_subreddits(e).alias("subreddits"),
        generated_terms(e).alias("search_terms"),
        _str_array(fixed.GENERATED_COMPANIES).alias("companies"),
        generated_keywords(e).alias("keywords"),
    )


# ----------------------------------------------------------------------------- B1
def config_lookup(entities: DataFrame, config: DataFrame, entity_col: str = "entity",
                  default: str = "generated") -> DataFrame:
    """B1: case-folded lookup of each entity's configuration with a default.

    ``default="generated"`` builds B2's configuration for misses; ``default="plain"``
    uses the plain fallback (four news subreddits, the entity as the only term, no
    companies, the lower-cased entity as the only keyword).
    Adds ``subreddits, search_terms, companies, keywords, configured``.
    """
    cfg = config.select(
        F.col("entity").alias("_cfg_key"),
        F.col("subreddits").alias("_c_subs"), F.col("search_terms").alias("_c_terms"),
        F.col("companies").alias("_c_comp"), F.col("keywords").alias("_c_kw"))
    j = entities.join(cfg, F.lower(F.col(entity_col)) == F.col("_cfg_key"), "left")
    e = F.col(entity_col)
    hit = F.col("_cfg_key").isNotNull()
    if default == "generated":
        d_subs, d_terms = generated_subreddits(e), generated_terms(e)
        d_comp, d_kw = _str_array(fixed.GENERATED_COMPANIES), generated_keywords(e)
    elif default == "plain":
        d_subs, d_terms = _str_array(fixed.PLAIN_DEFAULT_SUBREDDITS), F.array(e)
        d_comp, d_kw = F.array().cast("array<string>"), F.array(F.lower(e))
    else:
        raise ValueError(f"unknown default {default!r}")
    return j.select(
        *[F.col(c) for c in entities.columns],
        F.when(hit, F.col("_c_subs")).otherwise(d_subs).alias("subreddits"),
        F.when(hit, F.col("_c_terms")).otherwise(d_terms).alias("search_terms"),
        F.when(hit, F.col("_c_comp")).otherwise(d_comp).alias("companies"),
        F.when(hit, F.col("_c_kw")).otherwise(d_kw).alias("keywords"),
        hit.alias("configured"),
    )


# ----------------------------------------------------------------------------- B3
def search_plan(cfg: DataFrame, keep: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Every subreddit x every search term of an entity, with nested positions."""
    subs = cfg.select(*keep, "search_terms", F.posexplode("subreddits").alias("sub_pos", "subreddit"))
    return subs.select(*keep, "sub_pos", "subreddit",
                       F.posexplode("search_terms").alias("term_pos", "search_term"))


# ----------------------------------------------------------------------------- B4
def resolve_symbols(entities: DataFrame, config: DataFrame, entity_col: str = "entity") -> DataFrame:
    """Ticker list per entity — configured companies, else the default ticker.

    Returns one row per (entity row, symbol) with ``symbol_pos`` (request order); an entity
    with an empty company list keeps one row without a symbol.
    """
    cfg = config.select(F.col("entity").alias("_cfg_key"), F.col("companies").alias("_c_comp"))
    j = entities.join(cfg, F.lower(F.col(entity_col)) == F.col("_cfg_key"), "left")
    symbols = F.coalesce(F.col("_c_comp"), _str_array([fixed.DEFAULT_SYMBOL]))
    return j.select(*[F.col(c) for c in entities.columns],
                    F.posexplode_outer(symbols).alias("symbol_pos", "symbol"))


# ----------------------------------------------------------------------------- B5
def timeframe_window(tf: Column) -> Column:
    """Timeframe code -> forum window name (unknown -> 'week')."""
    m = F.create_map(*[x for k, v in fixed.TIMEFRAME_WINDOWS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, tf), F.lit(fixed.DEFAULT_TIMEFRAME_WINDOW))


# ----------------------------------------------------------------------------- B6
def window_days(window: Column, strict_compat: bool = False) -> Column:
    """Window name -> days. ``strict_compat`` reproduces keying on lower(code) with
    every '1' removed (so '1w', '1mo', '1y' fall to 7 days); default maps the code
    through B5 first."""
    key = F.replace(F.lower(window), F.lit("1"), F.lit("")) if strict_compat else timeframe_window(window)
    m = F.create_map(*[x for k, v in fixed.WINDOW_DAYS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, key), F.lit(fixed.DEFAULT_WINDOW_DAYS))


def cutoff(anchor: Column, days: Column) -> Column:
    return anchor - F.make_dt_interval(days)


# ----------------------------------------------------------------------------- B7
def news_query(entity: Column) -> Column:
    """Conjunctive normal form (array of OR-groups) of the news search, lower-cased."""
    iron = F.array(*[_str_array(group) for group in fixed.IRON_NEWS_QUERY])
    return F.when(F.lower(entity) == "iron", iron).otherwise(F.array(F.array(F.lower(entity))))
