"""Configuration queries over analysis requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from brieflane import fixed
from brieflane.operators import config as cfgops
from brieflane.plans import api
from brieflane.plans.oracle_views import (register_view, sql_gen_keywords, sql_gen_subreddits,
                                          sql_gen_terms, sql_window, sql_window_days, str_list, with_views)
from brieflane.plans.registry import query
from brieflane.sources import fixtures as fx

register_view("requests", ("analyzed",), f"""
  SELECT p_partkey AS request_id, p_name AS entity,
         {str_list(fx.REQUEST_TIMEFRAMES)}[(p_size % {len(fx.REQUEST_TIMEFRAMES)}) + 1] AS timeframe
  FROM part
  UNION ALL
  SELECT CAST(-entity_pos - 1 AS BIGINT), entity, timeframe FROM analyzed""")

register_view("req_lookup", ("requests", "entity_config"), f"""
  SELECT r.request_id, r.entity, r.timeframe,
         CASE WHEN c.entity IS NOT NULL THEN c.subreddits ELSE {sql_gen_subreddits('r.entity')} END AS subreddits,
         CASE WHEN c.entity IS NOT NULL THEN c.search_terms ELSE {sql_gen_terms('r.entity')} END AS search_terms,
         CASE WHEN c.entity IS NOT NULL THEN c.companies ELSE {str_list(fixed.GENERATED_COMPANIES)} END AS companies,
         CASE WHEN c.entity IS NOT NULL THEN c.keywords ELSE {sql_gen_keywords('r.entity')} END AS keywords,
         c.entity IS NOT NULL AS configured
  FROM requests r LEFT JOIN entity_config c ON lower(r.entity) = c.entity""")


def _requests(spark, sf_dir):
    return fx.entity_requests(spark, sf_dir)


def _joined(c, sep):
    return F.array_join(c, sep)


@query("config_lookup", with_views(["req_lookup"], """
SELECT request_id, entity, configured,
       array_to_string(subreddits, ',') AS subreddits, array_to_string(search_terms, '|') AS search_terms,
       array_to_string(companies, ',') AS companies, array_to_string(keywords, '|') AS keywords
FROM req_lookup"""))
def config_lookup(spark, sf_dir):
    """B1: case-folded lookup of every request's configuration, generated on a miss."""
    c = cfgops.config_lookup(_requests(spark, sf_dir), fx.config_table(spark))
    return c.select("request_id", "entity", "configured",
                    _joined("subreddits", ",").alias("subreddits"), _joined("search_terms", "|").alias("search_terms"),
                    _joined("companies", ",").alias("companies"), _joined("keywords", "|").alias("keywords"))


@query("config_generate", with_views(["requests"], f"""
SELECT entity,
       array_to_string({sql_gen_subreddits('entity')}, ',') AS subreddits,
       array_to_string({sql_gen_terms('entity')}, '|') AS search_terms,
       array_to_string({str_list(fixed.GENERATED_COMPANIES)}, ',') AS companies,
       array_to_string({sql_gen_keywords('entity')}, '|') AS keywords
FROM (SELECT DISTINCT entity FROM requests)"""))
def config_generate(spark, sf_dir):
    """B2: generated configuration for every distinct requested entity."""
    g = cfgops.generate_config(_requests(spark, sf_dir).select("entity").distinct())
    return g.select("entity", _joined("subreddits", ",").alias("subreddits"),
                    _joined("search_terms", "|").alias("search_terms"),
                    _joined("companies", ",").alias("companies"), _joined("keywords", "|").alias("keywords"))


@query("search_plan", with_views(["req_lookup"], """
WITH s AS (SELECT request_id, entity, search_terms, unnest(subreddits) AS subreddit,
                  generate_subscripts(subreddits, 1) - 1 AS sub_pos FROM req_lookup)
SELECT request_id, entity, CAST(sub_pos AS INTEGER) AS sub_pos, subreddit,
       CAST(generate_subscripts(search_terms, 1) - 1 AS INTEGER) AS term_pos, unnest(search_terms) AS search_term
FROM s"""))
def search_plan(spark, sf_dir):
    """Every subreddit x every search term per request, nested order kept."""
    c = cfgops.config_lookup(_requests(spark, sf_dir), fx.config_table(spark))
    return cfgops.search_plan(c, keep=("request_id", "entity")).select(
        "request_id", "entity", "sub_pos", "subreddit", "term_pos", "search_term")


@query("resolve_symbols", with_views(["requests", "entity_config"], f"""
WITH j AS (SELECT r.request_id, r.entity, coalesce(c.companies, {str_list([fixed.DEFAULT_SYMBOL])}) AS syms
           FROM requests r LEFT JOIN entity_config c ON lower(r.entity) = c.entity)
SELECT request_id, entity, CAST(generate_subscripts(syms, 1) - 1 AS INTEGER) AS symbol_pos, unnest(syms) AS symbol
FROM j"""))
def resolve_symbols(spark, sf_dir):
    """Configured companies per request, else the default ticker."""
    return cfgops.resolve_symbols(_requests(spark, sf_dir), fx.config_table(spark)).select(
        "request_id", "entity", "symbol_pos", "symbol")


@query("timeframe_map", with_views(["requests"], f"""
SELECT request_id, timeframe, {sql_window('timeframe')} AS window FROM requests"""))
def timeframe_map(spark, sf_dir):
    """Timeframe code -> time window per request."""
    r = _requests(spark, sf_dir)
    return r.select("request_id", "timeframe", cfgops.timeframe_window(F.col("timeframe")).alias("window"))


@query("timeframe_cutoff", with_views(["requests", "anchor"], f"""
SELECT request_id, timeframe, CAST({sql_window_days('timeframe')} AS INTEGER) AS days,
       CAST({sql_window_days('timeframe', True)} AS INTEGER) AS compat_days,
       anchor_ts - to_days(CAST({sql_window_days('timeframe')} AS INTEGER)) AS cutoff_ts
FROM requests CROSS JOIN anchor"""))
def timeframe_cutoff(spark, sf_dir):
    """Window length and cutoff before the anchor (latest post) per request; also
    the compatibility reading that strips '1' from the code."""
    r = _requests(spark, sf_dir)
    anchor = api.anchor_of(fx.posts(spark, sf_dir), "created_utc")
    days = cfgops.window_days(F.col("timeframe"))
    return r.select("request_id", "timeframe", days.alias("days"),
                    cfgops.window_days(F.col("timeframe"), strict_compat=True).alias("compat_days"),
                    cfgops.cutoff(anchor, days).alias("cutoff_ts"))

