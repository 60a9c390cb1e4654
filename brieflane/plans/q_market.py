"""Market queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brieflane import fixed
from brieflane.operators import config as cfgops
from brieflane.operators import market
from brieflane.plans import api
from brieflane.plans.oracle_views import lit, register_view, str_list, with_views
from brieflane.plans.registry import query
from brieflane.sources import fixtures as fx
from brieflane.sources import ingest

register_view("quote_days", (), """
  SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS day,
         arg_max(value, ts) AS close, arg_max(event_type, ts) AS last_type, count(*) AS volume
  FROM events GROUP BY 1, 2""")

register_view("chart_parsed", ("quote_days",), """
  SELECT symbol, max(CASE WHEN rd = 1 AND last_type <> 'error' THEN close END) AS current_price,
         max(CASE WHEN rd = 2 THEN close END) AS previous_close,
         max(CASE WHEN rd = 1 THEN volume END) AS last_volume, count(*) AS n_bars
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rd FROM quote_days)
  GROUP BY symbol
  UNION ALL SELECT * FROM (VALUES ('BIG', CAST(1e17 AS DOUBLE), CAST(3e18 AS DOUBLE), 9, 1),
                                  ('TWICE', CAST(2.675 AS DOUBLE), CAST(0.125 AS DOUBLE), 1200, 1))""")

register_view("req_symbols", ("analyzed", "entity_config"), f"""
  SELECT entity, timeframe, entity_pos, CAST(generate_subscripts(syms, 1) - 1 AS INTEGER) AS symbol_pos,
         unnest(syms) AS symbol
  FROM (SELECT a.*, coalesce(c.companies, {str_list([fixed.DEFAULT_SYMBOL])}) AS syms
        FROM analyzed a LEFT JOIN entity_config c ON lower(a.entity) = c.entity)""")

register_view("symbol_quotes", ("req_symbols", "chart_parsed"), f"""
  SELECT *, CASE WHEN status <> 200 THEN 'HTTP ' || CAST(status AS VARCHAR)
                 WHEN NOT ok THEN {lit(fixed.MISSING_PRICE)} END AS reason
  FROM (SELECT r.*, CASE WHEN p.symbol IS NULL THEN 404 ELSE 200 END AS status,
               p.current_price, p.previous_close, p.last_volume,
               (p.symbol IS NOT NULL AND coalesce(p.current_price, 0) <> 0
                AND coalesce(p.previous_close, 0) <> 0) AS ok
        FROM req_symbols r LEFT JOIN chart_parsed p USING (symbol))""")

_BLOCK = f"""CASE WHEN ok THEN concat_ws(chr(10),
      chr(10) || symbol || ':',
      'Current Price: $' || printf('%.2f', current_price),
      'Previous Close: $' || printf('%.2f', previous_close),
      'Change: ' || printf('%.1f', (current_price - previous_close) / previous_close * 100.0) || '%',
      CASE WHEN coalesce(last_volume, 0) <> 0 THEN 'Volume: ' || format('{{:,}}', last_volume) END,
      repeat('-', 30))
    ELSE chr(10) || 'Error analyzing ' || symbol || ': ' || reason END"""

register_view("market_reports", ("symbol_quotes",), f"""
  SELECT entity, timeframe, n_symbols, n_ok, n_ok > 0 AS data_available,
         CASE WHEN n_ok > 0 THEN concat_ws(chr(10),
              'Market Analysis for ' || entity || ' over ' || timeframe || ':', repeat('=', 50),
              chr(10) || 'Analyzing major ' || entity || ' companies: ' || symbols || chr(10),
              blocks,
              chr(10) || 'Summary:', repeat('=', 50),
              'Successfully analyzed ' || CAST(n_ok AS VARCHAR) || ' out of ' || CAST(n_symbols AS VARCHAR) || ' companies.',
              chr(10) || {lit(fixed.MARKET_NOTE)}) END AS analysis,
         CASE WHEN n_ok = 0 THEN 'Could not retrieve market data for any of the symbols: ' || symbols END AS error
  FROM (SELECT entity, timeframe, count(*) AS n_symbols, count(*) FILTER (WHERE ok) AS n_ok,
               string_agg(symbol, ', ' ORDER BY symbol_pos) AS symbols,
               string_agg({_BLOCK}, chr(10) ORDER BY symbol_pos) AS blocks
        FROM symbol_quotes GROUP BY entity, entity_pos, timeframe)""")


def symbol_quotes(spark, sf_dir):
    req = cfgops.resolve_symbols(fx.analyzed_entities(spark), fx.config_table(spark))
    return market.symbol_quotes(req, fx.chart_responses(spark, sf_dir))


@query("ingest_quotes", with_views(["chart_parsed"], """
SELECT symbol, current_price, previous_close, last_volume, n_bars FROM chart_parsed
UNION ALL SELECT 'TWICE', NULL, NULL, NULL, 0"""))
def ingest_quotes(spark, sf_dir):
    """Every chart response parsed to price, previous close and last volume."""
    return ingest.parse_charts(fx.chart_responses(spark, sf_dir)).where(F.col("status") == 200).select(
        "symbol", "current_price", "previous_close", "last_volume", "n_bars")


@query("quote_status", with_views(["symbol_quotes"], """
SELECT entity, symbol_pos, symbol, status, reason FROM symbol_quotes"""))
def quote_status(spark, sf_dir):
    """A10: per requested symbol, response status and the error text when unusable."""
    return symbol_quotes(spark, sf_dir).select("entity", "symbol_pos", "symbol", "status", "reason")


@query("quote_change", with_views(["chart_parsed"], """
SELECT symbol, current_price, previous_close,
       round((current_price - previous_close) / previous_close * 100.0, 6) AS change_pct
FROM chart_parsed WHERE coalesce(current_price, 0) <> 0 AND coalesce(previous_close, 0) <> 0"""))
def quote_change(spark, sf_dir):
    """C2 + F3: percent change for every symbol whose prices are both truthy."""
    q = ingest.parse_charts(fx.chart_responses(spark, sf_dir))
    q = q.where(market.truthy(F.col("current_price")) & market.truthy(F.col("previous_close")))
    return q.select("symbol", "current_price", "previous_close",
                    F.round(market.pct_change(F.col("current_price"), F.col("previous_close")), 6).alias("change_pct"))


@query("market_coverage", with_views(["market_reports"], """
SELECT entity, n_symbols, n_ok, data_available FROM market_reports"""))
def market_coverage(spark, sf_dir):
    """G2 + G3: symbols analysed out of symbols requested, and the any-data flag."""
    return market.market_reports(symbol_quotes(spark, sf_dir)).select("entity", "n_symbols", "n_ok", "data_available")


@query("market_report", with_views(["market_reports"], """
SELECT entity, timeframe, n_symbols, n_ok, data_available, analysis, error FROM market_reports"""))
def market_report(spark, sf_dir):
    """I2, H4 + H9: the market report row per entity (text in symbol order, or an error)."""
    return api.analyze_markets(fx.analyzed_entities(spark), fx.config_table(spark), fx.chart_responses(spark, sf_dir))


register_view("ticks", (), """
  SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, ts, max(value) AS price
  FROM events WHERE event_type NOT IN ('signup', 'error') GROUP BY 1, 2""")
register_view("quote_asks", (), """
  SELECT event_id, 'U' || CAST(user_id AS VARCHAR) AS symbol, ts AS at, date_trunc('day', ts) AS today
  FROM events WHERE event_type = 'signup'""")


@query("quote_asof", with_views(["ticks", "quote_asks"], """
SELECT a.event_id, a.symbol, a.at, t.price AS current_price, t.ts AS price_ts, p.price AS previous_close,
       CASE WHEN coalesce(t.price, 0) <> 0 AND coalesce(p.price, 0) <> 0
            THEN round((t.price - p.price) / p.price * 100.0, 6) END AS change_pct
FROM quote_asks a ASOF LEFT JOIN ticks t ON a.symbol = t.symbol AND a.at >= t.ts
ASOF LEFT JOIN ticks p ON a.symbol = p.symbol AND a.today > p.ts"""))
def quote_asof(spark, sf_dir):
    """A6 + F3 at an anchor: for every asked (symbol, time), the last price then, the last price of
    an earlier day, and the change."""
    return market.quotes_at(fx.quote_asks(spark, sf_dir), fx.quote_ticks(spark, sf_dir))
