"""Quotes: status, percent change, coverage and the market report.

Quotes arrive as one chart response per symbol; requested symbols are joined to them
(missing response = HTTP 404). Everything per entity is an aggregate over at most its
symbol list, built in symbol (request) order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflane import fixed
from brieflane.operators import asof
from brieflane.sources import ingest


def truthy(x: Column) -> Column:
    """Python truthiness of a number — null and 0 are false."""
    return F.coalesce(x, F.lit(0)) != 0


def pct_change(cur: Column, prev: Column) -> Column:
    """(cur - prev) / prev * 100."""
    return (cur - prev) / prev * F.lit(100.0)


#: Doubles from here on are whole numbers; from the second on, a long does not hold their upper part.
WHOLE, WIDE = 2.0 ** 62, 2.0 ** 125


def bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` as a lambda's variable: it is computed once, and the expression
    holds it once."""
    return F.get(F.transform(F.array(value), then), 0)


def whole_digits(a: Column) -> Column:
    """A whole double that is not negative, in full (2.0 ** 70 is 1180591620717411303424), up to
    2 ** 125; beyond, with a double's shortest digits."""
    def wide(high: Column) -> Column:  # dividing by a power of two is exact
        low = (a - high.cast("double") * WHOLE).cast("bigint").cast("decimal(19,0)")
        return (high.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + low).cast("decimal(38,0)").cast("string")

    return (F.when(a < WHOLE, a.cast("bigint").cast("string"))
            .when(a < WIDE, bound(F.floor(F.when(a < WIDE, a) / WHOLE).cast("bigint"), wide))
            .otherwise(F.format_string("%.0f", a)))


def fixed_decimals(x: Column, digits: int) -> Column:
    """``x`` with ``digits`` decimals (one at least), rounded as its exact binary value lies
    between the two neighbours (2.675 is below the middle: 2.67), to the even one in the very middle
    (0.125: 0.12). Infinities and NaN print as ``inf``, ``-inf`` and ``nan``."""
    scale = 10 ** digits

    def hundredths(r: Column) -> Column:
        """``r`` (0 <= r < 1, exact) in units of the last digit."""
        # r = high + low, high with so few bits that its product with 2 * scale is exact
        c = r * F.lit(134217729.0)
        high = c - (c - r)
        return bound(F.floor(r * F.lit(float(scale))).cast("bigint"), lambda k: bound(
            (high * F.lit(2.0 * scale) - (2 * k + 1).cast("double")) + (r - high) * F.lit(2.0 * scale),
            lambda side: k + F.when((side > 0) | ((side == 0) & (k % 2 == 1)), 1).otherwise(0)))

    def number(a: Column) -> Column:
        return bound(F.when(a < WHOLE, F.floor(F.when(a < WHOLE, a)).cast("double")).otherwise(a), lambda whole: bound(
            hundredths(a - whole), lambda n: F.concat(
                bound(whole + F.when(n >= scale, 1.0).otherwise(0.0), whole_digits), F.lit("."),
                F.lpad((n % scale).cast("string"), digits, "0"))))

    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(x), F.lit("nan")).when(finite, F.concat(sign, bound(F.abs(x), number))).when(
        x.isNotNull(), F.concat(sign, F.lit("inf")))


def symbol_quotes(requested: DataFrame, charts: DataFrame) -> DataFrame:
    """Requested symbols with their parsed quote, status and outcome.

    Adds status (404 when no response landed), current_price, previous_close,
    last_volume, ok (both prices truthy) and reason (error text when not ok).
    """
    parsed = (ingest.one_chart_each(ingest.parse_charts(charts)).drop("n_bars")
              .withColumn("_landed", F.lit(True)).withColumnRenamed("status", "_status"))
    j = requested.join(parsed, "symbol", "left")
    status = F.when(F.col("_landed"), F.col("_status")).otherwise(F.lit(404))
    ok = status.eqNullSafe(200) & truthy(F.col("current_price")) & truthy(F.col("previous_close"))
    reason = (F.when(~status.eqNullSafe(200), F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("without status"))))
              .when(F.coalesce(F.col("malformed"), F.lit(False)), F.lit(fixed.MALFORMED_RESPONSE))
              .when(~ok, F.lit(fixed.MISSING_PRICE)))
    return (j.withColumn("status", status).withColumn("ok", ok).withColumn("reason", reason)
            .drop("_status", "_landed", "malformed"))


def quotes_at(asks: DataFrame, ticks: DataFrame, unit: str = "day") -> DataFrame:
    """Quote snapshots: ``asks`` (symbol, at, ...) with the last price of ``ticks`` (symbol, ts, price)
    at that time, the last one of an earlier day (previous close) and the percent change (C2, F3)."""
    now = asof.asof_join(asks, ticks, ["symbol"], "at", "ts", {"price": "current_price", "ts": "price_ts"}, unit)
    day = now.withColumn("_today", F.date_trunc("day", "at"))
    both = asof.asof_join(day, ticks, ["symbol"], "_today", "ts", {"price": "previous_close"}, unit, strict=True).drop("_today")
    known = truthy(F.col("current_price")) & truthy(F.col("previous_close"))
    return both.withColumn("change_pct", F.when(known, F.round(pct_change(F.col("current_price"), F.col("previous_close")), 6)))


def symbol_block(symbol: Column, cur: Column, prev: Column, vol: Column, ok: Column, reason: Column) -> Column:
    """H4 per-symbol text: price lines (+ volume when the last bar's volume is truthy),
    or an error line."""
    good = F.concat_ws(
        "\n",
        F.concat(F.lit("\n"), symbol, F.lit(":")),
        F.concat(F.lit("Current Price: $"), fixed_decimals(cur, 2)),
        F.concat(F.lit("Previous Close: $"), fixed_decimals(prev, 2)),
        F.concat(F.lit("Change: "), fixed_decimals(pct_change(cur, prev), 1), F.lit("%")),
        F.when(truthy(vol), F.concat(F.lit("Volume: "), F.format_number(vol, 0))),
        F.repeat(F.lit("-"), 30))
    bad = F.concat(F.lit("\nError analyzing "), symbol, F.lit(": "), reason)
    return F.when(ok, good).otherwise(bad)


def market_reports(quotes: DataFrame) -> DataFrame:
    """H4 + H9 + G2 + G3: one row per entity (entity, timeframe) from its symbol rows."""
    q = quotes.withColumn("block", symbol_block(F.col("symbol"), F.col("current_price"), F.col("previous_close"),
                                                F.col("last_volume"), F.col("ok"), F.col("reason")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("symbol_pos", c))),
                                    lambda s: s[c])
    keys = [c for c in ("entity", "entity_pos", "timeframe") if c in q.columns]
    g = q.groupBy(*keys).agg(
        F.count("symbol").alias("n_symbols"), F.count_if("ok").alias("n_ok"),
        F.array_join(ordered("symbol"), ", ").alias("symbols"),
        F.array_join(ordered("block"), "\n").alias("blocks"))
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("Market Analysis for "), F.col("entity"), F.lit(" over "), F.col("timeframe"), F.lit(":")),
        F.repeat(F.lit("="), 50),
        F.concat(F.lit("\nAnalyzing major "), F.col("entity"), F.lit(" companies: "), F.col("symbols"), F.lit("\n")))
    summary = F.concat_ws(
        "\n", F.lit("\nSummary:"), F.repeat(F.lit("="), 50),
        F.concat(F.lit("Successfully analyzed "), F.col("n_ok").cast("string"), F.lit(" out of "),
                 F.col("n_symbols").cast("string"), F.lit(" companies.")),
        F.lit("\n" + fixed.MARKET_NOTE))
    available = F.col("n_ok") > 0
    return g.select(
        "entity", "timeframe", "n_symbols", "n_ok", available.alias("data_available"),
        F.when(available, F.concat_ws("\n", header, F.col("blocks"), summary)).alias("analysis"),
        F.when(~available, F.concat(F.lit("Could not retrieve market data for any of the symbols: "),
                                    F.col("symbols"))).alias("error"))
