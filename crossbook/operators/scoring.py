"""Cost of buying both teams across venues, from listed prices and from quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .outcomes import poly_outcome_prices

PRICES = ("kalshi_yes_a", "poly_yes_a", "kalshi_yes_b", "poly_yes_b")


def _scored(df: DataFrame) -> DataFrame:
    ka, pa, kb, pb = (F.col(c) for c in PRICES)
    first, second = ka + pb, pa + kb
    best = F.least(first, second)
    priced = first.isNotNull() & second.isNotNull()
    buy = lambda a, b: F.concat(F.lit("buy "), F.col("team_a"), F.lit(f" {a} YES + "), F.col("team_b"), F.lit(f" {b} YES"))
    trade = F.when(first <= second, buy("Kalshi", "Polymarket")).otherwise(buy("Polymarket", "Kalshi"))
    given = lambda c: F.when(priced, c)
    return df.withColumns({
        "team_a_price_diff": F.round(pa - ka, 4), "team_b_price_diff": F.round(pb - kb, 4), "kalshi_a_plus_poly_b": F.round(first, 4), "poly_a_plus_kalshi_b": F.round(second, 4),
        "best_cost": given(F.round(best, 4)), "best_edge": given(F.round(1.0 - best, 4)), "is_arb": F.coalesce(given((1.0 - best > 0).cast("int")), F.lit(0)), "best_trade": given(trade),
    })


def score_arbs(matches: DataFrame) -> DataFrame:
    """Matches with all four prices, scored; an arb costs under 1 before rounding."""
    return _scored(matches.where(" and ".join(f"{c} is not null" for c in PRICES)))


def quote_matches(matches: DataFrame, k_quotes: DataFrame, p_quotes: DataFrame) -> DataFrame:
    """match_quotes of both venues' quotes: of tickers (with yes), and of markets (with outcomes and prices)."""
    k = k_quotes.select("observed_at", F.lit("k").alias("venue"), F.col("ticker").alias("id"), "yes", "closed")
    p = p_quotes.select("observed_at", F.lit("p").alias("venue"), F.col("market_id").alias("id"), "closed", "outcomes", "prices")
    return match_quotes(matches, k.unionByName(p, allowMissingColumns=True))


def match_quotes(matches: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each match with the prices quoted at each observed_at; without all four it stays only if a venue has closed it.

    quotes: as landed.line_quotes. All of them meet the matches' ids in one join, and one shuffle on the match puts the venues' quotes and
    the match together. Quotes come from exploded payloads, whose size Spark can't tell, so the joins are merge joins."""
    m = matches.drop(*PRICES)
    key = ["team_a", "team_b", "game_date", "sport"]  # what differs most comes first, as sorts compare in this order
    ids = [F.struct(F.lit(venue).alias("venue"), F.col(c).alias("id"), F.lit(side).alias("side")) for venue, c, side in (("k", "kalshi_id_a", "a"), ("k", "kalshi_id_b", "b"), ("p", "poly_id", "p"))]
    sides = quotes.join(m.select(*key, F.inline(F.array(*ids))).hint("merge"), ["id", "venue"])
    sides = poly_outcome_prices(sides).select(
        *key, "observed_at", "closed", F.when(F.col("side") == "a", F.col("yes")).alias("kalshi_yes_a"), F.when(F.col("side") == "b", F.col("yes")).alias("kalshi_yes_b"),
        F.when(F.col("side") == "p", F.col("yes_a")).alias("poly_yes_a"), F.when(F.col("side") == "p", F.col("yes_b")).alias("poly_yes_b"),
    )
    quoted = sides.repartition(*key).groupBy(*key, "observed_at").agg(*[F.max(c).alias(c) for c in PRICES], F.coalesce(F.bool_or("closed"), F.lit(False)).cast("int").alias("closed"))
    quoted = quoted.where("closed = 1 or (" + " and ".join(f"{c} is not null" for c in PRICES) + ")")
    return quoted.join(m.hint("merge"), key)


def score_quotes(quotes: DataFrame) -> DataFrame:
    """Price ticks: scored quotes; closed or unpriced rows pass through with null cost and edge."""
    return _scored(quotes)
