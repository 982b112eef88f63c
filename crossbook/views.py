"""Views over the star-schema tables with the shapes of the market tables. The SQL text runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS = """
SELECT event_id AS tick_id, ts AS observed_at,
  CASE user_id % 3 WHEN 0 THEN 'nfl' WHEN 1 THEN 'cfb' ELSE 'tennis' END AS sport,
  CASE WHEN user_id % 3 = 0 THEN 'pro' WHEN user_id % 3 = 1 THEN 'college'
       WHEN user_id % 12 = 2 THEN 'atp' WHEN user_id % 12 = 5 THEN 'wta'
       WHEN user_id % 12 = 8 THEN 'itf' ELSE 'challenger' END AS level,
  '2024-02-' || lpad(CAST(1 + user_id % 28 AS STRING), 2, '0') AS game_date,
  'a' || CAST(user_id AS STRING) AS team_a, 'b' || CAST(user_id AS STRING) AS team_b,
  CASE WHEN value < 2 THEN NULL ELSE 1 - floor((value - 40) * 10) / CAST(10000 AS DOUBLE) END AS best_cost,
  CASE WHEN value < 2 THEN NULL ELSE floor((value - 40) * 10) / CAST(10000 AS DOUBLE) END AS best_edge,
  CASE WHEN value >= 2 AND floor((value - 40) * 10) > 0 THEN 1 ELSE 0 END AS is_arb,
  event_type AS best_trade,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS closed,
  CASE WHEN user_id % 50 = 0 THEN NULL WHEN extract(day FROM ts) BETWEEN 11 AND 20 THEN 1 ELSE 0 END AS live,
  CASE WHEN user_id % 50 = 0 THEN NULL WHEN extract(day FROM ts) > 27 THEN 1 ELSE 0 END AS ended
FROM events"""

_SIZE = "CASE ascii(substr(team_a, length(team_a), 1)) % 3 WHEN 0 THEN CAST(0.01 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END"
BOOK_TICKS = f"""
SELECT tick_id, observed_at, sport, level, game_date, team_a, team_b, best_cost, best_edge,
  CASE WHEN is_arb = 1 AND closed = 0 THEN 1 ELSE 0 END AS is_exec, best_trade,
  (1 + tick_id % 97) * {_SIZE} AS exec_qty,
  CASE WHEN is_arb = 1 AND closed = 0 THEN (1 + tick_id % 97) * {_SIZE} * best_edge ELSE CAST(0 AS DOUBLE) END AS exec_profit,
  live, ended
FROM v_ticks WHERE best_edge IS NOT NULL"""

LEVELS = """
SELECT l_partkey AS match_id, CASE WHEN l_linenumber % 2 = 1 THEN 'L' ELSE 'R' END AS side,
  round(CAST(0.38 AS DOUBLE) + (l_partkey % 5) * CAST(0.04 AS DOUBLE) + l_discount + l_tax, 4) AS price, sum(l_quantity) AS qty
FROM lineitem GROUP BY 1, 2, 3"""

GAMES = """
SELECT o_orderkey AS ord,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'K' ELSE 'P' END AS venue,
  least(CAST(c_nationkey AS BIGINT), o_custkey % 25) AS ta, greatest(CAST(c_nationkey AS BIGINT), o_custkey % 25) AS tb,
  CAST(o_orderdate AS DATE) AS game_date, o_custkey AS ck
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> o_custkey % 25"""

LISTINGS = """
SELECT venue, ord * 2 AS src_ord, 't' || lpad(CAST(ta AS STRING), 2, '0') AS team,
  't' || lpad(CAST(tb AS STRING), 2, '0') AS opponent, game_date,
  CAST(2 + (ord * 7 + ck * 13) % 60 AS DOUBLE) / 100 AS yes_price, 'm' || CAST(ord AS STRING) AS market_id FROM v_games
UNION ALL
SELECT venue, ord * 2 + 1, 't' || lpad(CAST(tb AS STRING), 2, '0'), 't' || lpad(CAST(ta AS STRING), 2, '0'), game_date,
  CASE WHEN ord % 41 = 0 THEN NULL ELSE CAST(2 + (ord * 11 + ck * 17 + 31) % 60 AS DOUBLE) / 100 END, 'm' || CAST(ord AS STRING) FROM v_games"""

#: Each view with the views and tables it reads.
VIEWS = {
    "v_ticks": (TICKS, ("events",)),
    "v_book_ticks": (BOOK_TICKS, ("v_ticks",)),
    "v_levels": (LEVELS, ("lineitem",)),
    "v_games": (GAMES, ("orders", "customer")),
    "v_listings": (LISTINGS, ("v_games",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a table) of the folder. Inputs are passed to Spark SQL as DataFrames, so no session names are used up."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, inputs = VIEWS[name]
    for x in inputs:
        sql = sql.replace(f"FROM {x}", f"FROM {{{x}}}").replace(f"JOIN {x} ", f"JOIN {{{x}}} ")
    df = spark.sql(sql, **{x: view(spark, sf_dir, x) for x in inputs})
    if dict(df.dtypes).get("observed_at") == "timestamp_ntz":  # the stored times have no zone; they are UTC
        df = df.withColumn("observed_at", F.expr("make_timestamp(year(observed_at), month(observed_at), day(observed_at), hour(observed_at), minute(observed_at), extract(second FROM observed_at), 'UTC')"))
    return df


def cte(*names: str) -> str:
    """The views as common table expressions, in order of need."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for x in VIEWS[name][1]:
                need(x)
            order.append(name)

    for n in names:
        need(n)
    return ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in order)
