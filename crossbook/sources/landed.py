"""Readers of landed JSON (listings, quotes, order books) and of the engine's own tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import json_array, kalshi_closed, parse_price, parse_ts, poly_closed, truthy

K_MARKET = "ticker string, yes_sub_title string, status string, yes_ask_dollars string, last_price_dollars string, volume_fp string, close_time string, expected_expiration_time string"
K_EVENT = f"event_ticker string, title string, markets array<struct<{K_MARKET.replace(' string', ': string')}>>"
_K_EVENT_STRUCT = f"event_ticker: string, title: string, markets: array<struct<{K_MARKET.replace(' string', ': string')}>>"
_P_MARKET = "id: string, slug: string, sportsMarketType: string, closed: string, active: string, outcomes: string, outcomePrices: string, clobTokenIds: string, volume: string, endDate: string"
P_EVENT = f"id string, slug string, title string, sport string, teams array<struct<name: string, alias: string, abbreviation: string>>, live string, ended string, endDate string, startDate string, markets array<struct<{_P_MARKET}>>"

TICK = "tick_id long, observed_at timestamp, sport string, level string, game_date string, team_a string, team_b string, kalshi_yes_a double, kalshi_yes_b double, poly_yes_a double, poly_yes_b double, best_cost double, best_edge double, is_arb int, best_trade string, closed int, live int, ended int"
BOOK_TICK = "tick_id long, observed_at timestamp, sport string, level string, game_date string, team_a string, team_b string, best_cost double, best_edge double, is_exec int, best_trade string, exec_qty double, exec_profit double, live int, ended int"
MATCH_COLUMNS = (
    "sport", "level", "game_date", "poly_game_date", "team_a", "team_b", "kalshi_event", "polymarket_event", "kalshi_event_id", "kalshi_id_a", "kalshi_id_b",
    "poly_id", "poly_event_id", "poly_token_a", "poly_token_b", "kalshi_url", "polymarket_url", "live", "ended",
)


def _page() -> Column:
    """The order in which pages were fetched: the number of a landed file's folder (page=3), or at the end of its name."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/page=(\d+)/", 1).try_cast("long")
    return F.coalesce(folder, F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).try_cast("long"), F.lit(0))


def page_lines(events: DataFrame, before: str, after: str) -> DataFrame:
    """Lines (page, value) of pages: an event each, with before at a page's first and after at its last."""
    w = Window.partitionBy("page").orderBy("event_pos")
    lines = events.withColumns({"first": F.row_number().over(w) == 1, "last": F.lead(F.lit(1)).over(w).isNull()})
    value = F.coalesce("value", F.lit("null"))  # no filter on a text, which Spark would make a second time for it, before the shuffle
    text = F.concat(F.when(F.col("first"), before).otherwise(", "), value, F.when(F.col("last"), after).otherwise(""))
    return lines.select("page", text.alias("value"))


def land_pages(events: DataFrame, folder: str, before: str = "[", after: str = "]") -> None:
    """Lands events (page, event_pos, value: JSON) as the venues' pages, each a compressed file in a folder page=<number>: before, the
    events, after. A page is written as its events come; those that come dealt by page and sorted are not shuffled or sorted again."""
    page_lines(events, before, after).write.mode("append").partitionBy("page").text(folder, compression="gzip")


def src_ord(page: Column, event: Column, market: Column) -> Column:
    """Arrival order of a row: page, event, market."""
    return page * 100_000_000 + event.cast("long") * 10_000 + market.cast("long")


def _structs(ddl: str) -> str:
    """The fields of a table as those of a struct."""
    return f"struct<{re.sub(r'(^|, )([A-Za-z_]+) (string|array|struct)', r'\1\2: \3', ddl)}>"


def _whole_files(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """(page, pos, e) of files that hold one JSON object or an array of them, over several lines or in one. Spark's reader of multi-line
    JSON opens a file again for each value that isn't a text (a flag, a number, an object) where the schema asks for one; a text that is
    parsed has them at hand, and gives an array's places besides."""
    texts = spark.read.schema("value string").text(path, wholetext=True).select(_page().alias("page"), "value")
    return texts.select("page", F.posexplode(F.from_json("value", f"array<{_structs(ddl)}>")).alias("pos", "e"))


def read_kalshi_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of landed pages {events: [...], cursor}: page, event_pos and the event's fields."""
    pages = _whole_files(spark, path, f"events array<struct<{_K_EVENT_STRUCT}>>, cursor string")
    return pages.select("page", F.posexplode("e.events").alias("event_pos", "e")).select("page", "event_pos", "e.*")


def read_poly_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of landed pages [...]: page, event_pos and the event's fields. Arrays inside may be real or JSON texts."""
    return _whole_files(spark, path, P_EVENT).select("page", F.col("pos").alias("event_pos"), "e.*")


K_BOOK = "ticker string, observed_at string, orderbook_fp struct<no_dollars: array<array<string>>>, orderbook struct<no: array<array<string>>>"
P_BOOK = "token_id string, observed_at string, asks array<struct<price: string, size: string>>"


def _books(spark: SparkSession, path: str, lines: bool, ddl: str) -> DataFrame:
    books = spark.read.schema(ddl).json(path) if lines else _whole_files(spark, path, ddl).select("e.*")
    return books.withColumn("observed_at", parse_ts(F.col("observed_at")))


def read_kalshi_books(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed books, one a file or (lines) one a line."""
    return _books(spark, path, lines, K_BOOK)


def read_poly_books(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _books(spark, path, lines, P_BOOK)


_K_QUOTE = K_MARKET.replace(" string", ": string")
K_QUOTE_SCHEMA = f"observed_at string, event struct<markets: array<struct<{_K_QUOTE}>>>, markets array<struct<{_K_QUOTE}>>, market struct<{_K_QUOTE}>"
P_QUOTE_SCHEMA = f"observed_at string, {_P_MARKET.replace(': string', ' string')}, market struct<{_P_MARKET}>"


def kalshi_quotes(raw: DataFrame) -> DataFrame:
    """(observed_at, ticker, yes, closed) of landed quotes: event payloads first, single markets for tickers not in them."""
    event = raw.select("observed_at", F.lit(0).alias("priority"), F.explode(F.coalesce("event.markets", "markets")).alias("m"))
    single = raw.where("market is not null").select("observed_at", F.lit(1).alias("priority"), F.col("market").alias("m"))
    df = event.unionByName(single).select(parse_ts(F.col("observed_at")).alias("observed_at"), "priority", "m.*").where(truthy(F.col("ticker")).isNotNull())
    # Every other column decides ties, so the choice doesn't depend on the order of files.
    order = ["priority", F.desc_nulls_last("yes_ask_dollars"), F.desc_nulls_last("last_price_dollars"), F.desc_nulls_last("status")]
    first = F.row_number().over(Window.partitionBy("observed_at", "ticker").orderBy(*order))
    yes = parse_price(F.coalesce(truthy(F.col("yes_ask_dollars")), F.col("last_price_dollars")))
    return df.withColumn("_n", first).where("_n = 1").select("observed_at", "ticker", yes.alias("yes"), kalshi_closed(F.col("status")).alias("closed"))


def read_kalshi_quotes(spark: SparkSession, path: str) -> DataFrame:
    return kalshi_quotes(spark.read.schema(K_QUOTE_SCHEMA).json(path))


def poly_quotes(raw: DataFrame) -> DataFrame:
    """(observed_at, market_id, outcomes, prices, closed) of landed markets: bare, or wrapped in `market`."""
    wrapped = F.col("id").isNull() & F.col("market").isNotNull()
    pick = lambda c: F.when(wrapped, F.col(f"market.{c}")).otherwise(F.col(c))
    return raw.select(
        parse_ts(F.col("observed_at")).alias("observed_at"), F.coalesce(pick("id"), pick("slug")).alias("market_id"), json_array(pick("outcomes")).alias("outcomes"),
        json_array(pick("outcomePrices")).alias("prices"), poly_closed(pick("closed"), pick("active")).alias("closed"),
    )


#: Landed quotes of either venue, one a line: those of the first as K_QUOTE_SCHEMA, of the second as P_QUOTE_SCHEMA with market as p_market.
QUOTE_LINE = f"venue string, {K_QUOTE_SCHEMA}, {P_QUOTE_SCHEMA.replace('observed_at string, ', '').replace(', market struct', ', p_market struct')}"


def line_quotes(raw: DataFrame) -> DataFrame:
    """Quotes (observed_at, venue, id, yes, closed, outcomes, prices) of lines (QUOTE_LINE) of both venues, each line read once: those of
    kalshi_quotes, by ticker, with yes, and of poly_quotes, by market, with outcomes and prices. Dealt by id and venue."""
    wrapped = F.col("id").isNull() & F.col("p_market").isNotNull()
    pick = lambda c: F.when(wrapped, F.col(f"p_market.{c}")).otherwise(F.col(c))
    none = F.array().cast(f"array<struct<{_K_QUOTE}>>")
    listed = F.coalesce("event.markets", "markets", none)
    first = F.concat(listed, F.when(F.col("market").isNotNull(), F.array("market")).otherwise(none))
    lines = raw.where("venue IN ('k', 'p')").select(
        "venue", parse_ts(F.col("observed_at")).alias("observed_at"), F.when(F.col("venue") == "p", F.struct(*[pick(c).alias(c) for c in ("id", "slug", "outcomes", "outcomePrices", "closed", "active")])).alias("p"),
        F.size(listed).alias("listed"), F.posexplode_outer(F.when(F.col("venue") == "k", first)).alias("pos", "m"),
    )
    rows = lines.select(
        F.when(F.col("venue") == "k", truthy(F.col("m.ticker"))).otherwise(F.coalesce("p.id", "p.slug")).alias("id"), "venue", "observed_at", (F.col("pos") >= F.col("listed")).alias("single"),
        "m.yes_ask_dollars", "m.last_price_dollars", "m.status", "p.outcomes", "p.outcomePrices", "p.closed", "p.active",
    ).where("id is not null")
    # A ticker's one quote of a time, as in kalshi_quotes; dealt by id, so that a join on it needs no other shuffle.
    order = ["single", F.desc_nulls_last("yes_ask_dollars"), F.desc_nulls_last("last_price_dollars"), F.desc_nulls_last("status")]
    n = F.row_number().over(Window.partitionBy("id", "venue", "observed_at").orderBy(*order))
    one = rows.repartition("id", "venue").withColumn("_n", n).where("_n = 1 or venue = 'p'")
    k = F.col("venue") == "k"
    return one.select(
        "observed_at", "venue", "id", F.when(k, parse_price(F.coalesce(truthy(F.col("yes_ask_dollars")), F.col("last_price_dollars")))).alias("yes"),
        F.when(k, kalshi_closed(F.col("status"))).otherwise(poly_closed(F.col("closed"), F.col("active"))).alias("closed"), json_array(F.col("outcomes")).alias("outcomes"), json_array(F.col("outcomePrices")).alias("prices"),
    )


def poly_quote_texts(texts: DataFrame) -> DataFrame:
    """Quotes of payloads (value): a market, {market: {...}}, or a list of which the first market counts."""
    text = F.when(F.col("value").rlike(r"^\s*\["), F.get_json_object("value", "$[0]")).otherwise(F.col("value"))
    return poly_quotes(texts.select(F.from_json(text, P_QUOTE_SCHEMA).alias("x")).where("x is not null").select("x.*"))


def read_poly_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quotes of landed payloads, one a line."""
    return poly_quote_texts(spark.read.text(path))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Price ticks with a timestamp; columns that older files lack are null. Windows order by (observed_at, tick_id)."""
    return _table(spark, path, TICK).where("observed_at is not null")


def read_book_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Book ticks, never closed and an arb where executable; empty where the table is absent."""
    df = _table(spark, path, BOOK_TICK).where("observed_at is not null")
    return df.withColumns({"closed": F.lit(0), "is_arb": (F.coalesce(F.col("is_exec"), F.lit(0)) != 0).cast("int")})


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*MATCH_COLUMNS)
