"""Events and books of both venues as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flag, iso_utc, json_array, local_date, parse_event_ticker, parse_price, parse_ts, slug_date, team_id, ticker_date, tour_level, truthy
from ..sources.landed import src_ord


def first_seen(events: DataFrame, key: Column) -> DataFrame:
    """The first row (by page and position) of each key; rows with an empty key all stay."""
    one = F.coalesce(truthy(key), F.concat_ws("#", F.lit("row"), F.col("page"), F.col("event_pos")))
    n = F.row_number().over(Window.partitionBy(one).orderBy("page", "event_pos"))
    return events.withColumn("_n", n).where("_n = 1").drop("_n")


def _first(names: Column, other_than: Column) -> Column:
    return F.get(F.filter(names, lambda n: n.isNotNull() & (n != other_than)), F.lit(0))


def with_defaults(df: DataFrame, sport: str, level: Column) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)
    return df.withColumns({"live": zero("live"), "ended": zero("ended"), "sport": F.lit(sport), "level": level})


def event_url(venue: str, event_id: Column, series: str = "") -> Column:
    if venue == "kalshi":
        return F.concat(F.lit(f"https://kalshi.com/markets/{series.lower()}/"), F.lower(event_id))
    return F.concat(F.lit("https://polymarket.com/event/"), event_id)


def kalshi_outcomes(events: DataFrame, sport: str, level: str, series: str) -> DataFrame:
    """One row a nested market with a known team."""
    nfl = sport == "nfl"
    suffix = lambda m: F.regexp_extract(m["ticker"], r"([^-]*)$", 1)
    own = (lambda m: F.coalesce(team_id(F.lit(sport), suffix(m)), team_id(F.lit(sport), m["yes_sub_title"]))) if nfl else (lambda m: team_id(F.lit(sport), m["yes_sub_title"]))
    sibling = (lambda m: team_id(F.lit(sport), suffix(m))) if nfl else own
    df = first_seen(events, F.col("event_ticker"))
    df = df.withColumns({"names": F.transform("markets", sibling), "decoded": parse_event_ticker(F.col("event_ticker")) if nfl else F.lit(None)})
    df = df.select("*", F.posexplode("markets").alias("pos", "m")).withColumn("team", own(F.col("m")) if nfl else F.get("names", F.col("pos"))).where("team is not null")
    opponent, when = _first(F.col("names"), F.col("team")), F.coalesce(truthy(F.col("m.close_time")), F.col("m.expected_expiration_time"))
    if nfl:
        opponent = F.coalesce(_first(F.col("decoded.teams"), F.col("team")), opponent)
        closes = F.filter(F.col("markets"), lambda m: truthy(m["close_time"]).isNotNull())
        date = F.coalesce(F.col("decoded.date").cast("string"), local_date(F.get(closes, F.lit(0))["close_time"]).cast("string"))
    else:
        date = F.coalesce(ticker_date(F.col("event_ticker")), local_date(when)).cast("string")
    out = df.select(
        F.lit("kalshi").alias("exchange"), F.col("m.ticker").alias("market_id"), F.coalesce("event_ticker", F.lit("")).alias("event_id"), F.coalesce(truthy(F.col("title")), F.col("event_ticker")).alias("event_title"), "team",
        F.coalesce(opponent, F.lit("")).alias("opponent"), parse_price(F.coalesce(truthy(F.col("m.yes_ask_dollars")), F.col("m.last_price_dollars"))).alias("yes_price"), parse_price(F.col("m.volume_fp")).alias("volume"),
        F.coalesce(date, F.lit("")).alias("game_date"), F.coalesce(iso_utc(parse_ts(when)), F.lit("")).alias("close_time"),
        event_url("kalshi", F.coalesce("event_ticker", F.lit("")), series).alias("url"), src_ord(F.col("page"), F.col("event_pos"), F.col("pos")).alias("src_ord"),
    )
    return with_defaults(out, sport, F.lit(level))


def filter_poly_games(events: DataFrame, sport: str) -> DataFrame:
    """Game events of the sport, with their level; `sport` is a text or a struct that holds one."""
    slug_of = F.coalesce(F.get_json_object("sport", "$.sport"), F.col("sport"))
    if sport == "tennis":
        df = events.withColumn("level", tour_level(slug_of, F.col("title")))
        return df.where(F.col("slug").rlike(r"^(atp|wta|itf)-[a-z0-9]+-[a-z0-9]+-\d{4}-\d{2}-\d{2}$") & F.col("level").isNotNull())
    level = "pro" if sport == "nfl" else "college"
    return events.where((slug_of == sport) & F.col("slug").rlike(rf"^{sport}-[a-z0-9]+-[a-z0-9]+-\d{{4}}-\d{{2}}-\d{{2}}$")).withColumn("level", F.lit(level))


def first_moneyline(markets: Column) -> Column:
    return F.get(F.filter(markets, lambda m: (m["sportsMarketType"] == "moneyline") & F.lower(F.coalesce(m["closed"], F.lit(""))).isin("", "false", "0", "null")), F.lit(0))


def poly_outcomes(events: DataFrame, sport: str) -> DataFrame:
    """One row an outcome of each event's first open moneyline that has a team, the first of each team."""
    s = F.lit(sport)
    fields = ("alias", "name", "abbreviation") if sport == "nfl" else ("name", "alias", "abbreviation") if sport == "tennis" else ("alias",)
    df = first_seen(filter_poly_games(events, sport), F.coalesce(truthy(F.col("id")), F.col("slug")))
    df = df.withColumns({"m": first_moneyline(F.col("markets")), "names": F.filter(F.transform("teams", lambda t: F.coalesce(*[team_id(s, t[f]) for f in fields])), lambda t: t.isNotNull())}).where("m is not null")
    df = df.withColumns({"outcomes": json_array(F.col("m.outcomes")), "prices": json_array(F.col("m.outcomePrices")), "tokens": json_array(F.col("m.clobTokenIds"))})
    df = df.withColumn("others", F.transform("outcomes", lambda o: team_id(s, o)))
    df = df.select("*", F.posexplode("others").alias("pos", "team")).where(F.array_position("others", F.col("team")) == F.col("pos") + 1)
    close = F.coalesce(truthy(F.col("m.endDate")), truthy(F.col("endDate")), F.col("startDate"))
    out = df.select(
        F.lit("polymarket").alias("exchange"), F.coalesce(truthy(F.col("m.id")), truthy(F.col("m.slug")), F.col("slug")).alias("market_id"), truthy(F.get("tokens", F.col("pos"))).alias("token_id"), F.col("slug").alias("event_id"),
        F.coalesce(truthy(F.col("title")), F.col("slug")).alias("event_title"), "team", F.coalesce(_first(F.col("names"), F.col("team")), _first(F.col("others"), F.col("team")), F.lit("")).alias("opponent"),
        parse_price(F.get("prices", F.col("pos"))).alias("yes_price"), parse_price(F.col("m.volume")).alias("volume"), F.coalesce(slug_date(F.col("slug"), close), F.lit("")).alias("game_date"),
        F.coalesce(iso_utc(parse_ts(close)), F.lit("")).alias("close_time"), event_url("polymarket", F.col("slug")).alias("url"), flag(F.col("live")).alias("live"), flag(F.col("ended")).alias("ended"), "level",
        src_ord(F.col("page"), F.col("event_pos"), F.col("pos")).alias("src_ord"),
    )
    return with_defaults(out, sport, F.col("level"))


def whole_kalshi_books(books: DataFrame) -> DataFrame:
    """(observed_at, book_id, kind, levels): books as they come, a row each; levels are texts (price, qty). Kinds: bid (NO bids), cents
    (those of the older field) and ask."""
    dollars = F.col("orderbook_fp.no_dollars")
    use = F.size(F.coalesce(dollars, F.array())) > 0
    pairs = F.transform(F.when(use, dollars).otherwise(F.col("orderbook.no")), lambda x: F.struct(F.get(x, F.lit(0)).alias("price"), F.get(x, F.lit(1)).alias("qty")))
    return books.select("observed_at", F.col("ticker").alias("book_id"), F.when(use, "bid").otherwise("cents").alias("kind"), pairs.alias("levels"))


def whole_poly_books(books: DataFrame) -> DataFrame:
    return books.select("observed_at", F.col("token_id").alias("book_id"), F.lit("ask").alias("kind"), F.col("asks").cast("array<struct<price: string, qty: string>>").alias("levels"))


def split_books(books: DataFrame) -> DataFrame:
    """Levels (price, qty, and other columns) of whole books: a NO bid at P is a YES ask at 1 - P. Prices in cents (over 1) only in the
    older field."""
    rows = books.select("*", F.explode("levels").alias("x"))
    p, kind = parse_price(F.col("x.price")), F.col("kind")
    bid = F.when((kind == "cents") & (p > 1), p / 100).otherwise(p)
    return rows.withColumns({"price": F.when(kind == "ask", p).otherwise(F.round(1.0 - bid, 4)), "qty": parse_price(F.col("x.qty"))}).drop("x", "levels", "kind").where("price > 0 and qty > 0")


def split_kalshi_book(books: DataFrame) -> DataFrame:
    return split_books(whole_kalshi_books(books))


def split_poly_book(books: DataFrame) -> DataFrame:
    return split_books(whole_poly_books(books))


def poly_outcome_prices(quotes: DataFrame) -> DataFrame:
    """yes_a and yes_b of quotes (sport, team_a, team_b, outcomes, prices, and columns that are kept); the last hit counts, also if null."""
    names = F.transform("outcomes", lambda o: team_id(F.col("sport"), o))
    df = quotes.withColumn("names", names)

    def price(team: str) -> Column:
        back = F.array_position(F.reverse("names"), F.col(team)).cast("int")  # from the end; 0: no hit
        return F.when(back > 0, parse_price(F.get("prices", F.size("names") - back)))

    return df.withColumns({"yes_a": price("team_a"), "yes_b": price("team_b")}).drop("names", "outcomes", "prices")
