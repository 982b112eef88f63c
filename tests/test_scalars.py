from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from crossbook.functions import scalars as s


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()[0]


@pytest.mark.parametrize("text, want", [("0.5", 0.5), (" 0.5 ", 0.5), ("", None), (None, None), ("x", None), ("1d", None), ("0", 0.0)])
def test_parse_price(spark, text, want):
    assert one(spark, s.parse_price(F.col("x")), x=text) == want


def test_dates(spark):
    assert one(spark, s.parse_ts(F.col("x")), x="2025-09-07T01:02:03Z") == datetime(2025, 9, 7, 1, 2, 3)
    assert one(spark, s.parse_ts(F.col("x")), x="junk") is None
    assert one(spark, s.local_date(F.col("x")), x="2025-09-07T23:00:00-05:00") == date(2025, 9, 7)
    assert one(spark, s.parse_game_date(F.col("x")), x="2025-09-07T10") == date(2025, 9, 7)
    assert one(spark, s.ticker_date(F.col("x")), x="KXATPMATCH-25SEP07ABC") == date(2025, 9, 7)
    assert one(spark, s.ticker_date(F.col("x")), x="KXATPMATCH-25XXX07ABC") is None
    assert one(spark, s.slug_date(F.col("x"), F.col("y")), x="nfl-a-b-2025-09-08", y="2025-09-07T00:00:00Z") == "2025-09-08"


@pytest.mark.parametrize("text, want", [("NE", "patriots"), ("New  England", "patriots"), ("n.e", "patriots"), ("Los Angeles R", "rams"), ("49ers!", "49ers"), ("", None), ("nobody", None)])
def test_nfl_team(spark, text, want):
    assert one(spark, s.nfl_team(F.col("x")), x=text) == want


@pytest.mark.parametrize("text, want", [("Texas A&M", "texas am"), ("Ohio St.", "ohio state"), ("Miami (FL)", "miami fl"), ("Miami (Ohio)", "miami oh"), ("!!", None), (None, None)])
def test_cfb_team(spark, text, want):
    assert one(spark, s.cfb_team(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Carlos Alcaraz", "carlos alcaraz", True), ("Alcaraz", "Carlos Alcaraz", True), ("C. Alcaraz", "Carlos Alcaraz", True), ("D. Alcaraz", "Carlos Alcaraz", False),
        ("A Li", "B Li", False), ("Alex de Minaur", "A. Minaur", True), ("", "x", False), (None, "x", False), ("de la", "van", False),
    ],
)
def test_names_equal(spark, a, b, want):
    assert one(spark, s.names_equal(F.col("a"), F.col("b")), a=a, b=b) is want


def test_event_ticker(spark):
    got = one(spark, s.parse_event_ticker(F.col("x")), x="KXNFLGAME-25SEP07NENYG")
    assert got.date == date(2025, 9, 7) and got.teams == ["patriots", "giants"]
    assert one(spark, s.parse_event_ticker(F.col("x")), x="KXNFLGAME-25SEP07NEQQNYG").teams == ["patriots"]
    assert one(spark, s.parse_event_ticker(F.col("x")), x="OTHER-25SEP07NENYG") is None


@pytest.mark.parametrize("slug, title, want", [("atp", "A vs B", "atp"), ("atp", "Challenger X", "challenger"), ("wta", "WTA 125 X", "challenger"), ("wta", "Doubles: x", None), ("itf", "Juniors", None), ("golf", "x", None)])
def test_tour_level(spark, slug, title, want):
    assert one(spark, s.tour_level(F.col("a"), F.col("b")), a=slug, b=title) == want


def test_status_and_flags(spark):
    df = spark.createDataFrame([(1, 0), (0, 1), (None, None), (0, 0), (None, 0)], "live int, ended int")
    assert [r[0] for r in df.select(s.game_status(F.col("live"), F.col("ended"))).collect()] == ["live", "ended", "unknown", "pregame", "pregame"]
    assert [one(spark, s.flag(F.col("x")), x=x) for x in ("true", "True", "1", "yes", None)] == [1, 1, 1, 0, 0]
    assert one(spark, s.kalshi_closed(F.col("x")), x="settled") is True and one(spark, s.kalshi_closed(F.col("x")), x=None) is False
    assert one(spark, s.poly_closed(F.col("x"), F.col("y")), x="false", y="false") is True


def test_texts(spark):
    row = spark.createDataFrame([(3723.0, 0.0325, 1234.5, 1234.0, 0.57, 0.575)], "sec double, edge double, usd double, qty double, p double, q double").select(
        s.fmt_duration(F.col("sec")), s.fmt_cents(F.col("edge")), s.fmt_dollars(F.col("usd")), s.fmt_qty(F.col("qty")), s.price_cents(F.col("p")), s.price_cents(F.col("q")), s.fmt_size(F.col("usd")), s.fmt_cents(F.lit(None).cast("double")),
        s.game_label(F.lit("tennis"), F.lit("atp"), F.lit("2025-01-02"), F.lit("a"), F.lit("b")),
    ).first()
    assert tuple(row) == ("1h 2m 3s", "3.25c", "$1,234.50", "1,234", "57c", "57.5c", "1234.50", "n/a", "[tennis/atp] 2025-01-02 a vs b")


def test_times_dont_depend_on_the_sessions_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for text in ("2025-09-07T01:02:03", "2025-09-07 01:02:03", "2025-09-07T01:02:03Z", "2025-09-06T21:02:03-04:00"):
            ts = s.parse_ts(F.col("x"))
            r = spark.createDataFrame([(text,)], "x string").select(F.unix_seconds(ts).alias("s"), s.fmt_ts(ts).alias("t"), s.iso_utc(ts).alias("i")).first()
            assert tuple(r) == (1757206923, "2025-09-07 01:02:03 UTC", "2025-09-07T01:02:03Z")
        assert spark.createDataFrame([("2025-09-07",), ("soon",), ("",), (None,)], "x string").select(F.unix_seconds(s.parse_ts(F.col("x")))).collect() == [(1757203200,), (None,), (None,), (None,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_times_are_computed_once(spark):
    """A parsed time is in the plan once, not for each of its text's parts."""
    texts = spark.createDataFrame([("2024-01-01T00:00:00-05:00",), ("1969-12-31T23:59:59.9Z",), ("0000-12-31T23:59:59Z",), ("soon",)], "c string")
    ts = s.parse_ts(F.col("c"))
    assert [tuple(r) for r in texts.select(s.iso_utc(ts), s.fmt_ts(ts)).collect()] == [("2024-01-01T05:00:00Z", "2024-01-01 05:00:00 UTC"), ("1969-12-31T23:59:59Z", "1969-12-31 23:59:59 UTC"), ("0000-12-31T23:59:59Z", "0000-12-31 23:59:59 UTC"), (None, "n/a")]
    assert texts.select(s.iso_utc(ts).alias("t"))._jdf.queryExecution().analyzed().toString().count("unix_seconds") == 1
