"""Landed books are parsed once, whatever is made of them."""

import json

from pyspark.sql import functions as F

from crossbook.functions import scalars
from crossbook.operators import ladders, scoring
from crossbook.plans import jobs
from crossbook.sources import landed

MATCH = "sport string, level string, game_date string, team_a string, team_b string, kalshi_id_a string, kalshi_id_b string, poly_id string, poly_token_a string, poly_token_b string, live int, ended int"


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan json")


def test_books_are_scanned_in_one_pass(spark, tmp_path):
    for name, rows in (("kalshi_books", [{"ticker": "A", "observed_at": "2025-01-01T00:00:00Z", "orderbook": {"no": [[60, 3], [60, 2], [50, 1], [1, 0]]}}]), ("poly_books", [{"token_id": "y", "observed_at": "2025-01-01T00:00:00Z", "asks": [{"price": "0.55", "size": "4"}, {"price": "0.7", "size": "9"}]}])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "b.json").write_text("\n".join(map(json.dumps, rows)))
    m = spark.createDataFrame([("cfb", "college", "d", "a", "b", "A", "B", "P", "x", "y", 0, 0)], MATCH)
    df = jobs.scan_executable(spark, m, str(tmp_path), lines=True)
    assert scans(df) == 2  # one of each venue
    (r,) = df.collect()
    assert (r.dir, r.kalshi_ask, r.poly_ask, r.qty, round(r.avg_cost, 6), r.is_exec) == (0, 0.4, 0.55, 4.0, 0.95, 1)


def test_no_level_is_looked_at_again_for_each_before_it(spark):
    """Levels of one price count together; no frame reaches to the far end of the ladder, which Spark reads anew for each row."""
    levels = [(1, s, p / 100, 1.0) for s in "LR" for p in range(1, 60) for _ in range(2)]
    df = ladders.walk_ladders(spark.createDataFrame(levels, "match_id long, side string, price double, qty double"))
    assert "unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()
    (r,) = df.collect()
    assert (r.qty, round(r.total_cost, 6)) == (98.0, round(sum(4 * p / 100 for p in range(1, 50)), 6))


def test_quotes_are_scanned_in_one_pass(spark, tmp_path):
    """Lines of both venues give the same quotes as each venue's reader, and meet the matches in one pass over them."""
    at, later = "2025-01-01T00:00:00Z", "2025-01-01T01:00:00+01:00"
    market = lambda ticker, ask=None, **more: {"ticker": ticker, "yes_ask_dollars": ask, "status": "active"} | more
    poly = {"outcomes": '["b","a"]', "outcomePrices": '["0.5", "0.55"]'}
    k = [
        {"observed_at": at, "event": {"markets": [market("A", "0.4"), market("A", "0.45"), market("", "0.1")]}, "market": market("A", "0.9")}, {"observed_at": later, "markets": [market("B", None, last_price_dollars="0.3"), market("B", "", last_price_dollars="0.2")]},
        {"observed_at": at, "market": market("B", "0.41", status="settled")}, {"observed_at": at, "markets": []}, {"observed_at": "bad", "market": market("P", "0.2")},
    ]
    p = [{"observed_at": at, "id": "P", **poly}, {"observed_at": at, "id": "P", **poly, "closed": "true"}, {"observed_at": at, "market": {"id": "Q", "outcomes": '["a\\"", "b"]', "outcomePrices": "x", "active": "false"}}, {"observed_at": at, "slug": "s"}, {"observed_at": at, "outcomes": "[]"}]
    for name, rows in (("k", k), ("p", p), ("both", [r | {"venue": "k"} for r in k] + [{("p_market" if c == "market" else c): v for c, v in r.items()} | {"venue": "p"} for r in p])):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    raw = spark.read.schema(landed.QUOTE_LINE).json(str(tmp_path / "both.json"))
    got = landed.line_quotes(raw)
    kq = landed.read_kalshi_quotes(spark, str(tmp_path / "k.json")).select("observed_at", "ticker", "yes", "closed")
    pq = landed.poly_quotes(spark.read.schema(landed.P_QUOTE_SCHEMA).json(str(tmp_path / "p.json"))).where("market_id is not null").select("observed_at", "market_id", "outcomes", "prices", "closed")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got.where("venue = 'k'").select("observed_at", got.id.alias("ticker"), "yes", "closed")) == rows(kq) and kq.count() == 3
    assert rows(got.where("venue = 'p'").select("observed_at", got.id.alias("market_id"), "outcomes", "prices", "closed")) == rows(pq) and pq.count() == 4
    m = spark.createDataFrame([("cfb", "college", "d", "a", "b", "A", "B", "P", "x", "y", 0, 0)], MATCH)
    df = scoring.match_quotes(m, got)
    assert scans(df) == 1
    (r,) = df.collect()
    assert tuple(r[c] for c in scoring.PRICES) == (0.45, 0.55, 0.2, 0.5) and r.closed == 1


def test_usual_texts_need_no_pattern_or_parser(spark):
    """The short ways of times and of arrays of plain strings give what the long ones give."""
    arrays = ['["a", "b"]', '["a","b"]', '["a" ,"b"]', '["a\\"", "b"]', "[]", '[""]', '["a", 1]', '["a"', '["a"]x', '["a"]\n', '["é, ü", "x y"]', '["a\tb"]', ' ["a"]', '["a""b"]', None, "", "null", '["a\\u0041"]', '["😀","b"]', '["a", null]', '["[", "]"]', '[", "]', '["a",]']
    df = spark.createDataFrame([(x,) for x in arrays], "c string")
    assert [tuple(r) for r in df.select(F.col("c"), scalars.json_array(F.col("c"))).collect()] == [tuple(r) for r in df.select("c", F.from_json("c", "array<string>")).collect()]
    times = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:60Z", "2024-02-30T00:00:00Z", "2024-01-01TT0:00:00Z", "2024-01-01T0\n:00:00Z", "2024-01-01T00:00+01Z", "2024-01-01T00:00   Z", "2024-01-01 00:00:00Z", "20240-1-01T00:00:00Z", "-024-01-01T00:00:00Z", None]
    df = spark.createDataFrame([(x,) for x in times], "c string")
    old = F.try_to_timestamp(F.when(F.col("c").rlike(r"[T ]\d.*([A-Za-z]|[+-]\d\d?(:?\d\d)?)\s*$"), F.col("c")))
    for c, new, long in df.select("c", F.unix_seconds(scalars.parse_ts(F.col("c"))), F.unix_seconds(old)).collect():
        assert new == long, c
