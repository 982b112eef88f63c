import random

import pytest

from crossbook.operators import book_stats, ladders


def greedy(left, right):
    left, right = sorted(map(list, left)), sorted(map(list, right))
    qty = cost = 0.0
    while left and right:
        both = round(left[0][0] + right[0][0], 4)
        if both >= 1:
            break
        n = min(left[0][1], right[0][1])
        qty, cost = qty + n, cost + n * both
        for side in (left, right):
            side[0][1] -= n
            if side[0][1] <= 1e-9:
                side.pop(0)
    return (qty, cost) if qty > 0 else None


def test_sweep_is_greedy(spark):
    rng, rows, want = random.Random(3), [], {}
    for m in range(120):
        books = {s: [(round(rng.uniform(0.3, 0.7), 2), float(rng.randint(1, 9))) for _ in range(rng.randint(0, 6))] for s in "LR"}
        rows += [(m, s, p, q) for s, b in books.items() for p, q in b]
        if w := greedy(books["L"], books["R"]):
            want[m] = w
    got = {r.match_id: (r.qty, r.total_cost) for r in ladders.walk_ladders(spark.createDataFrame(rows, "match_id long, side string, price double, qty double")).collect()}
    assert got.keys() == want.keys() and len(want) > 40
    for k, (q, c) in want.items():
        assert got[k] == (pytest.approx(q), pytest.approx(c))


def test_sum_of_exactly_one_is_not_executable(spark):
    df = spark.createDataFrame([(1, "L", 0.5, 3.0), (1, "R", 0.5, 3.0), (2, "L", 0.4, 1.5)], "match_id long, side string, price double, qty double")
    rows = ladders.score_directions(df).collect()
    assert [(r.match_id, r.is_exec, r.qty, r.avg_cost, r.edge) for r in rows] == [(1, 0, 0.0, 1.0, 0.0)]


MATCH = "sport string, level string, game_date string, team_a string, team_b string, kalshi_id_a string, kalshi_id_b string, poly_token_a string, poly_token_b string, live int, ended int"


def test_quote_executable(spark):
    m = spark.createDataFrame([("nfl", "pro", "d", "a", "b", "ka", "kb", "ta", "tb", 0, 0), ("nfl", "pro", "d", "e", "f", "ka", "kb", "ta", "tb", 0, 1)], MATCH)
    books = spark.createDataFrame([("ka", 0.4, 10.0), ("tb", 0.5, 4.0), ("kb", 0.6, 1.0), ("ta", 0.5, 1.0)], "book_id string, price double, qty double")
    rows = ladders.quote_executable(m, books).collect()
    assert len(rows) == 1  # ended matches aren't quoted
    r = rows[0]
    assert (r.best_trade, r.is_exec, r.best_cost, r.best_edge, r.exec_qty) == ("Buy a on Kalshi + b on Polymarket", 1, 0.9, 0.1, 4.0)
    assert (r.kalshi_yes_a, r.poly_yes_a, r.kalshi_yes_b, r.poly_yes_b) == (0.4, 0.5, 0.6, 0.5)
    one = ladders.quote_executable(m, books.where("book_id <> 'ta'")).first()
    assert (one.kalshi_yes_b, one.poly_yes_a) == (0.6, None)
    hits, misses = ladders.executable_report(ladders.executable_directions(m, books))
    assert hits.count() == 1 and misses.count() == 1


BOOK = "tick_id long, observed_at timestamp, sport string, level string, game_date string, team_a string, team_b string, best_edge double, is_exec int, best_trade string, exec_qty double, exec_profit double, live int, ended int"


def test_snapshots_and_buckets(spark):
    from datetime import datetime, timedelta

    t = [datetime(2025, 1, 1) + timedelta(minutes=i) for i in range(4)]
    rows = [
        (1, t[0], "tennis", "atp", "d", "a", "b", 0.01, 1, "x", 5.0, 0.5, 0, 0), (2, t[1], "tennis", "atp", "d", "a", "b", 0.02, 1, "y", None, 2.0, 1, 0),
        (3, t[2], "tennis", "atp", "d", "a", "b", 0.03, 1, "z", 1.0, 2.0, 0, 0), (4, t[3], "tennis", "wta", "d", "c", "d", None, 1, "x", 1.0, 9.0, 0, 0),
    ]
    df = spark.createDataFrame(rows, BOOK)
    snaps = book_stats.best_snapshots(df, ((0.0, False),))
    r = snaps.collect()
    assert [(x.best_trade, x.peak_profit, x.exec_ticks, x.status) for x in r] == [("z", 2.0, 3, "live")]
    assert {b.label: b.matches for b in book_stats.profit_buckets(snaps).collect()} == {"under $1": 0, "$1-$10": 1, "$10-$100": 0, "$100+": 0}
    assert {x.slice for x in book_stats.slice_stats(df).collect()} == {"tennis", "tennis/atp", "tennis/wta"}
    assert book_stats.edge_blocks(df.limit(0)).select("matches", "gross_profit").distinct().collect() == [(0, 0.0)]


def test_directions_whose_edges_differ_in_the_last_bit_are_equal(spark):
    rows = [("x", "d", g, "o", dir_, 1, edge) for g, pair in (("a", (0.3, 0.1 + 0.2)), ("b", (0.1 + 0.2, 0.3)), ("c", (0.3, 0.30001))) for dir_, edge in enumerate(pair)]
    df = spark.createDataFrame(rows, "sport string, game_date string, team_a string, team_b string, dir int, is_exec int, edge double")
    assert {r.team_a: r.dir for r in ladders.best_direction(df).collect()} == {"a": 0, "b": 0, "c": 1}
