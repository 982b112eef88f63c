import random
from datetime import datetime, timedelta

from crossbook.operators import episodes, stats

SCHEMA = "tick_id long, observed_at timestamp, sport string, level string, game_date string, team_a string, team_b string, best_edge double, is_arb int, best_trade string, closed int, live int, ended int"
T0 = datetime(2025, 1, 1)


def tick(i, sec, edge, team="a", closed=0, live=0, ended=0, trade="t"):
    return (i, T0 + timedelta(seconds=sec), "nfl", "pro", "2025-01-01", team, "b", edge, int(bool(edge and edge > 0)), trade, closed, live, ended)


def status(live, ended):
    return "live" if live else "ended" if ended else "unknown" if live is None and ended is None else "pregame"


def naive(rows, least, inclusive, gap):
    """The runs of each series, one tick after another."""
    out, series = [], {}
    for r in rows:
        series.setdefault(r[5], []).append(r)
    end_of_all = max(r[1] for r in rows)
    for team, ticks in series.items():
        run, prev = None, None
        for r in sorted(ticks, key=lambda r: (r[1], r[0])):
            on = not r[10] and r[7] is not None and (r[7] >= least if inclusive else r[7] > least)
            st, far = status(r[11], r[12]), prev is not None and (r[1] - prev).total_seconds() > gap
            if run and (not on or far or st != run["st"]):
                end = r[1] if not on and not far and st == run["st"] else run["last"]
                out.append((team, run["start"], end, run["peak"], run["n"], False))
                run = None
            if on and run is None:
                run = {"start": r[1], "last": r[1], "peak": r[7], "n": 1, "st": st}
            elif on:
                run |= {"last": r[1], "n": run["n"] + 1, "peak": max(run["peak"], r[7])}
            prev = r[1]
        if run:
            out.append((team, run["start"], run["last"], run["peak"], run["n"], (end_of_all - run["last"]).total_seconds() <= gap))
    return sorted(out)


def found(df):
    return sorted((r.team_a, r.start, r.end, r.peak_edge, r.ticks, r.still_open) for r in df.collect())


def test_gap_status_and_ends(spark):
    rows = [
        tick(1, 0, 0.02, trade="x"), tick(2, 900, 0.05, trade="y"), tick(3, 1801, 0.05, trade="z"), tick(4, 1900, 0.0), tick(5, 5000, 0.01, live=1), tick(6, 5010, 0.01, live=0), tick(7, 9000, None),
    ]
    got = episodes.find_episodes(spark.createDataFrame(rows, SCHEMA), ((0.0, False),)).orderBy("start").collect()
    assert [(r.ticks, r.best_trade, r.duration_seconds) for r in got] == [(2, "y", 900.0), (1, "z", 99.0), (1, "t", 0.0), (1, "t", 0.0)]
    assert [r.status for r in got] == ["pregame", "pregame", "live", "pregame"]
    assert not any(r.still_open for r in got)


def test_against_state_machine(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for team in "abcdefgh":
        t = 0
        for _ in range(60):
            t += rng.choice([0, 8, 60, 900, 901, 2000])
            i += 1
            rows.append(tick(i, t, rng.choice([None, -0.01, 0.0, 0.01, 0.02, 0.03]), team, int(rng.random() < 0.1), rng.choice([None, 0, 0, 1]), rng.choice([None, 0, 0])))
    df = spark.createDataFrame(rows, SCHEMA)
    both = episodes.find_episodes(df).cache()
    for least, inclusive in episodes.THRESHOLDS:
        assert found(both.where((both.min_edge == least) & (both.inclusive == inclusive))) == naive(rows, least, inclusive, 900)


def test_by_day_against_state_machine(spark):
    rng = random.Random(7)
    rows, i = [], 0
    for team in "abcdef":
        t = rng.randrange(86_400)
        for _ in range(120):  # some 15 days; runs of many days, days without ticks, ties at midnight
            t += rng.choice([0, 8, 3_600, 20_000, 40_000, 43_200, 43_201, 200_000, 86_400 - t % 86_400])
            i += 1
            rows.append(tick(i, t, rng.choice([None, 0.0, 0.01, 0.02] + 8 * [0.03]), team, int(rng.random() < 0.05), int(rng.random() < 0.1)))
    df = spark.createDataFrame(rows, SCHEMA)
    both = episodes.find_episodes(df, gap_break=43_200, by_day=True).cache()
    for least, inclusive in episodes.THRESHOLDS:
        got = found(both.where((both.min_edge == least) & (both.inclusive == inclusive)))
        assert got == naive(rows, least, inclusive, 43_200) and any((g[2].date() - g[1].date()).days > 1 for g in got)  # some cross two midnights


def test_by_day_is_the_same(spark):
    rng = random.Random(11)
    rows = [tick(i, 7_000 * i, rng.choice([0.0, 0.01, 0.02]), rng.choice("ab"), live=rng.choice([0, 0, 0, 1])) for i in range(300)]
    rows += [(1000 + k, None, *tick(0, 0, 0.02, "a")[2:]) for k in range(3)]  # no time
    rows += [(2000 + k, T0 + timedelta(hours=11 * k), *tick(0, 0, 0.02, None)[2:]) for k in range(20)]  # a null in the key
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _extra", "sport AS s", "IF(tick_id % 3 = 0, 'x', NULL) AS slice")
    for slices in (False, True):
        plain, days = (episodes.find_episodes(df, gap_break=43_200, slices=slices, by_day=b) for b in (False, True))
        assert plain.columns == days.columns and plain.count() > 20
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, days.collect()))


def test_one_long_episode(spark):
    rows = [tick(i, 3_600 * i, 0.02) for i in range(24 * 40)]
    (r,) = episodes.find_episodes(spark.createDataFrame(rows, SCHEMA), ((0.0, False),), gap_break=3_600, by_day=True).collect()
    assert (r.ticks, r.duration_seconds, r.still_open) == (24 * 40, 3_600.0 * (24 * 40 - 1), True)
    assert episodes.find_episodes(spark.createDataFrame([], SCHEMA), by_day=True).count() == 0


def test_one_shuffle_on_the_key(spark):
    df = spark.createDataFrame([tick(1, 0, 0.1)], SCHEMA)
    plan = episodes.find_episodes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sport") == 1 and "Cartesian" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    eps = episodes.find_episodes(df)
    assert eps.count() == 0
    row = stats.duration_stats(eps).first()
    assert (row.n, row.open_n, row["mean"], row.median) == (0, 0, None, None)
    row = stats.window_stats(df).first()
    assert (row.ticks, row.typical_poll_seconds, row.gap_break_seconds, row.max_poll_gap) == (0, None, None, None)
    assert stats.typical_poll_seconds(df).first()[0] == 8.0


def test_poll_gaps_over_days(spark):
    days = [0, 5, 86_400 * 3, 86_400 * 400, 86_400 * 400 + 8]
    df = spark.createDataFrame([tick(i, s, 0.1) for i, s in enumerate(days + days)], SCHEMA)
    assert sorted(r.gap for r in stats.poll_gaps(df).collect()) == sorted(float(b - a) for a, b in zip(days, days[1:], strict=False))


def test_rollup_becomes_live(spark):
    rows = [tick(1, 0, 0.05), tick(2, 10, 0.0), tick(3, 20, 0.01, live=1)]
    r = stats.match_rollups(episodes.find_episodes(spark.createDataFrame(rows, SCHEMA), ((0.0, False),))).first()
    assert (r.episodes, r.peak_edge, r.status, r.live, r.duration_seconds) == (2, 0.05, "live", 1, 10.0)


def test_only_long_series_are_cut_into_days(spark, monkeypatch):
    """Series of a few ticks a day keep one shuffled row a tick; longer ones beside them are cut, with the same episodes."""
    rng = random.Random(8)
    rows = [tick(i, rng.randrange(0, 6 * 86_400), rng.choice((0.02, 0.005, -0.1, None)), team="abc"[i % 7 % 3] if i % 2 else f"s{i % 40}", live=i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = found(episodes.find_episodes(df, gap_break=20_000.0))
    whole = episodes.find_episodes(df, gap_break=20_000.0, by_day=True)
    assert found(whole) == want and "Union" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(episodes, "LONG", 30)
    cut = episodes.find_episodes(df, gap_break=20_000.0, by_day=True)
    assert found(cut) == want and "Union" in cut._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(episodes, "FEW", 0)
    assert found(episodes.find_episodes(df, gap_break=20_000.0, by_day=True)) == want
