import json
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from crossbook import catalog, replays
from crossbook.operators import ladders, matching, outcomes, scoring
from crossbook.plans import jobs, tables
from crossbook.sources import landed, log, sinks


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def market(ticker, sub, **more):
    return {"ticker": ticker, "yes_sub_title": sub, "volume_fp": "10", "close_time": "2025-09-08T01:00:00Z"} | more


@pytest.fixture
def landing(tmp_path):
    game = {"event_ticker": "KXNFLGAME-25SEP07NENYG", "title": "NE at NYG", "markets": [market("KXNFLGAME-25SEP07NENYG-NE", "New England", yes_ask_dollars="0.4000"), market("KXNFLGAME-25SEP07NENYG-NYG", "New York G", yes_ask_dollars="", last_price_dollars="0.55")]}
    odd = {"event_ticker": "ODD", "title": "", "markets": [market("ODD-GB", "Green Bay", yes_ask_dollars="x"), market("ODD-QQ", "nobody")]}
    dump(tmp_path / "kalshi_events/series=KXNFLGAME/page-0.json", {"events": [game, odd], "cursor": "c"})
    dump(tmp_path / "kalshi_events/series=KXNFLGAME/page-1.json", {"events": [game], "cursor": None})
    ml = {"id": "77", "sportsMarketType": "moneyline", "closed": False, "outcomes": '["Patriots", "Giants"]', "outcomePrices": '["0.45"]', "clobTokenIds": '["t1", "t2"]', "volume": "5", "endDate": "2025-09-07T20:00:00Z"}
    event = {
        "id": "1", "slug": "nfl-ne-nyg-2025-09-07", "title": "Patriots vs Giants", "sport": {"sport": "nfl"}, "teams": [{"name": "Patriots", "alias": "Patriots"}, {"name": "Giants", "alias": "Giants"}], "live": True, "ended": False,
        "markets": [{"id": "1", "sportsMarketType": "spreads", "outcomes": "[]"}, ml | {"id": "2", "closed": True}, ml],
    }
    other = event | {"id": "3", "slug": "nfl-season-winner"}
    real = event | {"id": "4", "slug": "nfl-gb-chi-2025-09-07", "sport": "nfl", "teams": [], "markets": [ml | {"id": "88", "outcomes": ["Packers", "Packers", "Bears"], "outcomePrices": ["0.5", "0.6", "0.7"], "clobTokenIds": []}]}
    dump(tmp_path / "poly_events/tag=nfl/page-0.json", [event, other, event, real])
    return str(tmp_path)


def test_kalshi_rows(spark, landing):
    k, _ = jobs.sport_listings(spark, landing, "nfl")
    rows = {r.market_id: r for r in k.collect()}
    assert set(rows) == {"KXNFLGAME-25SEP07NENYG-NE", "KXNFLGAME-25SEP07NENYG-NYG", "ODD-GB"}  # the repeated event counts once
    a, b, c = (rows[x] for x in sorted(rows))
    assert (a.team, a.opponent, a.yes_price, a.game_date, a.url) == ("patriots", "giants", 0.4, "2025-09-07", "https://kalshi.com/markets/kxnflgame/kxnflgame-25sep07nenyg")
    assert (b.team, b.yes_price) == ("giants", 0.55)
    assert (c.team, c.opponent, c.yes_price, c.game_date, c.event_title) == ("packers", "", None, "2025-09-08", "ODD")


def test_poly_rows(spark, landing):
    _, p = jobs.sport_listings(spark, landing, "nfl")
    rows = [(r.event_id, r.team, r.opponent, r.yes_price, r.token_id, r.market_id, r.live) for r in p.orderBy("src_ord").collect()]
    assert rows == [
        ("nfl-ne-nyg-2025-09-07", "patriots", "giants", 0.45, "t1", "77", 1), ("nfl-ne-nyg-2025-09-07", "giants", "patriots", None, "t2", "77", 1),
        ("nfl-gb-chi-2025-09-07", "packers", "bears", 0.5, None, "88", 1), ("nfl-gb-chi-2025-09-07", "bears", "packers", 0.7, None, "88", 1),
    ]


def test_discover_and_snapshot(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    made = jobs.discover(spark, landing, out, ("nfl",))
    m = made["matches"].collect()
    assert [(r.team_a, r.team_b, r.game_date, r.kalshi_yes_b, r.poly_yes_a, r.live) for r in m] == [("giants", "patriots", "2025-09-07", 0.4, None, 1)]
    assert sinks.read_snapshot(spark, out, "markets").count() == 7
    jobs.discover(spark, landing, out, ("nfl",))  # a new version replaces the old one
    assert sinks.read_snapshot(spark, out, "matches").count() == 1
    assert set(sinks.register_views(spark, out)) >= {"markets", "matches", "arbs"}
    assert spark.sql("select count(*) from matches where live = 1").first()[0] == 1
    assert jobs.discovery_summary(made["markets"], made["matches"], made["arbs"]).first().compared == 0
    assert landed.read_matches(spark, f"{sinks.save_snapshot(made['markets'], made['matches'], made['arbs'], out)}/matches").count() == 1


def test_books(spark, tmp_path):
    dump(tmp_path / "kalshi_books/a.json", {"ticker": "A", "observed_at": "2025-01-01T00:00:00Z", "orderbook_fp": {"no_dollars": [["0.40", "5"], ["0.30", "0"]]}})
    dump(tmp_path / "kalshi_books/b.json", {"ticker": "B", "observed_at": "2025-01-01T00:00:00Z", "orderbook_fp": {"no_dollars": []}, "orderbook": {"no": [[45, 3], [1, 2]]}})
    dump(tmp_path / "poly_books/a.json", {"token_id": "T", "observed_at": "2025-01-01T00:00:00Z", "asks": [{"price": "0.5", "size": "2"}, {"price": "0.4", "size": None}]})
    rows = sorted((r.book_id, r.price, r.qty) for r in jobs.landed_books(spark, str(tmp_path)).collect())
    assert rows == [("A", 0.6, 5.0), ("B", 0.55, 3.0), ("T", 0.5, 2.0)]
    m = spark.createDataFrame([("nfl", "pro", "d", "a", "b", "B", "A", "x", "T", 0, 0)], "sport string, level string, game_date string, team_a string, team_b string, kalshi_id_a string, kalshi_id_b string, poly_token_a string, poly_token_b string, live int, ended int")
    r = jobs.scan_executable(spark, m, str(tmp_path)).collect()
    assert [(x.direction, x.is_exec, x.combined_best) for x in r] == [("Buy a on Kalshi + b on Polymarket", 0, 1.05)]
    assert ladders.attach_books(m, jobs.landed_books(spark, str(tmp_path))).count() == 3


def test_quotes(spark, tmp_path):
    k = [{"observed_at": "2025-01-01T00:00:00Z", "event": {"markets": [{"ticker": "A", "yes_ask_dollars": "0.4", "status": "active"}]}}, {"observed_at": "2025-01-01T00:00:00Z", "market": {"ticker": "A", "yes_ask_dollars": "0.9"}}, {"observed_at": "2025-01-01T00:00:00Z", "market": {"ticker": "B", "last_price_dollars": "0.5", "status": "settled"}}]
    p = [{"observed_at": "2025-01-01T00:00:00Z", "market": {"id": "P", "outcomes": '["b","a"]', "outcomePrices": '["0.3","0.6"]', "active": "true"}}]
    for name, rows in (("k", k), ("p", p)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "q.json").write_text("\n".join(map(json.dumps, rows)))
    kq, pq = landed.read_kalshi_quotes(spark, str(tmp_path / "k")), landed.read_poly_quotes(spark, str(tmp_path / "p"))
    assert sorted((r.ticker, r.yes, r.closed) for r in kq.collect()) == [("A", 0.4, False), ("B", 0.5, True)]
    m = spark.createDataFrame([("cfb", "college", "d", "a", "b", "A", "B", "P", 0, 0)], "sport string, level string, game_date string, team_a string, team_b string, kalshi_id_a string, kalshi_id_b string, poly_id string, live int, ended int")
    r = scoring.score_quotes(scoring.quote_matches(m, kq, pq)).collect()
    assert [(x.closed, x.best_cost, x.best_trade) for x in r] == [(1, 0.7, "buy a Kalshi YES + b Polymarket YES")]


def test_absent_and_older_tables(spark, tmp_path):
    assert landed.read_book_ticks(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1, "nfl", 0.1)], "tick_id long, sport string, best_edge double").selectExpr("*", "timestamp'2025-01-01' as observed_at").write.parquet(str(tmp_path / "old"))
    r = landed.read_ticks(spark, str(tmp_path / "old")).first()
    assert r.live is None and r.ended is None and r.best_edge == 0.1
    assert "x" in sinks.evolve(spark.range(1), "x int").columns


def test_histories(spark, tmp_path):
    df = spark.sql("select timestamp'2025-01-01' as observed_at, 'nfl' sport, 1 is_arb, 0 closed, cast(null as int) live, 0 ended union all select timestamp'2025-01-02', 'nfl', 1, 1, 0, 0")
    sinks.append_arb_history(df, str(tmp_path), "poll")
    sinks.append_price_ticks(df, str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/arb_history").collect()
    assert [(r.source, r.live, r.obs_date) for r in rows] == [("poll", 0, date(2025, 1, 1))]
    assert set(sinks.register_views(spark, str(tmp_path))) == {"price_ticks", "arb_history"}


def _tick_rows(spark, ids):
    return spark.createDataFrame([(k, 0.1) for k in ids], "n int, best_edge double").selectExpr("timestamp_seconds(1735689600 + n * 3600) AS observed_at", "'nfl' AS sport", "'d' AS game_date", "concat('t', n) AS team_a", "'x' AS team_b", "best_edge", "n")


def test_history_counts_batches_once_and_ids_ascend(spark, tmp_path):
    """A replay adds nothing, a reader of an old version reads on while batches are compacted, and new columns are null in older rows."""
    path = str(tmp_path / "h")
    sinks.append(_tick_rows(spark, [30, 3, 1]), path, "w", 0)
    sinks.append(_tick_rows(spark, [30, 3, 1]), path, "w", 0)
    sinks.append(_tick_rows(spark, [2]).withColumn("extra", F.lit("e")), path, "w", 1)
    sinks.append(_tick_rows(spark, []), path, "w", 2)
    before = sinks.read_history(spark, path)
    want = [(0, 1, None), (1, 3, None), (2, 30, None), (3, 2, "e")]
    rows = lambda df: sorted((r.tick_id, r.n, r.extra) for r in df.collect())
    assert rows(before) == want
    assert sinks.compact(spark, path) and not sinks.compact(spark, path)
    assert rows(before) == rows(sinks.read_history(spark, path)) == want
    sinks.append(_tick_rows(spark, [0]), path)
    sinks.expire_history(spark, path, 1)
    assert rows(sinks.read_history(spark, path)) == [*want, (4, 0, None)]
    assert len(list((tmp_path / "h").glob("batch=*"))) == 2  # the compacted one and the last
    plan = sinks.read_history(spark, path).where("obs_date = DATE '2025-01-02'")._jdf.queryExecution().toString()
    assert "obs_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        sinks.append(_tick_rows(spark, [5]).withColumn("n", F.lit("text")), path)


def test_two_compactions_and_an_append_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    for k in range(2):
        sinks.append(_tick_rows(spark, [k]), path, "w", k)
    create, meanwhile = log.Log.create, [lambda: sinks.append(_tick_rows(spark, [7]), path), lambda: sinks.compact(spark, path)]

    def racing(self, number, entry):
        if meanwhile:
            meanwhile.pop(0)()
        return create(self, number, entry)

    monkeypatch.setattr(log.Log, "create", racing)
    assert not sinks.compact(spark, path)  # the other one was first
    assert sorted((r.tick_id, r.n) for r in sinks.read_history(spark, path).collect()) == [(0, 0), (1, 1), (2, 7)]


def test_snapshot_writers_at_once(spark, tmp_path):
    df = lambda k: spark.createDataFrame([("nfl", "d", "a", "b", "E", k), ("nfl", "d", "a", "b", "D", k + 1)], "sport string, game_date string, team_a string, team_b string, kalshi_event_id string, src_ord int")
    markets = df(0).selectExpr("sport", "'kalshi' AS exchange", "1 AS market_id", "team_a AS team", "src_ord")
    base = str(tmp_path)
    sinks.save_snapshot(markets, df(0), df(0), base)
    first = sinks.snapshot_version(spark, base)
    sinks.save_snapshot(markets, df(5), df(5), base, follows=first)
    with pytest.raises(sinks.Conflict):
        sinks.save_snapshot(markets, df(9), df(9), base, follows=first)
    assert [r.src_ord for r in sinks.read_snapshot(spark, base, "matches").collect()] == [6]  # the last to arrive, not the greatest id
    assert [r.src_ord for r in sinks.read_snapshot(spark, base, "matches", first).collect()] == [1]
    sinks.expire_snapshots(spark, base, 1)
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, base, "matches", first)
    assert not log.Log(spark, f"{base}/snapshots/_log").create(first + 1, {})


def test_pages_keep_their_order(spark, tmp_path):
    events = spark.createDataFrame([(p, k, json.dumps({"event_ticker": f"E{p}{k}", "title": "t"})) for p in (1, 0, 12) for k in (2, 0, 1)], "page long, event_pos int, value string")
    landed.land_pages(events, f"{tmp_path}/k", '{"events": [', "]}")
    landed.land_pages(events.selectExpr("page", "event_pos", "replace(value, 'event_ticker', 'slug') AS value"), f"{tmp_path}/p")
    k = sorted((r.page, r.event_pos, r.event_ticker) for r in landed.read_kalshi_events(spark, f"{tmp_path}/k").collect())
    p = sorted((r.page, r.event_pos, r.slug) for r in landed.read_poly_events(spark, f"{tmp_path}/p").collect())
    assert k == p == [(x, y, f"E{x}{y}") for x in (0, 1, 12) for y in (0, 1, 2)]


def test_pages_are_parsed_as_texts_and_odd_events_lose_no_others(spark, tmp_path):
    event = lambda i, **more: {"id": i, "slug": f"nfl-a-b-2025-09-{i:02d}", "sport": {"sport": "nfl"}, "live": True, "ended": 0, "markets": [{"id": i, "closed": False, "volume": 5}]} | more
    dump(tmp_path / "p/page-3.json", [event(1), event(2, markets="none"), event(3, sport="nfl")])
    (tmp_path / "p/page-4.json").write_text("[not json")
    (tmp_path / "p/page-5.json").write_text(json.dumps(event(4), indent=2))
    df = landed.read_poly_events(spark, f"{tmp_path}/p")
    rows = [(r.page, r.event_pos, r.id, r.sport, r.live, r.ended, r.markets[0].closed if r.markets else None) for r in df.where("id is not null").orderBy("page", "event_pos").collect()]
    assert [r[:3] for r in rows] == [(3, 0, "1"), (3, 1, "2"), (3, 2, "3"), (5, 0, "4")]
    assert rows[0][3:] == ('{"sport":"nfl"}', "true", "0", "false") and rows[2][3] == "nfl"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "Exchange" not in plan  # no value opens the file again, no page is numbered by a shuffle


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_pages_are_landed_compressed_and_no_text_is_shuffled(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id AS k", "id % 2 AS page", "id div 2 AS event_pos")
    events = replays.paged(rows).selectExpr("page", "event_pos", "to_json(named_struct('event_ticker', concat('E', k), 'title', repeat('title ', 50))) AS value")
    plan = _plan(landed.page_lines(events, "[", "]"))
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # of the keys; the texts come after
    landed.land_pages(events, f"{tmp_path}/k", '{"events": [', '], "cursor": null}')
    files = list((tmp_path / "k").glob("page=*/*.gz"))
    assert sorted(f.parent.name for f in files) == ["page=0", "page=1", "page=1000000", "page=1000001"]
    assert sum(f.stat().st_size for f in files) < 5000 * 300 / 10
    got = {(r.page, r.event_pos): r.event_ticker for r in landed.read_kalshi_events(spark, f"{tmp_path}/k").collect()}
    assert got == {(k % 2 * 1_000_000 + k // 2 // replays.PAGE, k // 2 % replays.PAGE): f"E{k}" for k in range(5000)}
    landed.land_pages(events.where("false"), f"{tmp_path}/none")
    assert landed.read_kalshi_events(spark, f"{tmp_path}/none").count() == 0


def test_outcomes_of_an_event_are_told_apart_without_a_shuffle(spark):
    line = lambda *names: [{"id": "7", "sportsMarketType": "moneyline", "outcomes": json.dumps(names), "outcomePrices": json.dumps([str(i / 10) for i in range(len(names))])}]
    events = [(0, 0, "1", "nfl-a-b-2025-09-07", line("Packers", "?", "packers", "Bears")), (0, 1, "1", "nfl-a-b-2025-09-07", line("Bears")), (1, 0, "2", "nfl-c-d-2025-09-07", line("?", "Bears"))]
    df = spark.createDataFrame([(*e[:4], None, "nfl", [], None, None, None, None, e[4]) for e in events], f"page long, event_pos int, {landed.P_EVENT}")
    out = outcomes.poly_outcomes(df, "nfl")
    assert [(r.event_id[4], r.team, r.opponent, r.yes_price, r.src_ord) for r in out.orderBy("src_ord").collect()] == [("a", "packers", "bears", 0.0, 0), ("a", "bears", "packers", 0.3, 3), ("c", "bears", "", 0.1, 100_000_001)]
    assert _plan(out).count("Exchange hashpartitioning") == 1  # that of first_seen


def test_rows_of_keys_that_come_once_are_not_shuffled(spark, monkeypatch):
    df = tables.written(spark.range(300).selectExpr("IF(id % 100 < 2, NULL, CAST(id % 290 AS STRING)) AS a", "'x' AS b", "id AS o"), "t")
    rows = lambda x: sorted(map(str, x.collect()))
    want = rows(matching.dedupe_last(df, ["a", "b"], "o"))
    assert len(want) < 295
    assert rows(sinks.last_of_repeated(df, ["a", "b"], "o")) == want
    monkeypatch.setattr(sinks, "REPEATED", 3)
    assert rows(sinks.last_of_repeated(df, ["a", "b"], "o")) == want
    once = sinks.last_of_repeated(df, ["o"], "o")
    assert "Exchange" not in _plan(once) and rows(once) == rows(df)


def test_a_discovery_leaves_no_shuffle_files(spark, landing, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    before = held()
    jobs.discover(spark, landing, str(tmp_path / "out"), ("nfl",))
    for _ in range(100):
        if held() <= before:
            break
        time.sleep(0.1)  # they are removed in the background
    assert held() <= before


def _landed(spark, tmp_path, monkeypatch, name):
    """Rows of a query over sf0.001, and the files that it lands there."""
    monkeypatch.setattr(replays, "shared_folder", lambda _, folder: str(tmp_path / folder))
    n = catalog.queries()[name](spark, "/root/testdata/sf0.001").count()
    return n, [f for f in (tmp_path / "discover/landing").rglob("part-*")]


def test_discovered_markets_land_a_tenth_of_their_texts(spark, tmp_path, monkeypatch):
    n, files = _landed(spark, tmp_path, monkeypatch, "discovered_markets")
    assert n > 0 and len(files) == 10  # five pages a venue
    assert sum(f.stat().st_size for f in files) < 1500 * (638 + 872) / 10  # bytes of an order's texts at both venues


def test_discovered_arbs_keep_no_shuffle_and_land_compressed(spark, tmp_path, monkeypatch):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    before, real, during = held(), sinks.save_snapshot, []

    def saved(*args, **more):
        for _ in range(100):
            if held() <= before:
                break
            time.sleep(0.1)
        during.append(held() - before)
        return real(*args, **more)

    monkeypatch.setattr(sinks, "save_snapshot", saved)
    n, files = _landed(spark, tmp_path, monkeypatch, "discovered_arbs")
    assert n > 0 and all(f.name.endswith(".gz") for f in files)
    assert during == [set()]  # none of landing, parsing and matching when the snapshot is saved
