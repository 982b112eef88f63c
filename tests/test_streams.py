import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossbook import replays
from crossbook.operators import episodes
from crossbook.sources import sinks
from crossbook.streaming import streams
from tests.test_episodes import SCHEMA, tick

MATCH = "sport string, level string, game_date string, team_a string, team_b string, kalshi_id_a string, kalshi_id_b string, poly_id string, poly_token_a string, poly_token_b string, live int, ended int"


def matches(spark):
    return spark.createDataFrame([("cfb", "college", "d", "a", "b", "A", "B", "P", "ta", "tb", 0, 0)], MATCH)


def test_price_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        at = f"2025-01-01T00:00:0{i}Z"
        rows = [{"venue": "k", "observed_at": at, "market": {"ticker": t, "yes_ask_dollars": "0.4", "status": "active"}} for t in "AB"] + [{"venue": "p", "observed_at": at, "id": "P", "outcomes": '["a","b"]', "outcomePrices": '["0.5","0.55"]', "active": "true"}]
        (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, rows)))
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run finds nothing new
        streams.price_tick_stream(spark, str(tmp_path / "in"), lambda: matches(spark), out, str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(f"{out}/price_ticks").collect()
    assert sorted((r.observed_at.second, r.best_cost, r.closed) for r in rows) == [(0, 0.9, 0), (1, 0.9, 0)]
    assert {r.source for r in spark.read.parquet(f"{out}/arb_history").collect()} == {"poll"}


def test_book_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ticker": "A", "observed_at": "2025-01-01T00:00:00Z", "orderbook_fp": {"no_dollars": [["0.6", "5"]]}}, {"token_id": "tb", "observed_at": "2025-01-01T00:00:00Z", "asks": [{"price": "0.5", "size": "2"}]}]
    (tmp_path / "in/0.json").write_text("\n".join(map(json.dumps, rows)))
    out = str(tmp_path / "out")
    streams.book_tick_stream(spark, str(tmp_path / "in"), lambda: matches(spark), out, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.is_exec, r.exec_qty, r.best_cost) for r in spark.read.parquet(f"{out}/book_ticks").collect()] == [(1, 2.0, 0.9)]


def test_histories_of_all_writers_are_one_table(spark, tmp_path):
    """Discovery and both streams write into one folder, in a session of another zone; a batch written again replaces itself."""
    for name, rows in (
        ("prices", [{"venue": "k", "observed_at": "2025-01-01T00:30:00Z", "market": {"ticker": t, "yes_ask_dollars": "0.4", "status": "active"}} for t in "AB"] + [{"venue": "p", "observed_at": "2025-01-01T00:30:00Z", "id": "P", "outcomes": '["a","b"]', "outcomePrices": '["0.5","0.55"]', "active": "true"}]),
        ("books", [{"ticker": "A", "observed_at": "2025-01-01T00:30:00Z", "orderbook_fp": {"no_dollars": [["0.6", "5"]]}}, {"token_id": "tb", "observed_at": "2025-01-01T00:30:00Z", "asks": [{"price": "0.5", "size": "2"}]}]),
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.json").write_text("\n".join(map(json.dumps, rows)))
    out, zone = str(tmp_path / "out"), spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for cp in "12":  # the second time as if the first had failed before it was marked as done
            streams.price_tick_stream(spark, str(tmp_path / "prices"), lambda: matches(spark), out, str(tmp_path / f"cp-{cp}")).awaitTermination(120)
        streams.book_tick_stream(spark, str(tmp_path / "books"), lambda: matches(spark), out, str(tmp_path / "cp-b")).awaitTermination(120)
        sinks.append_arb_history(spark.read.parquet(f"{out}/price_ticks").drop("tick_id", "obs_date", "batch"), out, "discovery")
        assert set(sinks.register_views(spark, out)) == {"price_ticks", "arb_history", "book_ticks"}
        assert [(r.source, str(r.obs_date)) for r in spark.sql("select source, obs_date from arb_history order by source").collect()] == [("discovery", "2025-01-01"), ("poll", "2025-01-01")]
        assert spark.sql("select count(*), count(distinct tick_id), count(tick_id) from price_ticks").first()[:] == (1, 1, 1)
        assert spark.sql("select unix_seconds(observed_at) from book_ticks").first()[0] == 1735691400
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_last_good():
    class Frame:
        schema = ()

    answers = [Frame(), OSError("gone")]

    def load():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    source = streams.LastGood(load)
    assert source.refresh() is source.refresh()


@pytest.mark.parametrize("mixed", [False, True])
def test_stream_episodes_equal_batch(spark, tmp_path, mixed):
    """mixed: rows come up to 27 places, and so whole batches, out of order."""
    rows = []
    for k in range(40):
        rows.append(tick(k, 300 * k + (2000 if k > 20 else 0), [0.02, 0.03, -0.01, 0.01][k // 5 % 4]))
        rows.append(tick(100 + k, 300 * k, 0.05 if k % 7 else None, team="c", live=int(k > 15)))
    df = spark.createDataFrame(rows, SCHEMA)
    parts = sorted(rows, key=lambda r: r[1])
    if mixed:
        rng = random.Random(5)
        parts = [r for _, r in sorted(((i + rng.uniform(0, 27), r) for i, r in enumerate(parts)), key=lambda x: x[0])]
    parts += [tick(990 + i, 10**6 * (i + 1), None, team="z") for i in range(2)]  # move the watermark past all rows and timers
    batches = [parts[i : i + 18] for i in range(0, len(parts) - 2, 18)] + [parts[-2:-1], parts[-1:]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streams.stream_episodes(stream, delay="4 hours" if mixed else "15 minutes").writeStream.format("parquet").option("path", str(tmp_path / "eps")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    key = lambda r: (r.team_a, r.start, r.end, r.peak_edge, r.ticks, r.best_trade, r.status)
    want = sorted(map(key, episodes.find_episodes(df, ((0.0, False),)).collect()))
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "eps")).collect())) == want
    assert datetime(2025, 1, 1) + timedelta(0) == want[0][1]


def test_replayed_batch_keeps_its_snapshot_and_is_added_once(spark, tmp_path):
    """Stopped after a batch was added and before it was marked as done; the snapshot that is published meanwhile is for later batches."""
    (tmp_path / "in").mkdir()

    def quotes(i):
        at = f"2025-01-01T00:00:0{i}Z"
        rows = [{"venue": "k", "observed_at": at, "market": {"ticker": t, "yes_ask_dollars": "0.4", "status": "active"}} for t in "AB"] + [{"venue": "p", "observed_at": at, "id": "P", "outcomes": '["a","b"]', "outcomePrices": '["0.5","0.55"]', "active": "true"}]
        (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, rows)))

    out, cp = str(tmp_path / "out"), tmp_path / "cp"
    old = matches(spark).selectExpr("*", "0 AS src_ord")
    run = lambda: streams.price_tick_stream(spark, str(tmp_path / "in"), out, out, str(cp)).awaitTermination(120)
    replays.save_matches(old, out)
    quotes(0)
    run()
    replays.save_matches(old.withColumn("level", F.lit("new")), out)
    for f in (cp / "commits").glob("*0*"):
        f.unlink()
    quotes(1)
    run()
    run()
    rows = sorted((r.tick_id, r.observed_at.second, r.level) for r in sinks.read_history(spark, f"{out}/price_ticks").collect())
    assert rows == [(0, 0, "college"), (1, 1, "new")]
    assert sinks.read_history(spark, f"{out}/arb_history").count() == 2


def test_episodes_at_all_thresholds_at_once(spark, tmp_path):
    rows = [tick(k, 300 * k, [0.005, 0.015, 0.035, 0.025, -0.01, 0.01, 0.02][k % 7]) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, batch in enumerate([rows[:15], rows[15:], [tick(990, 10**6, None, team="z")], [tick(991, 2 * 10**6, None, team="z")]]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = streams.stream_episodes(stream, episodes.THRESHOLDS)
    out.writeStream.format("parquet").option("path", str(tmp_path / "eps")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    key = lambda r: (r.min_edge, r.inclusive, r.start, r.end, r.peak_edge, r.ticks)
    got = sorted(map(key, spark.read.parquet(str(tmp_path / "eps")).collect()))
    assert got == sorted(map(key, episodes.find_episodes(df).collect())) and len({g[0] for g in got}) == 4


def test_calls_to_the_state_store_do_not_grow_with_matches():
    """A group's matches are one value of state; those that have ended leave none."""
    calls, held = [], {}

    class State:
        def get(self):
            calls.append("get")
            return held.get("value")

        def update(self, value):
            calls.append("update")
            held["value"] = value

        def clear(self):
            calls.append("clear")
            held.clear()

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append("timer")

        deleteTimer = registerTimer

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

        def getExpiryTimeInMs(self):
            return self.now - 1

    p, times = streams.EpisodeProcessor(((0.0, False),), 900.0), Times()
    p.init(Handle())
    rows = [("nfl", "d", f"a{i}", None, 10**6 * (i + 1), i, 0.02, "t", 0, "pro", 0, None, "pregame") for i in range(200)]
    assert list(p.handleInputRows((3,), iter([pd.DataFrame(rows, columns=[*episodes.MATCH_KEY, *streams._TICK])]), times)) == []
    assert calls == ["get", "timer", "update"]
    times.now = 10**9
    (out,) = p.handleExpiredTimer((3,), times, times)
    assert len(out) == 200 and out.ticks.tolist() == [1] * 200 and out.ended.isna().all() and out.start.tolist() == [r[4] for r in rows]
    assert calls[3:] == ["get", "clear"] and not held
