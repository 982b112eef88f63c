"""Structured Streaming: quotes and books into tick histories, and episodes as a stateful operator.

The tick streams read landed files batch by batch. A batch takes the snapshot that is current when it is first tried and keeps it when
it is tried again, so a new snapshot takes effect without a restart and a replay gives the same ticks. Histories know the last batch
that a stream has added, so a replay after a failure leaves each tick once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.scalars import game_status, parse_ts
from ..operators.episodes import GAP_BREAK, MATCH_KEY
from ..operators.ladders import quote_executable
from ..operators.outcomes import whole_kalshi_books, whole_poly_books
from ..operators.scoring import match_quotes, score_quotes
from ..sources.landed import QUOTE_LINE, line_quotes
from ..sources.log import Log
from ..sources.sinks import append, arb_rows, compact, read_snapshot, snapshot_version

_BOOK = "ticker string, token_id string, observed_at string, orderbook_fp struct<no_dollars: array<array<string>>>, orderbook struct<no: array<array<string>>>, asks array<struct<price: string, size: string>>"


class LastGood:
    """The match table as it was last read; refresh() reads it again and keeps the old one if that fails."""

    def __init__(self, load: Callable[[], DataFrame]):
        self.load, self.df = load, None

    def refresh(self) -> DataFrame:
        try:
            df = self.load()
            df.schema  # noqa: B018  analysis fails here if the table is gone
            self.df = df
        except Exception:
            if self.df is None:
                raise
        return self.df


class Pinned:
    """The match table of a snapshot folder. A batch keeps the version it first saw, also when it is tried again."""

    def __init__(self, spark: SparkSession, base: str, checkpoint: str, keep: int = 100):
        self.spark, self.base, self.keep = spark, base, keep
        self.pins = Log(spark, f"{checkpoint.rstrip('/')}/snapshot_pins")

    def at(self, batch: int) -> DataFrame:
        if self.pins.read(batch) is None:
            self.pins.create(batch, {"version": snapshot_version(self.spark, self.base)})
            for old in self.pins.numbers()[: -self.keep]:
                self.pins.delete(old)
        return read_snapshot(self.spark, self.base, "matches", self.pins.read(batch)["version"])


def _match_table(spark: SparkSession, matches: str | Callable[[], DataFrame], checkpoint: str) -> Callable[[int], DataFrame]:
    if isinstance(matches, str):
        return Pinned(spark, matches, checkpoint).at
    source = LastGood(matches)
    return lambda number: source.refresh()


#: A history is compacted when so many batches have been added to it.
COMPACT_AFTER = 256


def _add(df: DataFrame, path: str, number: int) -> None:
    append(df, path, "poll", number)
    if number % 16 == 15:
        compact(df.sparkSession, path, COMPACT_AFTER)


def price_tick_stream(spark: SparkSession, landing: str, matches: str | Callable[[], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Price ticks of landed quotes (landing/*: one JSON object a line, either venue's) into the histories price_ticks and arb_history.

    matches: the folder of the snapshots, of which each batch uses the version that is current when it is first tried; or a function
    that loads the match table. A batch that is tried again after it was added isn't added twice."""
    raw = spark.readStream.schema(QUOTE_LINE).json(landing)
    table = _match_table(spark, matches, checkpoint)

    def batch(df: DataFrame, number: int) -> None:
        ticks = score_quotes(match_quotes(table(number), line_quotes(df)))
        ticks = ticks.persist()
        _add(ticks, f"{out}/price_ticks", number)
        _add(arb_rows(ticks, "poll"), f"{out}/arb_history", number)
        ticks.unpersist()

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def book_tick_stream(spark: SparkSession, landing: str, matches: str | Callable[[], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Book ticks of landed order books (one JSON object a line, either venue's) into the history book_ticks; ended matches are left out.
    matches: as for price ticks."""
    raw = spark.readStream.schema(_BOOK).json(landing)
    table = _match_table(spark, matches, checkpoint)

    def batch(df: DataFrame, number: int) -> None:
        df = df.withColumn("observed_at", parse_ts(F.col("observed_at")))
        books = whole_kalshi_books(df.where("ticker is not null")).unionByName(whole_poly_books(df.where("token_id is not null")))
        _add(quote_executable(table(number), books, "observed_at"), f"{out}/book_ticks", number)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


EPISODE = "sport string, game_date string, team_a string, team_b string, level string, best_trade string, start long, end long, last_ts long, duration_seconds double, peak_edge double, ticks long, still_open boolean, live int, ended int, status string, min_edge double, inclusive boolean"
#: What a tick waits as; times are microseconds, and a missing id comes before all others.
_TICK = ("us", "id", "best_edge", "best_trade", "closed", "level", "live", "ended", "status")
#: Groups of matches that share a state, fixed for a checkpoint.
GROUPS = 1024


class EpisodeProcessor(StatefulProcessor):
    """State of a group of matches: for each match that has any, rows that the watermark hasn't passed, the open episode at each
    threshold, and the time of the last row taken.

    Rows wait until the watermark passes them and are then taken in order of time, whatever batch they came in: later arrivals are
    all newer. One timer, at the earliest row waiting or a gap after an episode's last row, takes what is due where no rows come.
    Matches are many and have few ticks a batch, and each question to the state store is a call to the JVM, so a group's matches are
    read and written as one value (a pickled dict). A match with no row waiting and no episode open takes no state."""

    def __init__(self, thresholds, gap_break: float):
        self.thresholds, self.gap = thresholds, round(gap_break * 1e6)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("matches", "matches binary, wake long")

    def _closed(self, key, s: list, end: int, i: int) -> tuple:
        start, last, peak, trade, ticks, level, live, ended, status = s
        return (*key, level, trade, start, end, last, max(0.0, (end - start) / 1e6), peak, ticks, False, live, ended, status, float(self.thresholds[i][0]), self.thresholds[i][1])

    def _take(self, key, s: list | None, prev: int | None, rows: list[tuple], i: int, out: list[tuple]) -> list | None:
        """The open episode at a threshold after rows; episodes that they end go to out."""
        least, inclusive = self.thresholds[i]
        for us, _, edge, trade, closed, level, live, ended, status in rows:
            on = not closed and (edge >= least if inclusive else edge > least)  # an edge that isn't known is NaN
            if s is not None:
                near = us - prev <= self.gap and status == s[8]
                if not on or not near:
                    out.append(self._closed(key, s, us if near else s[1], i))
                    s = None
            if on and s is None:
                s = [us, us, edge, trade, 1, level, live, ended, status]
            elif on:
                s[1], s[4] = us, s[4] + 1
                if edge > s[2]:
                    s[2], s[3] = edge, trade
            prev = us
        return s

    def _advance(self, new: dict[tuple, list[tuple]], watermark: int, fired: int = -1) -> Iterator[pd.DataFrame]:
        """Takes the rows that the watermark (milliseconds) has passed, keeps the others, and sets the timer. fired: the timer that
        has gone off, if any."""
        old = self.state.get()
        matches = pickle.loads(old[0]) if old else {}
        kept, out, wake = {}, [], None
        for key in [*matches, *(k for k in new if k not in matches)]:
            rows, open_, prev = matches.get(key) or ([], [None] * len(self.thresholds), None)
            if key in new:
                rows = sorted(rows + new[key], key=lambda r: r[:2])
            due = sum(r[0] // 1000 < watermark for r in rows)
            taken, rows = rows[:due], rows[due:]
            if taken:
                open_ = [self._take(key, s, prev, taken, i, out) for i, s in enumerate(open_)]
                prev = taken[-1][0]
            for i, s in enumerate(open_):
                # A row to come is newer than the watermark, so it can't extend an episode that ended more than a gap before it.
                if s is not None and (s[1] + self.gap) // 1000 + 1 < watermark and (not rows or rows[0][0] - s[1] > self.gap):
                    out.append(self._closed(key, s, s[1], i))
                    open_[i] = None
            at = [rows[0][0] // 1000 + 1] if rows else []
            at += [(s[1] + self.gap) // 1000 + 2 for s in open_ if s is not None]
            if at:
                kept[key] = (rows, open_, prev)
                wake = min(at) if wake is None else min(wake, *at)
        if wake is not None:
            wake = max(wake, watermark + 1)
        if old and old[1] != wake and old[1] > fired:
            self.handle.deleteTimer(old[1])
        if wake is not None and (not old or old[1] != wake or old[1] <= fired):
            self.handle.registerTimer(wake)
        if kept:
            self.state.update((pickle.dumps(kept, pickle.HIGHEST_PROTOCOL), wake))
        elif old:
            self.state.clear()
        if out:
            yield _frame(out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[tuple, list[tuple]] = {}
        for df in rows:
            columns = [[None if pd.isna(v) else int(v) for v in df[c]] if c in ("live", "ended") else df[c].tolist() for c in _TICK]
            for k, r in zip(zip(*(df[c].tolist() for c in MATCH_KEY), strict=True), zip(*columns, strict=True), strict=True):
                new.setdefault(k, []).append(r)
        yield from self._advance(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance({}, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in EPISODE.split(", ")])
    return df.astype({"ticks": "int64", "duration_seconds": "float64", "peak_edge": "float64", "still_open": "bool", "live": "Int32", "ended": "Int32"})


def stream_episodes(ticks: DataFrame, thresholds=((0.0, False),), gap_break: float = GAP_BREAK, delay: str = "15 minutes", groups: int = GROUPS) -> DataFrame:
    """Closed episodes of a stream of price ticks at each threshold (least edge, whether it is enough itself), the same whatever order
    ticks come in within the watermark's delay. Rows later than that are dropped, and those without a time; find_episodes over the
    stored ticks stays the reference result. Matches are dealt by hash to groups, which share a state: a stream that is started again
    must have as many. Needs the RocksDB state store."""
    df = ticks.where("observed_at is not null").withWatermark("observed_at", delay).select(
        *MATCH_KEY, "observed_at", F.unix_micros("observed_at").alias("us"), F.coalesce("tick_id", F.lit(-(2**63))).alias("id"), F.col("best_edge").cast("double").alias("best_edge"), "best_trade",
        F.coalesce("closed", F.lit(0)).alias("closed"), "level", "live", "ended", game_status(F.col("live"), F.col("ended")).alias("status"), F.pmod(F.xxhash64(*MATCH_KEY), F.lit(groups)).alias("_group"),
    )
    out = df.groupBy("_group").transformWithStateInPandas(statefulProcessor=EpisodeProcessor(thresholds, gap_break), outputStructType=EPISODE, outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start", "end", "last_ts")})
