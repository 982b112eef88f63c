"""Statistics of price ticks and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import SPORT_ORDER, STATUS_ORDER, TENNIS_LEVELS
from ..functions.scalars import game_status, truthy
from ..plans.tables import written
from .episodes import GAP_BREAK, MATCH_KEY, largest_first, seconds
from .medians import duration_figures, median_of_all

_NULL_KEYS = {"sport": "string", "level": "string"}


def match_struct() -> Column:
    return F.struct(*MATCH_KEY)


def n_matches(when: Column | None = None) -> Column:
    """Distinct match keys; null is a value of its own. when: only rows that meet it."""
    return F.count_distinct(match_struct() if when is None else F.when(when, match_struct()))


def unique_matches(df: DataFrame) -> DataFrame:
    return df.select(*MATCH_KEY).distinct()


def poll_gaps(ticks: DataFrame) -> DataFrame:
    """Rows (observed_at, gap): seconds since the distinct timestamp before it.

    lag runs within days; a day's first timestamp takes the last one of the day before it that has any, from a table of one row a
    day, so nothing is sorted in one task but the days."""
    ts = ticks.select("observed_at").where("observed_at is not null").distinct().withColumn("day", F.to_date("observed_at"))
    days = ts.groupBy("day").agg(F.max("observed_at").alias("last"))
    month = F.date_trunc("year", "day")
    # Within years, then over the years: each window holds at most a few hundred rows.
    carried = days.withColumn("year", month).withColumn("before", F.lag("last").over(Window.partitionBy("year").orderBy("day")))
    years = days.withColumn("year", month).groupBy("year").agg(F.max("last").alias("ylast"))
    years = years.withColumn("ybefore", F.lag("ylast").over(Window.partitionBy(F.lit(0)).orderBy("year")))
    carried = carried.join(F.broadcast(years), "year").select("day", F.coalesce("before", "ybefore").alias("before"))
    w = Window.partitionBy("day").orderBy("observed_at")
    out = ts.withColumn("prev", F.lag("observed_at").over(w)).join(carried.hint("merge"), "day").withColumn("prev", F.coalesce("prev", "before"))
    return out.where("prev is not null").select("observed_at", seconds(F.col("observed_at"), F.col("prev")).alias("gap"))


def typical_poll_seconds(ticks: DataFrame, cutoff: float = 60.0, default: float = 8.0) -> DataFrame:
    """One row (typical_poll_seconds): median of the gaps under the cutoff."""
    return median_of_all(poll_gaps(ticks).where(F.col("gap") < cutoff), "gap", default).select(F.col("median").alias("typical_poll_seconds"))


def window_stats(ticks: DataFrame, gap_break: float = GAP_BREAK) -> DataFrame:
    """One row on the whole series."""
    # Counted by match first: distinct counts side by side would copy every tick for each of them.
    by_match = ticks.groupBy(*MATCH_KEY).agg(F.count("*").alias("n"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"))
    one = by_match.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ticks"), F.count("*").alias("quoted_matches"), F.min("first").alias("window_start"), F.max("last").alias("window_end"))
    gaps = written(poll_gaps(ticks), "gaps")  # a row for each time but the first
    both = one.withColumn("k", F.lit(1))
    for x in (gaps.agg(F.max("gap").alias("max_poll_gap"), F.count("*").alias("_gaps")), median_of_all(gaps.where("gap < 60"), "gap", 8.0).withColumnRenamed("median", "typical")):
        both = both.join(F.broadcast(x.withColumn("k", F.lit(1))), "k")  # one row each
    some = F.col("ticks") > 0
    both = both.withColumn("poll_cycles", F.col("_gaps") + F.col("window_start").isNotNull().cast("long"))
    return both.select("ticks", "quoted_matches", "window_start", "window_end", "poll_cycles", F.when(some, F.col("typical")).alias("typical_poll_seconds"), F.when(some, F.lit(gap_break)).alias("gap_break_seconds"), "max_poll_gap")


def duration_stats(episodes: DataFrame, *by: str) -> DataFrame:
    return duration_figures(episodes, list(by))


def match_rollups(episodes: DataFrame, *by: str) -> DataFrame:
    """One row a match: summed time and ticks, the peak episode's trade and status, live if any episode is."""
    best = F.struct(-F.col("peak_edge"), -F.col("duration_seconds"), F.col("start"))
    df = episodes.groupBy(*by, *MATCH_KEY).agg(
        F.min_by(F.struct("level", "best_trade", "live", "ended", "status"), best).alias("b"), F.max("peak_edge").alias("peak_edge"), F.sum("duration_seconds").alias("duration_seconds"),
        F.sum("ticks").alias("ticks"), F.count("*").alias("episodes"), F.bool_or("still_open").alias("still_open"), F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or(F.col("status") == "live").alias("any_live"),
    )
    live = F.col("any_live")
    return df.select(
        *by, "sport", "b.level", "game_date", "team_a", "team_b", "b.best_trade", "peak_edge", "duration_seconds", "ticks", "episodes", "still_open", "start", "end",
        F.when(live, 1).otherwise(F.col("b.live")).alias("live"), "b.ended", F.when(live, "live").otherwise(F.col("b.status")).alias("status"),
    )


def largest(rollups: DataFrame, n: int = 5) -> DataFrame:
    return rollups.orderBy(*largest_first()).limit(n)


def top_episodes(episodes: DataFrame, n: int = 5) -> DataFrame:
    """The n largest episodes of each threshold, and how many more there are."""
    w = Window.partitionBy("min_edge", "inclusive")
    ranked = episodes.withColumn("rank", F.row_number().over(w.orderBy(*largest_first()))).where(F.col("rank") <= n)
    counts = episodes.groupBy("min_edge", "inclusive").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return ranked.join(F.broadcast(counts), ["min_edge", "inclusive"])  # a row for each threshold


def threshold_counts(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("min_edge", "inclusive").agg(n_matches().alias("matches"), F.count("*").alias("episodes"))


def _by_match(ticks: DataFrame, *by: str) -> DataFrame:
    """Per group and match: ticks and arbs. Distinct matches are then its rows, so no tick is copied to count them."""
    arb = F.coalesce(F.col("is_arb"), F.lit(0)) != 0
    return ticks.groupBy(*by, *[c for c in MATCH_KEY if c not in by]).agg(F.count("*").alias("n"), F.count_if(arb).alias("arbs"))


def _match_aggs() -> list[Column]:
    return [F.sum("n").alias("ticks"), F.sum("arbs").alias("arb_ticks"), F.count("*").alias("quoted_matches"), F.count_if(F.col("arbs") > 0).alias("arb_matches")]


def _joined(ticks: DataFrame, episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Tick and episode figures side by side; groups are a handful of statuses, sports and tours."""
    df = ticks.join(episodes.hint("merge"), [F.col(f"t.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return df.select(
        *[F.coalesce(f"t.{k}", f"e.{k}").alias(k) for k in keys], zero("ticks"), zero("arb_ticks"), F.when(F.col("ticks") > 0, F.col("arb_ticks") / F.col("ticks")).alias("arb_rate"),
        zero("quoted_matches"), zero("arb_matches"), zero("n"), zero("open_n"), "mean", "median", "min", "max",
    )


def ranked(c: Column, order: tuple[str, ...]) -> Column:
    """Place of a name in a report: known ones first."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in zip(order, range(len(order)), strict=True) for x in kv]), c), F.lit(999))


def status_breakdown(ticks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per game status; episodes are those over 0."""
    t = ticks.withColumn("status", game_status(F.col("live"), F.col("ended")))
    t = _by_match(t, "status").groupBy("status").agg(*_match_aggs()).alias("t")
    e = duration_figures(episodes, ["status"]).alias("e")
    return _joined(t, e, ["status"]).withColumn("rank", ranked(F.col("status"), STATUS_ORDER))


def _with_tours(df: DataFrame) -> DataFrame:
    """Rows of a sport once for it (tour null), and once more for their tour in tennis."""
    tour = F.when(F.col("sport") == "tennis", truthy(F.col("level")))
    both = F.array_distinct(F.array(F.lit(None).cast("string"), tour))
    return df.where(truthy(F.col("sport")).isNotNull()).withColumn("tour", F.explode(both))


def sport_breakdown(ticks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per sport (tour null), and per tour for tennis."""
    t = _with_tours(_by_match(ticks, "sport", "level"))
    t = t.groupBy("sport", "tour", *MATCH_KEY[1:]).agg(F.sum("n").alias("n"), F.sum("arbs").alias("arbs"))  # a match may have several levels
    df = _joined(t.groupBy("sport", "tour").agg(*_match_aggs()).alias("t"), duration_figures(_with_tours(episodes), ["sport", "tour"]).alias("e"), ["sport", "tour"])
    return df.where("ticks > 0").withColumns({"sport_rank": ranked(F.col("sport"), SPORT_ORDER), "tour_rank": F.when(F.col("tour").isNotNull(), ranked(F.col("tour"), TENNIS_LEVELS)).otherwise(-1)})
