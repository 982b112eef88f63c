"""Statistics of executable book ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import SPORT_ORDER
from ..functions.scalars import game_status, truthy
from ..plans.tables import written
from .episodes import GAP_BREAK, MATCH_KEY, THRESHOLDS, find_episodes, qualifies, with_thresholds
from .medians import duration_figures, with_median
from .stats import n_matches, ranked

#: Label, least profit, profit from which the next begins. Fixed values.
PROFIT_BUCKETS = (("under $1", None, 1.0), ("$1-$10", 1.0, 10.0), ("$10-$100", 10.0, 100.0), ("$100+", 100.0, None))
_T = ["min_edge", "inclusive"]


def as_price_ticks(book_ticks: DataFrame) -> DataFrame:
    """Book ticks in the shape of price ticks: never closed, an arb where executable."""
    return book_ticks.withColumns({"closed": F.lit(0), "is_arb": (F.coalesce(F.col("is_exec"), F.lit(0)) != 0).cast("int")})


def best_snapshots(book_ticks: DataFrame, thresholds=THRESHOLDS, *by: str) -> DataFrame:
    """Per threshold and match the print of the largest profit (then edge, then earliest)."""
    df = with_thresholds(book_ticks, thresholds)
    df = df.where(qualifies(F.col("is_exec"), F.col("best_edge"), F.col("min_edge"), F.col("inclusive")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumns({"profit": zero("exec_profit"), "qty": zero("exec_qty"), "status": game_status(F.col("live"), F.col("ended"))})
    first = F.struct("observed_at", "tick_id")
    df = df.groupBy(*by, *_T, *MATCH_KEY).agg(
        F.min_by(F.struct("profit", "qty", "best_edge", "best_trade"), F.struct(-F.col("profit"), -F.col("best_edge"), "observed_at", "tick_id")).alias("b"),
        F.min_by(F.struct("level", "live", "ended", "status"), first).alias("h"), F.count("*").alias("exec_ticks"), F.bool_or(F.col("status") == "live").alias("any_live"),
    )
    live = F.col("any_live")
    return df.select(
        *by, *_T, "sport", "h.level", "game_date", "team_a", "team_b", "b.best_trade", F.col("b.profit").alias("peak_profit"), F.col("b.qty").alias("peak_qty"), F.col("b.best_edge").alias("peak_edge"), "exec_ticks",
        F.when(live, 1).otherwise(F.col("h.live")).alias("live"), "h.ended", F.when(live, "live").otherwise(F.col("h.status")).alias("status"),
    )


def largest_snapshots(snaps: DataFrame, n: int = 5) -> DataFrame:
    return snaps.orderBy(F.desc("peak_profit"), F.desc("peak_edge"), F.coalesce("team_a", F.lit("")), *MATCH_KEY).limit(n)


def profit_bucket(profit: Column) -> Column:
    out = F.lit(PROFIT_BUCKETS[-1][0])
    for label, _, high in reversed(PROFIT_BUCKETS[:-1]):
        out = F.when(profit < high, label).otherwise(out)
    return out


def profit_buckets(snaps: DataFrame, *by: str) -> DataFrame:
    """Matches and sums of each bucket, empty ones too, for each group that has snapshots."""
    counts = snaps.groupBy(*by, profit_bucket(F.col("peak_profit")).alias("label")).agg(F.count("*").alias("matches"), F.sum("peak_profit").alias("gross_profit"), F.sum("peak_qty").alias("gross_qty"))
    labels = F.explode(F.array(*[F.lit(b[0]) for b in PROFIT_BUCKETS])).alias("label")
    groups = (snaps.select(*by).distinct() if by else snaps.sparkSession.range(1)).select(*by, labels)
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return groups.join(counts.hint("merge"), [*by, "label"], "left").select(*by, "label", zero("matches", 0), zero("gross_profit", 0.0), zero("gross_qty", 0.0))


def snapshot_summary(snaps: DataFrame, *by: str) -> DataFrame:
    snaps = written(snaps, "snapshots")
    figures = snaps.groupBy(*by).agg(
        F.count("*").alias("matches"), F.coalesce(F.sum("peak_profit"), F.lit(0.0)).alias("gross_profit"), F.coalesce(F.sum("peak_qty"), F.lit(0.0)).alias("gross_qty"),
        F.max("peak_profit").alias("max_profit"), F.coalesce(F.sum("exec_ticks"), F.lit(0)).alias("exec_ticks"),
    )
    for value, name in (("peak_profit", "median_profit"), ("peak_qty", "median_qty")):
        figures = with_median(figures, snaps, list(by), value, name)
    return figures.select(*by, "matches", "gross_profit", "gross_qty", "median_profit", "median_qty", "max_profit", "exec_ticks")


def edge_blocks(book_ticks: DataFrame, thresholds=THRESHOLDS, gap_break: float = GAP_BREAK, slices: bool = False) -> DataFrame:
    """Per threshold (and slice): snapshot summary, executable ticks, and episode durations. Thresholds without any show zeros."""
    by = (["slice"] if slices else []) + _T
    snaps = snapshot_summary(best_snapshots(book_ticks, thresholds, *by[: len(by) - 2]), *by)
    episodes = duration_figures(find_episodes(as_price_ticks(book_ticks), thresholds, gap_break, slices, by_day=True), by)
    groups = with_thresholds(book_ticks.select("slice").distinct() if slices else book_ticks.sparkSession.range(1).select(), thresholds)
    zero = lambda c, z=0: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return groups.join(snaps.hint("merge"), by, "left").join(episodes.hint("merge"), by, "left").select(
        *by, zero("matches"), zero("gross_profit", 0.0), zero("gross_qty", 0.0), "median_profit", "median_qty", "max_profit", zero("exec_ticks"), zero("n"), zero("open_n"), "mean", "median", "min", "max"
    )


def sport_slices(ticks: DataFrame) -> DataFrame:
    """ticks once for their sport and, in tennis, once more for their tour (column slice); rows without a sport are in none."""
    tour = F.when((F.col("sport") == "tennis") & truthy(F.col("level")).isNotNull(), F.concat(F.lit("tennis/"), F.col("level")))
    return ticks.where(truthy(F.col("sport")).isNotNull()).withColumn("slice", F.explode(F.array_compact(F.array(F.col("sport"), tour))))


def slice_stats(book_ticks: DataFrame, thresholds=THRESHOLDS, gap_break: float = GAP_BREAK) -> DataFrame:
    """edge_blocks of every slice, with its ticks and matches."""
    sliced = sport_slices(book_ticks)
    counts = sliced.groupBy("slice").agg(n_matches().alias("quoted_matches"), F.count("*").alias("ticks"))
    blocks = edge_blocks(sliced, thresholds, gap_break, slices=True)
    return blocks.join(counts.hint("merge"), "slice").withColumn("rank", ranked(F.split_part("slice", F.lit("/"), F.lit(1)), SPORT_ORDER))
