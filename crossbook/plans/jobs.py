"""Composite jobs: discovery, executable scan, and the two reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fmt_cents, fmt_duration, game_label, game_status, name_keys, names_equal
from ..operators import book_stats, episodes, ladders, matching, outcomes, scoring, stats
from ..sources import landed, sinks
from .tables import freed_shuffles, written

#: sport -> series and their levels. Fixed values.
SERIES = {
    "nfl": (("KXNFLGAME", "pro"),),
    "cfb": (("KXNCAAFGAME", "college"),),
    "tennis": (("KXATPMATCH", "atp"), ("KXWTAMATCH", "wta"), ("KXITFMATCH", "itf"), ("KXATPCHALLENGERMATCH", "challenger"), ("KXWTACHALLENGERMATCH", "challenger")),
}


def union(frames: list[DataFrame]) -> DataFrame:
    """Rows of venues and sports; columns that one lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sport_listings(spark: SparkSession, landing: str, sport: str) -> tuple[DataFrame, DataFrame]:
    """Outcome rows of both venues, from landing/kalshi_events/series=... and landing/poly_events/tag=<sport>."""
    k = [outcomes.kalshi_outcomes(landed.read_kalshi_events(spark, f"{landing}/kalshi_events/series={s}"), sport, level, s).withColumn("src_ord", F.col("src_ord") + i * 10**15) for i, (s, level) in enumerate(SERIES[sport])]
    return union(k), outcomes.poly_outcomes(landed.read_poly_events(spark, f"{landing}/poly_events/tag={sport}"), sport)


def with_game_date(rows: DataFrame) -> DataFrame:
    return rows.withColumn("game_date", F.try_to_date(F.substring("game_date", 1, 10), "yyyy-MM-dd"))


def discover(spark: SparkSession, landing: str, out: str | None = None, sports: tuple[str, ...] = ("nfl", "cfb", "tennis")) -> dict[str, DataFrame]:
    """markets, matches and arbs of the landed listings; with out, saved as the snapshot and appended to the history."""
    markets, matches = [], []
    with freed_shuffles(spark):
        for sport in sports:
            k, p = (written(df, "listings", compression="zstd") for df in sport_listings(spark, landing, sport))  # parsed once
            markets += [k, p]
            matches.append(matching.match_markets(with_game_date(k), with_game_date(p), *((names_equal, matching.DAYS, name_keys) if sport == "tennis" else ())))
        made = {"markets": union(markets), "matches": written(union(matches), "matches")}
        made["arbs"] = scoring.score_arbs(made["matches"])
        if out:
            sinks.save_snapshot(made["markets"], made["matches"], made["arbs"], out, rare=True)
            sinks.append_arb_history(made["arbs"], out, "discovery")
    return made


def level_counts(markets: DataFrame) -> DataFrame:
    return markets.groupBy("sport", "exchange", "level").agg(F.count("*").alias("n"))


def discovery_summary(markets: DataFrame, matches: DataFrame, arbs: DataFrame) -> DataFrame:
    """One row of counts."""
    status = game_status(F.col("live"), F.col("ended"))
    one = lambda df, *aggs: df.agg(*aggs).withColumn("k", F.lit(1))
    m = one(matches, F.count("*").alias("matches"), F.count_if(status == "live").alias("live"), F.count_if(status == "ended").alias("ended"))
    a = one(arbs, F.count_if(F.col("is_arb") == 1).alias("hits"), F.count("*").alias("compared"))
    return one(markets, F.count("*").alias("markets")).join(F.broadcast(m), "k").join(F.broadcast(a), "k").drop("k")  # one row each


def poll_summary(ticks: DataFrame) -> DataFrame:
    """Per observed_at: quoted, closed, hits, and hits of live and of other games. Book ticks count what is executable."""
    book = "is_exec" in ticks.columns
    hit = (F.col("is_exec") == 1) if book else (F.col("is_arb") == 1) & (F.col("closed") == 0)
    live = game_status(F.col("live"), F.col("ended")) == "live"
    closed = F.lit(0).cast("long") if book else F.count_if(F.col("closed") == 1)
    return ticks.groupBy("observed_at").agg(F.count("*").alias("quoted"), closed.alias("closed"), F.count_if(hit).alias("hits"), F.count_if(hit & live).alias("live_hits"), F.count_if(hit & ~live).alias("other_hits"))


def closest_misses(book_ticks: DataFrame, n: int = 3) -> DataFrame:
    """The n cheapest ticks of each poll that had no hit."""
    from pyspark.sql import Window

    w = Window.partitionBy("observed_at")
    df = book_ticks.withColumn("any_hit", F.max("is_exec").over(w)).where("any_hit = 0")
    order = ["best_cost", *episodes.MATCH_KEY]
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= n).drop("any_hit")


def top_arbs(arbs: DataFrame, n: int = 12) -> DataFrame:
    return arbs.where("is_arb = 1").orderBy(F.desc("best_edge"), *episodes.MATCH_KEY).limit(n)


def ordered_matches(matches: DataFrame, n: int = 8) -> DataFrame:
    return matches.orderBy("game_date", "team_a", "team_b", "sport").limit(n)


def scan_executable(spark: SparkSession, matches: DataFrame, landing: str, lines: bool = False) -> DataFrame:
    """Both directions of every open match over the landed books; lines: files hold a book a line."""
    return ladders.executable_directions(matches, whole_books(spark, landing, lines), "observed_at")


def whole_books(spark: SparkSession, landing: str, lines: bool = False) -> DataFrame:
    """Landed books of both venues, a row each with its levels."""
    k = outcomes.whole_kalshi_books(landed.read_kalshi_books(spark, f"{landing}/kalshi_books", lines))
    return k.unionByName(outcomes.whole_poly_books(landed.read_poly_books(spark, f"{landing}/poly_books", lines)))


def landed_books(spark: SparkSession, landing: str, lines: bool = False) -> DataFrame:
    """Levels (observed_at, book_id, price, qty) of the landed books."""
    return outcomes.split_books(whole_books(spark, landing, lines))


def analyze_prices(ticks: DataFrame, gap_break: float = episodes.GAP_BREAK) -> dict[str, DataFrame]:
    """The price report, a DataFrame a section."""
    eps = written(episodes.find_episodes(ticks, gap_break=gap_break, by_day=True), "episodes")  # all sections read it
    over0 = eps.where("not inclusive")
    rollups = stats.match_rollups(over0)
    label = game_label(*(F.col(c) for c in ("sport", "level", "game_date", "team_a", "team_b")))
    return {
        "window": stats.window_stats(ticks, gap_break), "episodes": eps, "rollups": rollups,
        "largest": stats.largest(rollups).withColumns({"game": label, "edge_text": fmt_cents(F.col("peak_edge")), "time_text": fmt_duration(F.col("duration_seconds"))}),
        "durations": stats.duration_stats(eps, "min_edge", "inclusive"), "thresholds": stats.threshold_counts(eps), "by_status": stats.status_breakdown(ticks, over0),
        "by_sport": stats.sport_breakdown(ticks, over0), "top_episodes": stats.top_episodes(eps.where("min_edge >= 0.02")),
    }


def analyze_books(book_ticks: DataFrame, gap_break: float = episodes.GAP_BREAK) -> dict[str, DataFrame]:
    """The book report, a DataFrame a section."""
    snaps = written(book_stats.best_snapshots(book_ticks), "snapshots")
    return {
        "window": stats.window_stats(book_ticks, gap_break), "snapshots": snaps, "largest": book_stats.largest_snapshots(snaps.where("not inclusive")), "buckets": book_stats.profit_buckets(snaps, "min_edge", "inclusive"),
        "blocks": book_stats.edge_blocks(book_ticks, gap_break=gap_break), "slices": book_stats.slice_stats(book_ticks, gap_break=gap_break),
    }
