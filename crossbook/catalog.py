"""Named queries of the market engine and, in `oracle_sql`, the DuckDB SQL that states their results.

Timestamps leave the queries as microseconds and derived doubles rounded to six places, so both engines' values can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import replays
from .functions import scalars
from .functions.names import CFB_ALIASES, NFL_TEAMS
from .operators import book_stats, episodes, ladders, matching, outcomes, scoring, stats
from .plans import jobs
from .sources import landed
from .views import cte, view

#: Ticks of a match in these tables are hours apart.
GAP = 43_200.0
WEEK = 7
KEY = "sport, game_date, team_a, team_b"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _flat(df: DataFrame) -> DataFrame:
    """Timestamps in microseconds, doubles rounded."""
    out = {}
    for c, kind in df.dtypes:
        if kind == "timestamp":
            out[c] = F.unix_micros(c)
        elif kind == "double":
            out[c] = F.round(c, 6)
    return df.withColumns(out) if out else df


def _flat_up(df: DataFrame) -> DataFrame:
    """As _flat, with half-way cases pushed up: costs over 2**k units often end in a five, where the last bit would decide."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c, kind in df.dtypes if kind == "double"})


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_ticks")


def _eps(spark: SparkSession, d: str, thresholds=episodes.THRESHOLDS) -> DataFrame:
    return episodes.find_episodes(_ticks(spark, d), thresholds, GAP, by_day=True)


STATUS = "CASE WHEN live = 1 THEN 'live' WHEN ended = 1 THEN 'ended' WHEN live IS NULL AND ended IS NULL THEN 'unknown' ELSE 'pregame' END"
THR = "(VALUES (CAST(0.0 AS DOUBLE), false), (CAST(0.01 AS DOUBLE), true), (CAST(0.02 AS DOUBLE), true), (CAST(0.03 AS DOUBLE), true))"


def _episode_cte(source: str = "v_ticks", part: str = "") -> str:
    """CTEs up to ep: episodes at all thresholds. part: a leading partition column of the source."""
    key = part + KEY
    return f"""
st AS (SELECT *, {STATUS} AS status FROM {source}), thr(min_edge, inclusive) AS {THR},
o AS (SELECT st.*, min_edge, inclusive, coalesce(closed = 0 AND CASE WHEN inclusive THEN best_edge >= min_edge ELSE best_edge > min_edge END, false) AS is_on FROM st CROSS JOIN thr),
s AS (SELECT *, lag(is_on) OVER w AS p_on, lag(observed_at) OVER w AS p_ts, lag(status) OVER w AS p_status, lead(is_on) OVER w AS n_on, lead(observed_at) OVER w AS n_ts, lead(status) OVER w AS n_status
  FROM o WINDOW w AS (PARTITION BY {key}, min_edge, inclusive ORDER BY observed_at, tick_id)),
f AS (SELECT *, sum(CASE WHEN p_ts IS NULL OR NOT p_on OR epoch_us(observed_at) - epoch_us(p_ts) > {int(GAP * 1e6)} OR p_status <> status THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, min_edge, inclusive ORDER BY observed_at, tick_id) AS eid,
  CASE WHEN n_ts IS NOT NULL AND NOT n_on AND epoch_us(n_ts) - epoch_us(observed_at) <= {int(GAP * 1e6)} AND n_status = status THEN n_ts ELSE observed_at END AS off_end FROM s WHERE is_on),
g AS (SELECT {key}, min_edge, inclusive, eid, first(level ORDER BY observed_at, tick_id) AS level, first(live ORDER BY observed_at, tick_id) AS live, first(ended ORDER BY observed_at, tick_id) AS ended, first(status ORDER BY observed_at, tick_id) AS status,
  first(best_trade ORDER BY best_edge DESC, observed_at, tick_id) AS best_trade, epoch_us(min(observed_at)) AS start, epoch_us(max(observed_at)) AS last_ts, epoch_us(last(off_end ORDER BY observed_at, tick_id)) AS "end",
  last(n_ts IS NULL ORDER BY observed_at, tick_id) AS alive, max(best_edge) AS peak_edge, count(*) AS ticks FROM f GROUP BY ALL),
ends AS (SELECT {part}epoch_us(max(observed_at)) AS global_end FROM {source} {"GROUP BY 1" if part else ""}),
ep AS (SELECT g.* EXCLUDE (eid, alive), greatest(0, "end" - start) / 1e6 AS duration_seconds, alive AND global_end - last_ts <= {int(GAP * 1e6)} AS still_open FROM g {"JOIN ends USING (slice)" if part else "CROSS JOIN ends"})"""


_EP = f"WITH {cte('v_ticks')}, {_episode_cte()}"
_EP_COLUMNS = f'{KEY}, level, best_trade, start, "end", last_ts, round(duration_seconds, 6) AS duration_seconds, round(peak_edge, 6) AS peak_edge, ticks, still_open, min_edge, inclusive, live, ended, status'
DUR = "count(duration_seconds) AS n, count(*) FILTER (WHERE still_open) AS open_n, round(avg(duration_seconds), 6) AS mean, round(median(duration_seconds), 6) AS median, round(min(duration_seconds), 6) AS min, round(max(duration_seconds), 6) AS max"


for _name, _t in (("episodes_all", episodes.THRESHOLDS[0]), *((f"episodes_{i}c", episodes.THRESHOLDS[i]) for i in (1, 2, 3))):
    _query(_name, f"{_EP} SELECT {_EP_COLUMNS} FROM ep WHERE min_edge = {_t[0]}")(lambda spark, d, t=_t: _flat(_eps(spark, d, (t,))))


@_query("duration_stats", f"{_EP} SELECT min_edge, inclusive, {DUR} FROM ep GROUP BY ALL")
def _duration_stats(spark, d):
    return _flat(stats.duration_stats(_eps(spark, d), "min_edge", "inclusive"))


_ROLL = f"""roll AS (SELECT {KEY}, first(level ORDER BY peak_edge DESC, duration_seconds DESC, start) AS level, first(best_trade ORDER BY peak_edge DESC, duration_seconds DESC, start) AS best_trade,
  round(max(peak_edge), 6) AS peak_edge, round(sum(duration_seconds), 6) AS duration_seconds, CAST(sum(ticks) AS BIGINT) AS ticks, count(*) AS episodes, bool_or(still_open) AS still_open, min(start) AS start, max("end") AS "end",
  CASE WHEN bool_or(status = 'live') THEN 1 ELSE first(live ORDER BY peak_edge DESC, duration_seconds DESC, start) END AS live, first(ended ORDER BY peak_edge DESC, duration_seconds DESC, start) AS ended,
  CASE WHEN bool_or(status = 'live') THEN 'live' ELSE first(status ORDER BY peak_edge DESC, duration_seconds DESC, start) END AS status FROM ep WHERE NOT inclusive GROUP BY {KEY})"""


@_query("match_rollups", f"{_EP}, {_ROLL} SELECT * FROM roll")
def _match_rollups(spark, d):
    return _flat(stats.match_rollups(_eps(spark, d, episodes.THRESHOLDS[:1])))


@_query("largest_rollups", f"{_EP}, {_ROLL} SELECT * FROM roll ORDER BY peak_edge DESC, duration_seconds DESC, start, {KEY} LIMIT 5")
def _largest_rollups(spark, d):
    return _flat(stats.largest(stats.match_rollups(_eps(spark, d, episodes.THRESHOLDS[:1]))))


@_query("top_episodes", f"{_EP} SELECT {_EP_COLUMNS}, CAST(rank AS INT) AS rank, greatest(total - 5, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY min_edge ORDER BY peak_edge DESC, duration_seconds DESC, start, {KEY}) AS rank, count(*) OVER (PARTITION BY min_edge) AS total FROM ep WHERE min_edge >= 0.02) WHERE rank <= 5")
def _top_episodes(spark, d):
    return _flat(stats.top_episodes(_eps(spark, d, episodes.THRESHOLDS[2:])))


@_query("threshold_counts", f"{_EP} SELECT min_edge, inclusive, count(DISTINCT (sport, game_date, team_a, team_b)) AS matches, count(*) AS episodes FROM ep GROUP BY ALL")
def _threshold_counts(spark, d):
    return stats.threshold_counts(_eps(spark, d))


_TICK_SQL = "count(*) AS ticks, count(*) FILTER (WHERE is_arb = 1) AS arb_ticks, count(DISTINCT (sport, game_date, team_a, team_b)) AS quoted_matches, count(DISTINCT CASE WHEN is_arb = 1 THEN sport || game_date || team_a || team_b END) AS arb_matches"
_BOTH = "coalesce(ticks, 0) AS ticks, coalesce(arb_ticks, 0) AS arb_ticks, round(arb_ticks / ticks, 6) AS arb_rate, coalesce(quoted_matches, 0) AS quoted_matches, coalesce(arb_matches, 0) AS arb_matches, coalesce(n, 0) AS n, coalesce(open_n, 0) AS open_n, mean, median, min, max"


@_query("status_breakdown", f"{_EP}, t AS (SELECT status, {_TICK_SQL} FROM st GROUP BY 1), e AS (SELECT status, {DUR} FROM ep WHERE NOT inclusive GROUP BY 1) SELECT status, {_BOTH}, CASE status WHEN 'live' THEN 0 WHEN 'pregame' THEN 1 WHEN 'ended' THEN 2 ELSE 3 END AS rank FROM t FULL JOIN e USING (status)")
def _status_breakdown(spark, d):
    return _flat(stats.status_breakdown(_ticks(spark, d), _eps(spark, d, episodes.THRESHOLDS[:1])))


@_query("sport_breakdown", f"""{_EP}, t AS (SELECT sport, CAST(NULL AS VARCHAR) AS tour, {_TICK_SQL} FROM st GROUP BY 1 UNION ALL SELECT sport, level, {_TICK_SQL} FROM st WHERE sport = 'tennis' GROUP BY 1, 2),
  e AS (SELECT sport, CAST(NULL AS VARCHAR) AS tour, {DUR} FROM ep WHERE NOT inclusive GROUP BY 1 UNION ALL SELECT sport, level, {DUR} FROM ep WHERE NOT inclusive AND sport = 'tennis' GROUP BY 1, 2)
  SELECT t.sport, t.tour, {_BOTH}, CASE t.sport WHEN 'nfl' THEN 0 WHEN 'cfb' THEN 1 ELSE 2 END AS sport_rank, CASE t.tour WHEN 'atp' THEN 0 WHEN 'wta' THEN 1 WHEN 'itf' THEN 2 WHEN 'challenger' THEN 3 ELSE -1 END AS tour_rank
  FROM t LEFT JOIN e ON t.sport = e.sport AND t.tour IS NOT DISTINCT FROM e.tour""")  # fmt: skip
def _sport_breakdown(spark, d):
    return _flat(stats.sport_breakdown(_ticks(spark, d), _eps(spark, d, episodes.THRESHOLDS[:1])))


_GAPS = f"WITH {cte('v_ticks')}, ts AS (SELECT DISTINCT observed_at FROM v_ticks), gaps AS (SELECT epoch_us(observed_at) AS observed_at, (epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER (ORDER BY observed_at)) / 1e6 AS gap FROM ts)"


@_query("poll_gaps", f"{_GAPS} SELECT observed_at, round(gap, 6) AS gap FROM gaps WHERE gap IS NOT NULL")
def _poll_gaps(spark, d):
    return _flat(stats.poll_gaps(_ticks(spark, d)))


@_query("typical_poll", f"{_GAPS} SELECT round(coalesce(median(gap) FILTER (WHERE gap < 60), 8.0), 6) AS typical_poll_seconds FROM gaps")
def _typical_poll(spark, d):
    return _flat(stats.typical_poll_seconds(_ticks(spark, d)))


@_query("window_stats", f"""{_GAPS} SELECT (SELECT count(*) FROM v_ticks) AS ticks, (SELECT count(DISTINCT (sport, game_date, team_a, team_b)) FROM v_ticks) AS quoted_matches, (SELECT epoch_us(min(observed_at)) FROM v_ticks) AS window_start,
  (SELECT epoch_us(max(observed_at)) FROM v_ticks) AS window_end, (SELECT count(*) FROM ts) AS poll_cycles, round(coalesce(median(gap) FILTER (WHERE gap < 60), 8.0), 6) AS typical_poll_seconds, CAST({GAP} AS DOUBLE) AS gap_break_seconds, round(max(gap), 6) AS max_poll_gap FROM gaps""")  # fmt: skip
def _window_stats(spark, d):
    return _flat(stats.window_stats(_ticks(spark, d), GAP))


@_query("unique_matches", f"WITH {cte('v_ticks')} SELECT DISTINCT {KEY} FROM v_ticks")
def _unique_matches(spark, d):
    return stats.unique_matches(_ticks(spark, d))


@_query("poll_summary", f"WITH {cte('v_ticks')}, st AS (SELECT *, {STATUS} AS status, is_arb = 1 AND closed = 0 AS hit FROM v_ticks) SELECT epoch_us(observed_at) AS observed_at, count(*) AS quoted, count(*) FILTER (WHERE closed = 1) AS closed, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit AND status = 'live') AS live_hits, count(*) FILTER (WHERE hit AND status <> 'live') AS other_hits FROM st GROUP BY 1")
def _poll_summary(spark, d):
    return _flat(jobs.poll_summary(_ticks(spark, d)))


def _book(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_book_ticks")


def _snap_cte(source: str = "v_book_ticks", part: str = "") -> str:
    by = "profit DESC, best_edge DESC, observed_at, tick_id"
    return f"""thr(min_edge, inclusive) AS {THR},
q AS (SELECT b.*, min_edge, inclusive, coalesce(exec_profit, 0) AS profit, coalesce(exec_qty, 0) AS qty, {STATUS} AS status FROM {source} b CROSS JOIN thr WHERE is_exec = 1 AND CASE WHEN inclusive THEN best_edge >= min_edge ELSE best_edge > min_edge END),
snap AS (SELECT {part}min_edge, inclusive, {KEY}, first(level ORDER BY observed_at, tick_id) AS level, first(best_trade ORDER BY {by}) AS best_trade, first(profit ORDER BY {by}) AS peak_profit, first(qty ORDER BY {by}) AS peak_qty, first(best_edge ORDER BY {by}) AS peak_edge,
  count(*) AS exec_ticks, CASE WHEN bool_or(status = 'live') THEN 1 ELSE first(live ORDER BY observed_at, tick_id) END AS live, first(ended ORDER BY observed_at, tick_id) AS ended, CASE WHEN bool_or(status = 'live') THEN 'live' ELSE first(status ORDER BY observed_at, tick_id) END AS status FROM q GROUP BY {part}min_edge, inclusive, {KEY})"""


_SNAP = f"WITH {cte('v_book_ticks')}, {_snap_cte()}"
_SNAP_COLUMNS = f"min_edge, inclusive, {KEY}, level, best_trade, round(peak_profit, 6) AS peak_profit, round(peak_qty, 6) AS peak_qty, round(peak_edge, 6) AS peak_edge, exec_ticks, live, ended, status"


@_query("best_snapshots", f"{_SNAP} SELECT {_SNAP_COLUMNS} FROM snap")
def _best_snapshots(spark, d):
    return _flat(book_stats.best_snapshots(_book(spark, d)))


@_query("largest_snapshots", f"{_SNAP} SELECT {_SNAP_COLUMNS} FROM snap WHERE NOT inclusive ORDER BY snap.peak_profit DESC, snap.peak_edge DESC, team_a, {KEY} LIMIT 5")
def _largest_snapshots(spark, d):
    return _flat(book_stats.largest_snapshots(book_stats.best_snapshots(_book(spark, d), episodes.THRESHOLDS[:1])))


@_query("profit_buckets", f"""{_SNAP}, b(label, low, high) AS (VALUES ('under $1', -1e18, 1.0), ('$1-$10', 1.0, 10.0), ('$10-$100', 10.0, 100.0), ('$100+', 100.0, 1e18)), gr AS (SELECT DISTINCT min_edge, inclusive FROM snap)
  SELECT gr.min_edge, gr.inclusive, label, count(peak_profit) AS matches, round(coalesce(sum(peak_profit), 0.0), 6) AS gross_profit, round(coalesce(sum(peak_qty), 0.0), 6) AS gross_qty FROM gr CROSS JOIN b LEFT JOIN snap s ON s.min_edge = gr.min_edge AND s.peak_profit >= low AND s.peak_profit < high GROUP BY ALL""")  # fmt: skip
def _profit_buckets(spark, d):
    return _flat(book_stats.profit_buckets(book_stats.best_snapshots(_book(spark, d)), "min_edge", "inclusive"))


_SUM = "count(*) AS matches, round(coalesce(sum(peak_profit), 0.0), 6) AS gross_profit, round(coalesce(sum(peak_qty), 0.0), 6) AS gross_qty, round(median(peak_profit), 6) AS median_profit, round(median(peak_qty), 6) AS median_qty, round(max(peak_profit), 6) AS max_profit, CAST(sum(exec_ticks) AS BIGINT) AS exec_ticks"


@_query("snapshot_summary", f"{_SNAP} SELECT min_edge, inclusive, {_SUM} FROM snap GROUP BY ALL")
def _snapshot_summary(spark, d):
    return _flat(book_stats.snapshot_summary(book_stats.best_snapshots(_book(spark, d)), "min_edge", "inclusive"))


def _blocks_sql(source: str, part: str) -> str:
    """Episodes and snapshots of each threshold (and slice), for source with is_exec."""
    snap = _snap_cte(source, part).split("\n", 1)[1]
    by = f"{part}min_edge, inclusive"
    groups = f"(SELECT DISTINCT slice FROM {source}) CROSS JOIN thr" if part else "thr"
    return f"""{_episode_cte("pt", part)}, {snap},
sm AS (SELECT {by}, {_SUM} FROM snap GROUP BY ALL), es AS (SELECT {by}, {DUR} FROM ep GROUP BY ALL),
blocks AS (SELECT {by}, coalesce(matches, 0) AS matches, coalesce(gross_profit, 0.0) AS gross_profit, coalesce(gross_qty, 0.0) AS gross_qty, median_profit, median_qty, max_profit, coalesce(exec_ticks, 0) AS exec_ticks, coalesce(n, 0) AS n, coalesce(open_n, 0) AS open_n, mean, median, min, max
  FROM {groups} LEFT JOIN sm USING ({by}) LEFT JOIN es USING ({by}))"""


_SLICED = "sl AS (SELECT *, sport AS slice FROM v_book_ticks UNION ALL SELECT *, 'tennis/' || level FROM v_book_ticks WHERE sport = 'tennis')"


@_query("edge_blocks", f"WITH {cte('v_book_ticks')}, pt AS (SELECT *, 0 AS closed FROM v_book_ticks), {_blocks_sql('v_book_ticks', '')} SELECT * FROM blocks")
def _edge_blocks(spark, d):
    return _flat(book_stats.edge_blocks(_book(spark, d), gap_break=GAP))


@_query("sport_slices", f"""WITH {cte('v_book_ticks')}, {_SLICED}, pt AS (SELECT *, 0 AS closed FROM sl), {_blocks_sql('sl', 'slice, ')}, ct AS (SELECT slice, count(DISTINCT (sport, game_date, team_a, team_b)) AS quoted_matches, count(*) AS ticks FROM sl GROUP BY 1)
  SELECT blocks.*, quoted_matches, ticks, CASE split_part(slice, '/', 1) WHEN 'nfl' THEN 0 WHEN 'cfb' THEN 1 ELSE 2 END AS rank FROM blocks JOIN ct USING (slice)""")  # fmt: skip
def _sport_slices(spark, d):
    return _flat(book_stats.slice_stats(_book(spark, d), gap_break=GAP))


@_query("closest_misses", f"WITH {cte('v_book_ticks')}, m AS (SELECT *, max(is_exec) OVER (PARTITION BY observed_at) AS any_hit FROM v_book_ticks), r AS (SELECT *, row_number() OVER (PARTITION BY observed_at ORDER BY best_cost, {KEY}) AS rank FROM m WHERE any_hit = 0) SELECT epoch_us(observed_at) AS observed_at, {KEY}, round(best_cost, 6) AS best_cost, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def _closest_misses(spark, d):
    return _flat(jobs.closest_misses(_book(spark, d)).select("observed_at", *episodes.MATCH_KEY, "best_cost", "rank"))


# Ladders: the SQL pairs overlapping quantity intervals; the query sweeps.
_WALK = f"""WITH {cte('v_levels')}, c AS (SELECT match_id, side, price, CAST(sum(qty) OVER w AS DOUBLE) AS hi, CAST(sum(qty) OVER w - qty AS DOUBLE) AS lo FROM v_levels WINDOW w AS (PARTITION BY match_id, side ORDER BY price)),
x AS (SELECT match_id, least(l.hi, r.hi) - greatest(l.lo, r.lo) AS size, round(l.price + r.price, 4) AS combined FROM (SELECT * FROM c WHERE side = 'L') l JOIN (SELECT * FROM c WHERE side = 'R') r USING (match_id) WHERE least(l.hi, r.hi) > greatest(l.lo, r.lo)),
walk AS (SELECT match_id, sum(size) AS qty, sum(size * combined) AS total_cost FROM x WHERE combined < 1.0 GROUP BY 1),
tops AS (SELECT match_id, min(price) FILTER (WHERE side = 'L') AS left_ask, min(price) FILTER (WHERE side = 'R') AS right_ask FROM v_levels GROUP BY 1),
dirs AS (SELECT match_id, left_ask, right_ask, round(left_ask + right_ask, 4) AS combined_best, coalesce(qty, 0.0) AS qty, coalesce(total_cost / qty, round(left_ask + right_ask, 4)) AS avg_cost, coalesce(qty - total_cost, 0.0) AS profit,
  coalesce(1 - total_cost / qty, round(1 - round(left_ask + right_ask, 4), 4)) AS edge, CASE WHEN qty IS NULL THEN 0 ELSE 1 END AS is_exec FROM tops LEFT JOIN walk USING (match_id) WHERE left_ask IS NOT NULL AND right_ask IS NOT NULL)"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_levels").withColumn("qty", F.col("qty").cast("double"))


@_query("ladder_walk", f"{_WALK} SELECT match_id, round(qty + 1e-9, 6) AS qty, round(total_cost + 1e-9, 6) AS total_cost, round(total_cost / qty + 1e-9, 6) AS avg_cost, round(qty - total_cost + 1e-9, 6) AS profit, round(1 - total_cost / qty + 1e-9, 6) AS edge FROM walk")
def _ladder_walk(spark, d):
    return _flat_up(ladders.walk_ladders(_levels(spark, d)))


_DIRS = "round(left_ask + 1e-9, 6) AS left_ask, round(right_ask + 1e-9, 6) AS right_ask, round(combined_best + 1e-9, 6) AS combined_best, round(qty + 1e-9, 6) AS qty, round(avg_cost + 1e-9, 6) AS avg_cost, round(profit + 1e-9, 6) AS profit, round(edge + 1e-9, 6) AS edge, is_exec"


@_query("exec_directions", f"{_WALK} SELECT match_id, {_DIRS} FROM dirs")
def _exec_directions(spark, d):
    return _flat_up(ladders.score_directions(_levels(spark, d)))


@_query("best_direction", f"{_WALK}, r AS (SELECT *, match_id // 2 AS game, match_id % 2 AS dir, row_number() OVER (PARTITION BY match_id // 2 ORDER BY is_exec DESC, round(edge + 1e-12, 9) DESC, match_id % 2) AS n FROM dirs) SELECT game AS team_a, dir, {_DIRS} FROM r WHERE n = 1")
def _best_direction(spark, d):
    dirs = ladders.score_directions(_levels(spark, d)).withColumns({"sport": F.lit("x"), "game_date": F.lit("x"), "team_a": F.expr("match_id div 2"), "team_b": F.lit("x"), "dir": F.col("match_id") % 2})
    return _flat_up(ladders.best_direction(dirs.drop("match_id")).drop("sport", "game_date", "team_b"))


def _listings(spark: SparkSession, d: str, venue: str) -> DataFrame:
    return view(spark, d, "v_listings").where(F.col("venue") == venue).withColumns({"sport": F.lit("nfl"), "level": F.lit("pro")})


_GROUPED = f"""WITH {cte('v_listings')}, gg AS (SELECT venue, least(team, opponent) AS team_a, greatest(team, opponent) AS team_b, game_date, min(src_ord) AS ord, last(yes_price ORDER BY src_ord) FILTER (WHERE team < opponent) AS pa, last(yes_price ORDER BY src_ord) FILTER (WHERE team > opponent) AS pb,
  last(market_id ORDER BY src_ord) FILTER (WHERE team < opponent) AS ma, last(market_id ORDER BY src_ord) FILTER (WHERE team > opponent) AS mb FROM v_listings GROUP BY 1, 2, 3, 4)"""


@_query("group_games", f"{_GROUPED} SELECT venue, team_a, team_b, CAST(game_date AS VARCHAR) AS game_date, ord, round(pa, 6) AS yes_a, round(pb, 6) AS yes_b, ma AS market_a, mb AS market_b FROM gg")
def _group_games(spark, d):
    df = matching.group_games(view(spark, d, "v_listings").withColumn("sport", F.col("venue")))
    return _flat(df.select(F.col("sport").alias("venue"), F.get("pair", F.lit(0)).alias("team_a"), F.get("pair", F.lit(1)).alias("team_b"), F.col("game_date").cast("string").alias("game_date"), "ord", F.col("a.yes_price").alias("yes_a"), F.col("b.yes_price").alias("yes_b"), F.col("a.market_id").alias("market_a"), F.col("b.market_id").alias("market_b")))


_MATCHED = f"""{_GROUPED}, cand AS (SELECT k.team_a, k.team_b, k.ord AS k_ord, p.ord AS p_ord, abs(date_diff('day', p.game_date, k.game_date)) AS delta, p.game_date AS p_date FROM gg k JOIN gg p USING (team_a, team_b) WHERE k.venue = 'K' AND p.venue = 'P' AND abs(date_diff('day', p.game_date, k.game_date)) <= {WEEK}),
lists AS (SELECT list_prepend({{'k': CAST(-1 AS BIGINT), 'p': CAST(-1 AS BIGINT), 'used': CAST([] AS STRUCT(k BIGINT, p BIGINT)[])}}, list({{'k': CAST(k_ord AS BIGINT), 'p': CAST(p_ord AS BIGINT), 'used': CAST([] AS STRUCT(k BIGINT, p BIGINT)[])}} ORDER BY k_ord, delta, p_date, p_ord)) AS l FROM cand GROUP BY team_a, team_b),
folded AS (SELECT list_reduce(l, lambda s, x: {{'k': x.k, 'p': x.p, 'used': CASE WHEN len(list_filter(s.used, lambda u: u.k = x.k OR u.p = x.p)) > 0 THEN s.used ELSE list_append(s.used, {{'k': x.k, 'p': x.p}}) END}}) AS r FROM lists),
asg AS (SELECT u.k AS k_ord, u.p AS p_ord FROM (SELECT unnest(r.used) AS u FROM folded)),
mt AS (SELECT k.team_a, k.team_b, k.game_date AS game_date, p.game_date AS poly_game_date, k.pa AS ka, k.pb AS kb, p.pa AS pa, p.pb AS pb, k.ma AS kma, p.ma AS pma, p.mb AS pmb FROM asg JOIN gg k ON k.ord = k_ord AND k.venue = 'K' JOIN gg p ON p.ord = p_ord AND p.venue = 'P')"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_markets(_listings(spark, d, "K"), _listings(spark, d, "P"), days=WEEK)


@_query("match_exact", f"{_MATCHED} SELECT team_a, team_b, CAST(game_date AS VARCHAR) AS game_date, CAST(poly_game_date AS VARCHAR) AS poly_game_date, round(ka, 6) AS kalshi_yes_a, round(kb, 6) AS kalshi_yes_b, round(pa, 6) AS poly_yes_a, round(pb, 6) AS poly_yes_b, kma AS kalshi_id_a, coalesce(pma, pmb) AS poly_id FROM mt")
def _match_exact(spark, d):
    return _flat(_matches(spark, d).select("team_a", "team_b", "game_date", "poly_game_date", "kalshi_yes_a", "kalshi_yes_b", "poly_yes_a", "poly_yes_b", "kalshi_id_a", "poly_id"))


_SCORED = f"""{_MATCHED}, sc AS (SELECT team_a, team_b, CAST(game_date AS VARCHAR) AS game_date, round(pa - ka, 4) AS team_a_price_diff, round(pb - kb, 4) AS team_b_price_diff, round(ka + pb, 4) AS kalshi_a_plus_poly_b, round(pa + kb, 4) AS poly_a_plus_kalshi_b,
  round(least(ka + pb, pa + kb), 4) AS best_cost, round(1 - least(ka + pb, pa + kb), 4) AS best_edge, CASE WHEN 1 - least(ka + pb, pa + kb) > 0 THEN 1 ELSE 0 END AS is_arb,
  CASE WHEN ka + pb <= pa + kb THEN 'buy ' || team_a || ' Kalshi YES + ' || team_b || ' Polymarket YES' ELSE 'buy ' || team_a || ' Polymarket YES + ' || team_b || ' Kalshi YES' END AS best_trade FROM mt WHERE ka + kb + pa + pb IS NOT NULL)"""
_SCORE_COLUMNS = ("team_a", "team_b", "game_date", "team_a_price_diff", "team_b_price_diff", "kalshi_a_plus_poly_b", "poly_a_plus_kalshi_b", "best_cost", "best_edge", "is_arb", "best_trade")


@_query("score_arbs", f"{_SCORED} SELECT * FROM sc")
def _score_arbs(spark, d):
    return _flat(scoring.score_arbs(_matches(spark, d)).select(*_SCORE_COLUMNS))


@_query("top_arbs", f"{_SCORED} SELECT * FROM sc WHERE is_arb = 1 ORDER BY best_edge DESC, game_date, team_a, team_b LIMIT 12")
def _top_arbs(spark, d):
    return _flat(jobs.top_arbs(scoring.score_arbs(_matches(spark, d))).select(*_SCORE_COLUMNS))


@_query("arb_history", f"{_SCORED} SELECT *, 'discovery' AS source FROM sc WHERE is_arb = 1")
def _arb_history(spark, d):
    from .sources.sinks import arb_rows

    return _flat(arb_rows(scoring.score_arbs(_matches(spark, d)).select(*_SCORE_COLUMNS), "discovery"))


@_query("discovery_summary", f"{_SCORED} SELECT (SELECT count(*) FROM v_listings) AS markets, (SELECT count(*) FROM mt) AS matches, CAST(0 AS BIGINT) AS live, CAST(0 AS BIGINT) AS ended, count(*) FILTER (WHERE is_arb = 1) AS hits, count(*) AS compared FROM sc")
def _discovery_summary(spark, d):
    m = _matches(spark, d)
    return jobs.discovery_summary(view(spark, d, "v_listings"), m, scoring.score_arbs(m))


@_query("dedupe_last", f"WITH {cte('v_listings')} SELECT venue, team, game_date, src_ord, round(yes_price, 6) AS yes_price FROM (SELECT *, row_number() OVER (PARTITION BY venue, team, game_date ORDER BY src_ord DESC) AS n FROM v_listings) WHERE n = 1")
def _dedupe_last(spark, d):
    return _flat(matching.dedupe_last(view(spark, d, "v_listings"), ["venue", "team", "game_date"], "src_ord").select("venue", "team", "game_date", "src_ord", "yes_price"))


@_query("level_counts", f"WITH {cte('v_ticks')} SELECT sport, best_trade AS exchange, level, count(*) AS n FROM v_ticks GROUP BY ALL")
def _level_counts(spark, d):
    return jobs.level_counts(_ticks(spark, d).withColumnRenamed("best_trade", "exchange"))


# Names: joined within a key, the predicate being the residual condition.
_PLAYER = "nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), '')"
_STOPS = "['de','da','das','dos','del','van','von','la','le','di','du','']"
_TOKENS = "list_filter(string_split({}, ' '), lambda t: NOT list_contains(" + _STOPS + ", t))"


@_query("fuzzy_pairs", f"""WITH n AS (SELECT DISTINCT {_PLAYER.format('p_name')} AS id, p_size FROM part), t AS (SELECT *, {_TOKENS.format('id')} AS w FROM n)
  SELECT DISTINCT a.id AS left_name, b.id AS right_name FROM t a JOIN t b USING (p_size) WHERE contains(a.id, b.id) OR contains(b.id, a.id) OR (a.w[-1] = b.w[-1] AND length(a.w[-1]) > 2 AND a.w[1][1] = b.w[1][1])""")  # fmt: skip
def _fuzzy_pairs(spark, d):
    n = view(spark, d, "part").select(scalars.player_id(F.col("p_name")).alias("id"), "p_size").distinct()
    # Names that are equal share a block.
    a, b = (n.select(F.col("id").alias(side), "p_size", F.explode(scalars.name_keys(F.col("id"), first)).alias("block")).hint("merge") for side, first in (("left_name", True), ("right_name", False)))
    return a.join(b, ["p_size", "block"]).where(scalars.names_equal(F.col("left_name"), F.col("right_name"))).select("left_name", "right_name").distinct()


# Players under short names at the second venue: "last1" alone is also within "last10", so candidates cross pairs. The SQL folds each day's
# candidates in order; the query blocks names by key and assigns in rounds.
_FULL = "concat(substr('abc', CAST({0} % 3 + 1 AS INT), 1), 'nn last', {0} % 12)"
_SHORT = "CASE WHEN {0} % 2 = 0 THEN concat(substr('abc', CAST({0} % 3 + 1 AS INT), 1), ' last', {0} % 12) ELSE concat('last', {0} % 12) END"
_PLAYED = " UNION ALL ".join(f"SELECT venue, ord, game_date, {n.format('ta')} AS x, {n.format('tb')} AS y FROM v_games WHERE venue = '{v}'" for v, n in (("K", _FULL), ("P", _SHORT)))


def _alike(a: str, b: str) -> str:
    last = "string_split({}, ' ')[-1]".format
    return f"(contains({a}, {b}) OR contains({b}, {a}) OR ({last(a)} = {last(b)} AND length({last(a)}) > 2 AND {a}[1] = {b}[1]))"


@_query("match_fuzzy", f"""WITH {cte('v_games')}, g AS (SELECT venue, least(x, y) AS team_a, greatest(x, y) AS team_b, game_date, min(ord) AS ord, max(ord) AS latest FROM ({_PLAYED}) WHERE x <> y GROUP BY ALL),
  h AS (SELECT k.team_a, k.team_b, game_date, k.ord AS k_ord, p.ord AS p_ord, k.latest AS kl, p.latest AS pl, {_alike('k.team_a', 'p.team_a')} AS h11, {_alike('k.team_a', 'p.team_b')} AS h12, {_alike('k.team_b', 'p.team_a')} AS h21, {_alike('k.team_b', 'p.team_b')} AS h22
    FROM (SELECT * FROM g WHERE venue = 'K') k JOIN (SELECT * FROM g WHERE venue = 'P') p USING (game_date)),
  cand AS (SELECT * FROM h WHERE (h11 AND h22 AND NOT (h12 AND h21)) OR (h12 AND h21 AND NOT (h11 AND h22))),
  lists AS (SELECT list_prepend({{'k': CAST(-1 AS BIGINT), 'p': CAST(-1 AS BIGINT), 'used': CAST([] AS STRUCT(k BIGINT, p BIGINT)[])}}, list({{'k': CAST(k_ord AS BIGINT), 'p': CAST(p_ord AS BIGINT), 'used': CAST([] AS STRUCT(k BIGINT, p BIGINT)[])}} ORDER BY k_ord, p_ord)) AS l FROM cand GROUP BY game_date),
  folded AS (SELECT list_reduce(l, lambda s, x: {{'k': x.k, 'p': x.p, 'used': CASE WHEN len(list_filter(s.used, lambda u: u.k = x.k OR u.p = x.p)) > 0 THEN s.used ELSE list_append(s.used, {{'k': x.k, 'p': x.p}}) END}}) AS r FROM lists),
  asg AS (SELECT u.k AS k_ord, u.p AS p_ord FROM (SELECT unnest(r.used) AS u FROM folded))
  SELECT team_a, team_b, CAST(game_date AS VARCHAR) AS game_date, 'm' || kl AS kalshi_id_a, 'm' || pl AS poly_id FROM asg JOIN cand USING (k_ord, p_ord)""")  # fmt: skip
def _match_fuzzy(spark, d):
    m = matching.match_markets(_players(spark, d, "K", _FULL), _players(spark, d, "P", _SHORT), scalars.names_equal, 0, scalars.name_keys)
    return m.select("team_a", "team_b", "game_date", "kalshi_id_a", "poly_id")


def _players(spark: SparkSession, d: str, venue: str, name: str) -> DataFrame:
    """Outcome rows of a venue's games between players under these names."""
    both = view(spark, d, "v_games").where(F.col("venue") == venue).selectExpr(f"{name.format('ta')} AS x", f"{name.format('tb')} AS y", "game_date", "ord", "concat('m', ord) AS market_id")
    rows = both.selectExpr("stack(2, x, y, ord * 2, y, x, ord * 2 + 1) AS (team, opponent, src_ord)", "game_date", "market_id")
    return rows.withColumns({"sport": F.lit("tennis"), "level": F.lit("atp"), "yes_price": F.lit(None).cast("double")})


@_query("fuzzy_candidates", f"""WITH {cte('v_games')}, g AS (SELECT venue, least(x, y) AS team_a, greatest(x, y) AS team_b, game_date, min(ord) AS ord FROM ({_PLAYED}) WHERE x <> y GROUP BY ALL),
  h AS (SELECT k.ord * 2 AS k_ord, p.ord * 2 AS p_ord, p.team_a AS p_one, p.team_b AS p_two, abs(date_diff('day', k.game_date, p.game_date)) AS delta, {_alike('k.team_a', 'p.team_a')} AS h11, {_alike('k.team_a', 'p.team_b')} AS h12, {_alike('k.team_b', 'p.team_a')} AS h21, {_alike('k.team_b', 'p.team_b')} AS h22
    FROM (SELECT *, unnest([-1, 0, 1]) AS off FROM g WHERE venue = 'K') k JOIN (SELECT * FROM g WHERE venue = 'P') p ON p.game_date = k.game_date + CAST(off AS INT))
  SELECT k_ord, p_ord, CASE WHEN h11 AND h22 THEN p_one ELSE p_two END AS map_a, CASE WHEN h11 AND h22 THEN p_two ELSE p_one END AS map_b, delta FROM h WHERE (h11 AND h22) <> (h12 AND h21)""")  # fmt: skip
def _fuzzy_candidates(spark, d):
    """All candidates whose players agree, at most a day apart, before any is assigned."""
    k, p = (matching.group_games(_players(spark, d, venue, name)) for venue, name in (("K", _FULL), ("P", _SHORT)))
    return matching.pair_candidates_fuzzy(k, p, scalars.names_equal, 1, scalars.name_keys).select("k_ord", "p_ord", "map_a", "map_b", F.col("delta").cast("long").alias("delta"))


def _book_games(levels: DataFrame) -> DataFrame:
    """A match of every two ladders; of ten, one is over."""
    return levels.selectExpr("match_id div 2 AS g").distinct().selectExpr(
        "'nfl' AS sport", "'pro' AS level", "'d' AS game_date", "CAST(g AS STRING) AS team_a", "'other' AS team_b", "concat('L', g * 2) AS kalshi_id_a", "concat('R', g * 2) AS poly_token_b", "concat('L', g * 2 + 1) AS kalshi_id_b", "concat('R', g * 2 + 1) AS poly_token_a",
        "0 AS live", "CASE WHEN g % 10 = 9 THEN 1 ELSE 0 END AS ended",
    )


@_query("book_ticks", f"""{_WALK}, r AS (SELECT *, match_id // 2 AS game, match_id % 2 AS dir, row_number() OVER (PARTITION BY match_id // 2 ORDER BY is_exec DESC, round(edge + 1e-12, 9) DESC, match_id % 2) AS n FROM dirs),
  top AS (SELECT match_id // 2 AS game, min(price) FILTER (WHERE side = 'L' AND match_id % 2 = 0) AS ka, min(price) FILTER (WHERE side = 'R' AND match_id % 2 = 1) AS pa, min(price) FILTER (WHERE side = 'L' AND match_id % 2 = 1) AS kb, min(price) FILTER (WHERE side = 'R' AND match_id % 2 = 0) AS pb FROM v_levels GROUP BY 1)
  SELECT CAST(game AS VARCHAR) AS team_a, round(ka + 1e-9, 6) AS kalshi_yes_a, round(pa + 1e-9, 6) AS poly_yes_a, round(kb + 1e-9, 6) AS kalshi_yes_b, round(pb + 1e-9, 6) AS poly_yes_b, is_exec, round(qty + 1e-9, 6) AS exec_qty, round(profit + 1e-9, 6) AS exec_profit,
  CASE WHEN dir = 0 THEN 'Buy ' || game || ' on Kalshi + other on Polymarket' ELSE 'Buy other on Kalshi + ' || game || ' on Polymarket' END AS best_trade FROM r JOIN top USING (game) WHERE n = 1 AND game % 10 <> 9""")  # fmt: skip
def _book_ticks(spark, d):
    levels = _levels(spark, d)
    games = _book_games(levels)
    books = levels.select(F.concat("side", "match_id").alias("book_id"), "price", "qty")
    return _flat_up(ladders.quote_executable(games, books).select("team_a", "kalshi_yes_a", "poly_yes_a", "kalshi_yes_b", "poly_yes_b", "is_exec", "exec_qty", "exec_profit", "best_trade"))


def _mapping(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in table.items()) + ")"


_RAW = "trim(regexp_replace(regexp_replace({}, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@_query("canonical_names", f"""WITH x AS (SELECT DISTINCT c_name AS name FROM customer UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT s_name FROM supplier UNION SELECT DISTINCT source FROM documents UNION SELECT n_name FROM nation), nfl(a, t) AS {_mapping(NFL_TEAMS)}, cfb(a, t) AS {_mapping(CFB_ALIASES)},
  y AS (SELECT name, {_PLAYER.format('name')} AS player, {_RAW.format('lower(name)')} AS n_raw, {_RAW.format("replace(replace(lower(name), '&', ' and '), 'st.', ' state ')")} AS c_raw FROM x)
  SELECT name, player, nullif(coalesce(cfb.t, c_raw), '') AS college, coalesce(n1.t, n2.t) AS pro FROM y LEFT JOIN cfb ON cfb.a = c_raw LEFT JOIN nfl n1 ON n1.a = n_raw LEFT JOIN nfl n2 ON n2.a = replace(n_raw, ' ', '')""")  # fmt: skip
def _canonical_names(spark, d):
    x = view(spark, d, "customer").select(F.col("c_name").alias("name")).union(view(spark, d, "part").select("p_name")).union(view(spark, d, "supplier").select("s_name")).union(view(spark, d, "documents").select("source")).union(view(spark, d, "nation").select("n_name")).distinct()
    return x.select("name", scalars.player_id(F.col("name")).alias("player"), scalars.cfb_team(F.col("name")).alias("college"), scalars.nfl_team(F.col("name")).alias("pro"))


@_query("report_texts", f"""{_EP}, {_ROLL} SELECT {KEY}, '[' || CASE WHEN sport = 'tennis' THEN 'tennis/' || level ELSE sport END || '] ' || game_date || ' ' || team_a || ' vs ' || team_b AS game, printf('%.2fc', peak_edge * 100) AS edge_text,
  CASE WHEN d >= 3600 THEN printf('%dh %dm %ds', d // 3600, d % 3600 // 60, d % 60) WHEN d >= 60 THEN printf('%dm %ds', d // 60, d % 60) ELSE printf('%ds', d) END AS time_text FROM (SELECT *, CAST(round_even(duration_seconds, 0) AS BIGINT) AS d FROM roll)""")  # fmt: skip
def _report_texts(spark, d):
    r = stats.match_rollups(_eps(spark, d, episodes.THRESHOLDS[:1]))
    return r.select(*episodes.MATCH_KEY, scalars.game_label(*(F.col(c) for c in ("sport", "level", "game_date", "team_a", "team_b"))).alias("game"), scalars.fmt_cents(F.col("peak_edge")).alias("edge_text"), scalars.fmt_duration(F.round("duration_seconds", 6)).alias("time_text"))


# Landed payloads made of orders, read as the feeds' are; the SQL states their contents directly.


def _orders(spark: SparkSession, d: str, payload: str) -> DataFrame:
    return view(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day").selectExpr(f"{payload} AS value")


@_query("kalshi_asks", """SELECT 'T' || k AS book_id, round(1 - p, 4) AS price, CAST(k % 7 AS DOUBLE) AS qty, epoch_us(day) AS observed_at FROM (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, CASE o_orderkey % 3 WHEN 0 THEN (1 + o_custkey % 99) / 100.0::DOUBLE
  WHEN 1 THEN CASE WHEN o_custkey % 99 > 1 THEN (o_custkey % 99) / 100.0::DOUBLE ELSE o_custkey % 99 END END AS p FROM orders) WHERE round(1 - p, 4) > 0 AND k % 7 > 0""")
def _kalshi_asks(spark, d):
    book = """concat('{"ticker": "T', k, '", "observed_at": "', day, '", "orderbook_fp": {"no_dollars": [', CASE WHEN k % 3 = 0 THEN concat('["0.', lpad(1 + c % 99, 2, '0'), '", "', k % 7, '"]') ELSE '' END, ']}, "orderbook": ', CASE WHEN k % 3 = 2 THEN 'null' ELSE concat('{"no": [[', c % 99, ', ', k % 7, ']]}') END, '}')"""
    books = _orders(spark, d, book).select(F.from_json("value", landed.K_BOOK).alias("x")).select("x.*").withColumn("observed_at", scalars.parse_ts(F.col("observed_at")))
    return _flat(outcomes.split_kalshi_book(books))


@_query("poly_asks", """SELECT 'T' || k AS book_id, p / 100.0::DOUBLE AS price, q / 4.0::DOUBLE AS qty, epoch_us(day) + 18000000000 AS observed_at FROM (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, unnest([o_custkey % 100, 7]) AS p, unnest([o_orderkey % 9, CASE WHEN o_orderkey % 2 = 0 THEN 3 END]) AS q FROM orders) WHERE p > 0 AND q > 0""")
def _poly_asks(spark, d):
    book = """concat('{"token_id": "T', k, '", "observed_at": "', day, 'T00:00:00-05:00", "asks": [{"price": "', (c % 100) / 100, '", "size": "', (k % 9) / 4, '"}, {"price": 0.07, "size": ', CASE WHEN k % 2 = 0 THEN '0.75' ELSE 'null' END, '}]}')"""
    books = _orders(spark, d, book).select(F.from_json("value", landed.P_BOOK).alias("x")).select("x.*").withColumn("observed_at", scalars.parse_ts(F.col("observed_at")))
    return _flat(outcomes.split_poly_book(books))


@_query("kalshi_quote_rows", """SELECT 'T' || k // 2 AS ticker, CASE WHEN o_custkey % 3 = 0 THEN 0.5 ELSE (o_custkey % 100) / 100.0::DOUBLE END AS yes, o_custkey % 4 > 1 AS closed, 1704067200000000 AS observed_at FROM (SELECT o_orderkey AS k, o_custkey, row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY o_orderkey % 2) AS n FROM orders) WHERE n = 1""")
def _kalshi_quote_rows(spark, d):
    market = """concat('{"ticker": "T', k div 2, '", "status": "', element_at(array('active', 'Open', 'settled', 'closed'), CAST(c % 4 + 1 AS INT)), '", "yes_ask_dollars": "', CASE WHEN c % 3 = 0 THEN '' ELSE CAST((c % 100) / 100 AS STRING) END, '", "last_price_dollars": "0.5"}')"""
    payload = f"""concat('{{"observed_at": "2024-01-01T00:00:00Z", ', CASE WHEN k % 2 = 0 THEN concat('"event": {{"markets": [', {market}, ']}}') ELSE concat('"market": ', {market}) END, '}}')"""
    return _flat(landed.kalshi_quotes(_orders(spark, d, payload).select(F.from_json("value", landed.K_QUOTE_SCHEMA).alias("x")).select("x.*")))


@_query("poly_quote_rows", """SELECT 'M' || o_orderkey AS market_id, o_custkey % 5 = 0 OR o_custkey % 7 = 0 AS closed, CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE CAST('0.' || (1 + o_custkey % 9) AS DOUBLE) END AS yes_a, CASE WHEN o_orderkey % 2 = 0 THEN CAST('0.' || (1 + o_custkey % 9) AS DOUBLE) ELSE 0.25 END AS yes_b FROM orders""")
def _poly_quote_rows(spark, d):
    market = """concat('{"observed_at": "2024-01-01T00:00:00Z", "id": "M', k, '", "closed": ', CASE WHEN c % 5 = 0 THEN 'true' ELSE 'false' END, ', "active": ', CASE WHEN c % 7 = 0 THEN '"false"' ELSE 'true' END, ', "outcomes": "[\\\\"', CASE WHEN k % 2 = 0 THEN 'Bills\\\\", \\\\"New England' ELSE 'New England\\\\", \\\\"Bills' END, '\\\\"]", "outcomePrices": "[\\\\"0.', 1 + c % 9, '\\\\", \\\\"0.25\\\\"]"}')"""
    payload = f"CASE k % 3 WHEN 0 THEN {market} WHEN 1 THEN concat('[', {market}, ', {{\"id\": \"other\"}}]') ELSE concat('{{\"market\": ', {market}, '}}') END".replace("{{", "{").replace("}}", "}")
    q = landed.poly_quote_texts(_orders(spark, d, payload)).withColumns({"sport": F.lit("nfl"), "team_a": F.lit("patriots"), "team_b": F.lit("bills")})
    return _flat(outcomes.poly_outcome_prices(q).select("market_id", "closed", "yes_a", "yes_b"))


@_query("parsed_texts", """SELECT k, CASE k % 4 WHEN 0 THEN c + 0.25 WHEN 1 THEN CAST(k AS DOUBLE) END AS price, CASE k % 4 WHEN 0 THEN epoch_us(t) + 3723000000 WHEN 1 THEN epoch_us(t) + 18000000000 WHEN 2 THEN epoch_us(t) ELSE -1 END AS place,
  CASE WHEN k % 4 < 3 THEN CAST(day AS VARCHAR) END AS game_date, CAST(day AS VARCHAR) AS slug_day, CASE WHEN k % 4 < 2 THEN CAST(day AS VARCHAR) END AS close_day, CASE WHEN k % 4 < 3 THEN CAST(day AS VARCHAR) END AS ticker_day,
  CASE k % 4 WHEN 0 THEN 'atp' WHEN 1 THEN 'challenger' END AS tour, CASE WHEN k % 4 = 0 THEN 'patriots,bills' END AS teams, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE -1 END AS listed FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS t FROM orders)""")
def _parsed_texts(spark, d):
    x = view(spark, d, "orders").selectExpr("o_orderkey AS k", "CAST(o_custkey AS STRING) AS c", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day", "upper(date_format(CAST(o_orderdate AS DATE), 'yyMMMdd')) AS code")
    pick = lambda *sql: F.expr(f"element_at(array({', '.join(sql)}), CAST(k % 4 + 1 AS INT))")
    ticker = pick("concat('KXNFLGAME-', code, 'NEBUF')", "concat('KXATPMATCH-', code, 'ABCDEF')", "concat('KXNCAAFGAME-', code)", "'KXNFLGAME-99XXX99'")
    decoded = scalars.parse_event_ticker(ticker)
    return _flat(x.select(
        "k", scalars.parse_price(pick("concat(c, '.25')", "CAST(k AS STRING)", "''", "'0.5d'")).alias("price"),
        F.coalesce(F.unix_micros(scalars.parse_ts(pick("concat(day, 'T01:02:03')", "concat(day, 'T00:00:00-05:00')", "day", "'soon'"))), F.lit(-1)).alias("place"),
        scalars.parse_game_date(pick("concat(day, 'T01:02:03')", "day", "concat(day, ' x')", "'2024-13-01'")).cast("string").alias("game_date"),
        scalars.slug_date(pick("concat('nfl-ne-buf-', day)", "concat('atp-a-b-', day)", "'nfl-ne-buf'", "''"), F.concat("day", F.lit("T23:30:00-05:00"))).alias("slug_day"),
        scalars.slug_date(F.lit("nfl-ne-buf"), pick("day", "concat(day, 'T23:30:00-05:00')", "''", "'soon'")).alias("close_day"),
        scalars.ticker_date(ticker).cast("string").alias("ticker_day"),
        scalars.tour_level(pick("'ATP'", "'itf'", "'atp'", "'nba'"), pick("'A vs B'", "'Oslo Challenger: A vs B'", "'Doubles: A vs B'", "null")).alias("tour"),
        F.array_join(decoded["teams"], ",").alias("teams"), F.coalesce(F.array_size(scalars.json_array(pick("'[\"a\", \"b\"]'", "'[1]'", "'nothing'", "null"))), F.lit(-1)).alias("listed"),
    ))


# Listings of both venues: games of four pairs a day, listed again on later pages; the first page's event counts.
_PAIRS = (("NE", "New England", "patriots", "BUF", "Buffalo", "bills"), ("GB", "Green Bay", "packers", "CHI", "Chicago", "bears"), ("DAL", "Dallas", "cowboys", "DET", "Detroit", "lions"), ("KC", "Kansas City", "chiefs", "DEN", "Denver", "broncos"))


def _of_pair(i: int) -> str:
    """Field i of the pair that the customer's number picks; SQL for both engines."""
    return "CASE c % 4 " + " ".join(f"WHEN {n} THEN '{p[i]}'" for n, p in enumerate(_PAIRS)) + " END"


_KEYED = "SELECT o_orderkey AS k, o_custkey AS c, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderdate AS DATE) AS dt FROM orders"
_K_LISTED = f"""WITH x AS ({_KEYED}), y AS (SELECT *, 'KXNFLGAME-' || upper(strftime(dt, '%y%b%d')) || {_of_pair(0)} || {_of_pair(3)} AS ev FROM x),
  f AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY k % 5, k // 5) AS n FROM y), m AS (SELECT *, unnest([0, 1]) AS pos FROM f WHERE n = 1),
  kl AS (SELECT 'kalshi' AS exchange, ev || '-' || CASE pos WHEN 0 THEN {_of_pair(0)} ELSE {_of_pair(3)} END AS market_id, ev AS event_id, CASE WHEN k % 2 = 0 THEN ev ELSE 'game ' || k END AS event_title,
    CASE pos WHEN 0 THEN {_of_pair(2)} ELSE {_of_pair(5)} END AS team, CASE pos WHEN 0 THEN {_of_pair(5)} ELSE {_of_pair(2)} END AS opponent,
    CASE WHEN pos = 0 AND k % 3 = 0 THEN 0.5 ELSE (10 + c % 80) / 100.0::DOUBLE END AS yes_price, CAST(k % 100 AS DOUBLE) AS volume, day AS game_date, day || 'T20:00:00Z' AS close_time,
    'https://kalshi.com/markets/kxnflgame/' || lower(ev) AS url, (k % 5) * 100000000 + (k // 5) * 10000 + pos AS src_ord, 0 AS live, 0 AS ended, 'nfl' AS sport, 'pro' AS level FROM m)"""


def _listed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the place of their event on the pages of a venue."""
    return view(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate", "o_orderkey % 5 AS page", "o_orderkey div 5 AS event_pos")


def _kalshi_event_texts(orders: DataFrame) -> DataFrame:
    x = orders.selectExpr("page", "event_pos", "o_orderkey AS k", "o_custkey AS c", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day", "upper(date_format(CAST(o_orderdate AS DATE), 'yyMMMdd')) AS code")
    x = x.selectExpr("*", f"concat('KXNFLGAME-', code, {_of_pair(0)}, {_of_pair(3)}) AS ev")
    market = """concat('{{"ticker": "', ev, '-', {code}, '", "yes_sub_title": "', {sub}, '", "yes_ask_dollars": "', {price}, '", "last_price_dollars": "0.5", "volume_fp": "', k % 100, '", "close_time": "', day, 'T15:00:00-05:00"}}')"""
    price = "CAST((10 + c % 80) / 100 AS STRING)"
    markets = [market.format(code=_of_pair(0), sub=_of_pair(1), price=f"CASE WHEN k % 3 = 0 THEN '' ELSE {price} END"), market.format(code=_of_pair(3), sub=_of_pair(4), price=price), market.format(code="'QQ'", sub="'nobody'", price=price)]
    event = f"""concat('{{"event_ticker": "', ev, '", "title": "', CASE WHEN k % 2 = 0 THEN '' ELSE concat('game ', k) END, '", "markets": [', {", ', ', ".join(markets)}, ']}}')"""
    return x.selectExpr("page", "event_pos", f"{event} AS value")


def _kalshi_listings(spark: SparkSession, d: str) -> DataFrame:
    events = _kalshi_event_texts(_listed_orders(spark, d)).select("page", "event_pos", F.from_json("value", landed.K_EVENT).alias("e")).select("page", "event_pos", "e.*")
    return outcomes.kalshi_outcomes(events, "nfl", "pro", "KXNFLGAME")


_P_SLUG = f"'nfl-' || lower({_of_pair(0)}) || '-' || lower({_of_pair(3)}) || '-' || day"
_P_LISTED = f"""px AS ({_KEYED}), py AS (SELECT *, {_P_SLUG} AS slug FROM px WHERE k % 7 <> 0 AND k % 11 <> 0), pf AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY k % 5, k // 5) AS n FROM py),
  pm AS (SELECT *, unnest(CASE WHEN k % 3 = 0 THEN [0, 2] ELSE [0, 1] END) AS pos FROM pf WHERE n = 1 AND c % 13 <> 0),
  pl AS (SELECT 'polymarket' AS exchange, 'M' || k AS market_id, CASE pos WHEN 0 THEN 't' || k END AS token_id, slug AS event_id, 'on ' || day AS event_title, CASE pos WHEN 0 THEN {_of_pair(2)} ELSE {_of_pair(5)} END AS team,
    CASE pos WHEN 0 THEN {_of_pair(5)} ELSE {_of_pair(2)} END AS opponent, CASE WHEN pos = 0 THEN (10 + c % 80) / 100.0::DOUBLE WHEN pos = 2 THEN 0.25 END AS yes_price, 5.0::DOUBLE AS volume, day AS game_date, day || 'T20:00:00Z' AS close_time,
    'https://polymarket.com/event/' || slug AS url, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS live, CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS ended, 'pro' AS level, (k % 5) * 100000000 + (k // 5) * 10000 + pos AS src_ord, 'nfl' AS sport FROM pm)"""


def _poly_event_texts(orders: DataFrame) -> DataFrame:
    """Events without a game's slug (k % 11 = 0), of another sport (k % 7 = 0) or without an open moneyline (c % 13 = 0) have no rows."""
    x = orders.selectExpr("page", "event_pos", "o_orderkey AS k", "o_custkey AS c", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day").selectExpr("*", f"{_P_SLUG} AS slug")
    outs = f"""concat('[\\\\"', {_of_pair(1)}, CASE WHEN k % 3 = 0 THEN concat('\\\\", \\\\"', {_of_pair(0)}) ELSE '' END, '\\\\", \\\\"', {_of_pair(4)}, '\\\\"]')"""
    prices = """concat('[\\\\"', (10 + c % 80) / 100, '\\\\"', CASE WHEN k % 3 = 0 THEN ', \\\\"0.9\\\\", \\\\"0.25\\\\"' ELSE '' END, ']')"""
    line = """concat('{{"id": "', {id}, '", "sportsMarketType": "', {kind}, '", "closed": ', {closed}, ', "outcomes": "', {outs}, '", "outcomePrices": "', {prices}, '", "clobTokenIds": "[\\\\"t', k, '\\\\"]", "volume": "5", "endDate": "', day, 'T20:00:00Z"}}')"""
    lines = [line.format(id=i, kind=kind, closed=closed, outs=outs, prices=prices) for i, kind, closed in (("concat('S', k)", "'spreads'", "'false'"), ("concat('C', k)", "'moneyline'", "'true'"), ("concat('M', k)", "'moneyline'", "CASE WHEN c % 13 = 0 THEN 'true' ELSE 'false' END"))]
    event = f"""concat('{{"id": "', slug, '", "slug": "', CASE WHEN k % 11 = 0 THEN 'nfl-season-winner' ELSE slug END, '", "title": "on ', day, '", "sport": ', CASE WHEN k % 7 = 0 THEN '"nba"' WHEN k % 2 = 0 THEN '"nfl"' ELSE '{{"sport": "nfl"}}' END,
      ', "teams": [], "live": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, ', "ended": ', CASE WHEN k % 4 = 1 THEN '"1"' ELSE 'null' END, ', "markets": [', {", ', ', ".join(lines)}, ']}}')"""
    return x.selectExpr("page", "event_pos", f"{event} AS value")


def _poly_listings(spark: SparkSession, d: str) -> DataFrame:
    events = _poly_event_texts(_listed_orders(spark, d)).select("page", "event_pos", F.from_json("value", landed.P_EVENT).alias("e")).select("page", "event_pos", "e.*")
    return outcomes.poly_outcomes(events, "nfl")


@_query("kalshi_listing_rows", f"{_K_LISTED} SELECT * FROM kl")
def _kalshi_listing_rows(spark, d):
    return _flat(_kalshi_listings(spark, d))


@_query("poly_listing_rows", f"WITH {_P_LISTED} SELECT * FROM pl")
def _poly_listing_rows(spark, d):
    return _flat(_poly_listings(spark, d))


@_query("listing_counts", f"{_K_LISTED}, {_P_LISTED} SELECT sport, exchange, level, count(*) AS n FROM (SELECT sport, exchange, level FROM kl UNION ALL SELECT sport, exchange, level FROM pl) GROUP BY ALL")
def _listing_counts(spark, d):
    return jobs.level_counts(jobs.union([_kalshi_listings(spark, d), _poly_listings(spark, d)]))


# Quotes of a match for every order, at two times: the second side of the first venue is missing at the second time for two of three.
_Q = {"ka": "CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(2 + (k * 7 + t * 3) % 60 AS DOUBLE) / 100 END", "kb": "CAST(2 + (k * 5 + t) % 60 AS DOUBLE) / 100", "pa": "CAST(2 + (k * 3 + t) % 60 AS DOUBLE) / 100", "pb": "CAST(2 + (k + t * 31) % 60 AS DOUBLE) / 100", "closed": "(k + t) % 13 = 0"}


@_query("price_ticks", f"""WITH x AS (SELECT o_orderkey AS k, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS us, unnest([0, 1]) AS t FROM orders),
  q AS (SELECT k, us + t * 3600000000 AS observed_at, {_Q['ka']} AS ka, CASE WHEN t = 0 OR k % 3 = 0 THEN {_Q['kb']} END AS kb, {_Q['pa']} AS pa, {_Q['pb']} AS pb, {_Q['closed']} AS closed FROM x),
  s AS (SELECT *, ka + kb + pa + pb IS NOT NULL AS priced, CASE WHEN ka + pb <= pa + kb THEN ka + pb ELSE pa + kb END AS best FROM q)
  SELECT 'a' || k AS team_a, 'b' || k AS team_b, observed_at, round(ka, 6) AS kalshi_yes_a, round(kb, 6) AS kalshi_yes_b, round(pa, 6) AS poly_yes_a, round(pb, 6) AS poly_yes_b, CASE WHEN closed THEN 1 ELSE 0 END AS closed, CASE WHEN priced THEN round(best, 4) END AS best_cost, CASE WHEN priced THEN round(1 - best, 4) END AS best_edge,
    CASE WHEN priced AND 1 - best > 0 THEN 1 ELSE 0 END AS is_arb, CASE WHEN NOT priced THEN NULL WHEN ka + pb <= pa + kb THEN 'buy a' || k || ' Kalshi YES + b' || k || ' Polymarket YES' ELSE 'buy a' || k || ' Polymarket YES + b' || k || ' Kalshi YES' END AS best_trade FROM s WHERE closed OR priced""")  # fmt: skip
def _price_ticks(spark, d):
    x = view(spark, d, "orders").selectExpr("o_orderkey AS k", "make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 0, 0, 0, 'UTC') AS at")
    m = x.selectExpr("'tennis' AS sport", "'atp' AS level", "'d' AS game_date", "concat('a', k) AS team_a", "concat('b', k) AS team_b", "concat('A', k) AS kalshi_id_a", "concat('B', k) AS kalshi_id_b", "concat('P', k) AS poly_id", "0 AS live", "0 AS ended")
    at = jobs.union([x.selectExpr("k", f"{t} AS t", f"timestampadd(HOUR, {t}, at) AS observed_at") for t in (0, 1)])
    k = at.selectExpr("observed_at", "concat('A', k) AS ticker", f"{_Q['ka']} AS yes", f"{_Q['closed']} AS closed").unionByName(at.where("t = 0 OR k % 3 = 0").selectExpr("observed_at", "concat('B', k) AS ticker", f"{_Q['kb']} AS yes", "false AS closed"))
    p = at.selectExpr("observed_at", "concat('P', k) AS market_id", "array(concat('B', k), concat('a', k)) AS outcomes", f"array(CAST({_Q['pb']} AS STRING), CAST({_Q['pa']} AS STRING)) AS prices", "false AS closed")
    return _flat(scoring.score_quotes(scoring.quote_matches(m, k, p)).select("team_a", "team_b", "observed_at", *scoring.PRICES, "closed", "best_cost", "best_edge", "is_arb", "best_trade"))


def _open_games(levels: DataFrame) -> DataFrame:
    """A match of every two ladders; of ten, one is over and one live."""
    return levels.selectExpr("match_id div 2 AS g").distinct().selectExpr(
        "'nfl' AS sport", "'pro' AS level", "'d' AS game_date", "lpad(CAST(g AS STRING), 12, '0') AS team_a", "'other' AS team_b", "concat('L', g * 2) AS kalshi_id_a", "concat('R', g * 2) AS poly_token_b", "concat('L', g * 2 + 1) AS kalshi_id_b", "concat('R', g * 2 + 1) AS poly_token_a",
        "CASE WHEN g % 10 = 8 THEN 1 ELSE 0 END AS live", "CASE WHEN g % 10 = 9 THEN 1 ELSE 0 END AS ended",
    )


_OPEN = f"""{_WALK}, od AS (SELECT lpad(CAST(match_id // 2 AS VARCHAR), 12, '0') AS team_a, match_id % 2 AS dir, left_ask AS kalshi_ask, right_ask AS poly_ask, combined_best, qty, avg_cost, profit, edge, is_exec, CASE WHEN match_id // 2 % 10 = 8 THEN 1 ELSE 0 END AS live FROM dirs WHERE match_id // 2 % 10 <> 9)"""
_OPEN_SQL = "team_a, dir, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("kalshi_ask", "poly_ask", "combined_best", "qty", "avg_cost", "profit", "edge")) + ", is_exec, live, CASE WHEN dir = 0 THEN 'Buy ' || team_a || ' on Kalshi + other on Polymarket' ELSE 'Buy other on Kalshi + ' || team_a || ' on Polymarket' END AS direction"
_OPEN_COLUMNS = ("team_a", "dir", "kalshi_ask", "poly_ask", "combined_best", "qty", "avg_cost", "profit", "edge", "is_exec", "live", "direction")


def _directions(spark: SparkSession, d: str) -> DataFrame:
    levels = _levels(spark, d)
    return ladders.executable_directions(_open_games(levels), levels.select(F.concat("side", "match_id").alias("book_id"), "price", "qty"))


@_query("executable_hits", f"{_OPEN} SELECT {_OPEN_SQL} FROM od WHERE is_exec = 1")
def _executable_hits(spark, d):
    return _flat_up(ladders.executable_report(_directions(spark, d))[0].select(*_OPEN_COLUMNS))


@_query("executable_misses", f"{_OPEN} SELECT {_OPEN_SQL} FROM od WHERE is_exec = 0 ORDER BY od.combined_best, team_a, dir LIMIT 5")
def _executable_misses(spark, d):
    return _flat_up(ladders.executable_report(_directions(spark, d))[1].select(*_OPEN_COLUMNS))


@_query("book_poll_summary", f"WITH {cte('v_book_ticks')}, st AS (SELECT *, {STATUS} AS status, is_exec = 1 AS hit FROM v_book_ticks) SELECT epoch_us(observed_at) AS observed_at, count(*) AS quoted, CAST(0 AS BIGINT) AS closed, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit AND status = 'live') AS live_hits, count(*) FILTER (WHERE hit AND status <> 'live') AS other_hits FROM st GROUP BY 1")
def _book_poll_summary(spark, d):
    return _flat(jobs.poll_summary(view(spark, d, "v_book_ticks").drop("is_arb", "closed")))


@_query("ordered_matches", f"{_MATCHED} SELECT team_a, team_b, CAST(game_date AS VARCHAR) AS game_date FROM mt ORDER BY game_date, team_a, team_b LIMIT 8")
def _ordered_matches(spark, d):
    return jobs.ordered_matches(_matches(spark, d)).select("team_a", "team_b", "game_date")


@_query("value_texts", """SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) || ' 00:00:00 UTC' AS day_text, '$' || format('{:,.2f}', CAST(o_custkey * 1001 + 0.25 AS DOUBLE)) AS dollars,
  CASE WHEN o_orderkey % 2 = 0 THEN format('{:,}', o_custkey * 1001) ELSE format('{:,.1f}', CAST(o_custkey * 1001 + 0.3 AS DOUBLE)) END AS quantity, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 99) || 'c' ELSE (o_custkey % 99) || '.3c' END AS cents,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || '.30' END AS size, CASE o_orderkey % 4 WHEN 0 THEN 'tennis/atp' WHEN 1 THEN 'tennis' WHEN 2 THEN 'nfl' ELSE '?' END AS sport_text FROM orders""")
def _value_texts(spark, d):
    x = view(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 0, 0, 0, 'UTC') AS at")
    part = F.when(F.col("k") % 2 == 0, 0.0).otherwise(0.3)
    sport = F.expr("element_at(array('tennis', 'tennis', 'nfl', ''), CAST(k % 4 + 1 AS INT))")
    return x.select(
        "k", scalars.fmt_ts(F.col("at")).alias("day_text"), scalars.fmt_dollars(F.col("c") * 1001 + F.lit(0.25)).alias("dollars"), scalars.fmt_qty(F.col("c") * 1001 + part).alias("quantity"),
        scalars.price_cents((F.col("c") % 99 + part) / 100).alias("cents"), scalars.fmt_size(F.col("c") + part).alias("size"), scalars.sport_label(sport, F.when(F.col("k") % 4 == 1, "").otherwise("atp")).alias("sport_text"),
    )


def _sizes(report: dict[str, DataFrame]) -> DataFrame:
    """Rows of every section of a report."""
    return jobs.union([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name, df in report.items()])


@_query("price_report", f"""{_EP}, zero AS (SELECT * FROM ep WHERE NOT inclusive), r AS (SELECT DISTINCT {KEY} FROM zero) SELECT * FROM (SELECT 'window' AS section, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'episodes', count(*) FROM ep UNION ALL SELECT 'rollups', count(*) FROM r UNION ALL SELECT 'largest', least(count(*), 5) FROM r
  UNION ALL SELECT 'durations', count(DISTINCT min_edge) FROM ep UNION ALL SELECT 'thresholds', count(DISTINCT min_edge) FROM ep UNION ALL SELECT 'by_status', count(DISTINCT status) FROM st UNION ALL SELECT 'by_sport', count(DISTINCT sport) + count(DISTINCT CASE WHEN sport = 'tennis' THEN level END) FROM st
  UNION ALL SELECT 'top_episodes', CAST(sum(least(n, 5)) AS BIGINT) FROM (SELECT count(*) AS n FROM ep WHERE min_edge >= 0.02 GROUP BY min_edge))""")  # fmt: skip
def _price_report(spark, d):
    return _sizes(jobs.analyze_prices(_ticks(spark, d), GAP))


_SLICES = "CAST(4 * (count(DISTINCT sport) + count(DISTINCT CASE WHEN sport = 'tennis' THEN level END)) AS BIGINT)"


@_query("book_report", f"""{_SNAP} SELECT 'window' AS section, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'snapshots', count(*) FROM snap UNION ALL SELECT 'largest', least(count(*), 5) FROM snap WHERE NOT inclusive
  UNION ALL SELECT 'buckets', 4 * count(DISTINCT min_edge) FROM snap UNION ALL SELECT 'blocks', CAST(4 AS BIGINT) UNION ALL SELECT 'slices', {_SLICES} FROM v_book_ticks""")
def _book_report(spark, d):
    return _sizes(jobs.analyze_books(view(spark, d, "v_book_ticks"), GAP))


# Contents of both reports in a long form: a row for each number of each section, found by the section's texts and keys.
_EPISODE_KEYS = ("min_edge", *episodes.MATCH_KEY, "level", "best_trade", "start", "status")
_ROLL_KEYS = (*episodes.MATCH_KEY, "level", "best_trade", "status")
_SNAP_KEYS = ("min_edge", *_ROLL_KEYS)
_TEXTS = ("game", "edge_text", "time_text")
_HEAD = f"WITH {cte('v_ticks')}"
_BOOK_WINDOW = f"WITH {cte('v_book_ticks')}" + _SQL["window_stats"].removeprefix(_HEAD).replace("v_ticks", "v_book_ticks")
#: Section: its keys and its SQL.
_PRICE_SECTIONS = {
    "window": ((), _SQL["window_stats"]), "episodes": (_EPISODE_KEYS, f"{_EP} SELECT {_EP_COLUMNS} FROM ep"), "rollups": (_ROLL_KEYS, _SQL["match_rollups"]),
    "largest": ((*_ROLL_KEYS, *_TEXTS), f"SELECT * FROM ({_SQL['largest_rollups']}) JOIN ({_SQL['report_texts']}) USING ({KEY})"), "durations": (("min_edge",), _SQL["duration_stats"]), "thresholds": (("min_edge",), _SQL["threshold_counts"]),
    "by_status": (("status",), _SQL["status_breakdown"]), "by_sport": (("sport", "tour"), _SQL["sport_breakdown"]), "top_episodes": (_EPISODE_KEYS, _SQL["top_episodes"]),
}
_BOOK_SECTIONS = {
    "window": ((), _BOOK_WINDOW), "snapshots": (_SNAP_KEYS, _SQL["best_snapshots"]), "largest": (_SNAP_KEYS, _SQL["largest_snapshots"]), "buckets": (("min_edge", "label"), _SQL["profit_buckets"]),
    "blocks": (("min_edge",), _SQL["edge_blocks"]), "slices": (("slice", "min_edge"), _SQL["sport_slices"]),
}


def _long_sql(sections: dict[str, tuple[tuple[str, ...], str]]) -> str:
    out = []
    for section, (keys, sql) in sections.items():
        key = "concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) + ")" if keys else "''"
        rest = f"* EXCLUDE ({', '.join(keys)})" if keys else "*"
        out.append(f"SELECT '{section}' AS section, key, name, value FROM (UNPIVOT (SELECT {key} AS key, CAST(COLUMNS({rest}) AS DOUBLE) FROM ({sql})) ON COLUMNS(* EXCLUDE (key)) INTO NAME name VALUE value)")
    return " UNION ALL ".join(out)


def _long(report: dict[str, DataFrame], sections: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """Rows (section, key, name, value) of a report; numbers that are null have none."""
    out = []
    for section, df in report.items():
        keys, df = sections[section][0], _flat(df)
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
        names = [c for c in df.columns if c not in keys]
        df = df.select(key.alias("key"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot("key", names, "name", "value")
        out.append(df.where("value is not null").select(F.lit(section).alias("section"), "key", "name", "value"))
    return jobs.union(out)


@_query("price_report_values", _long_sql(_PRICE_SECTIONS))
def _price_report_values(spark, d):
    return _long(jobs.analyze_prices(_ticks(spark, d), GAP), _PRICE_SECTIONS)


@_query("book_report_values", _long_sql(_BOOK_SECTIONS))
def _book_report_values(spark, d):
    return _long(jobs.analyze_books(view(spark, d, "v_book_ticks"), GAP), _BOOK_SECTIONS)


# Through landed files, streams and published tables.
_STREAMED = _SQL["price_ticks"].replace("FROM s WHERE closed OR priced", "FROM s WHERE (closed OR priced) AND (t = 1 OR k % 2 = 0)").replace("SELECT k, us + t * 3600000000 AS observed_at", "SELECT k, t, us + t * 3600000000 AS observed_at").replace("epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))", "883612800000000 + o_orderkey % 80000 * 1000000")


@_query("price_stream", _STREAMED)
def _price_stream(spark, d):
    return _flat(replays.price_stream(spark, d, _Q).select("team_a", "team_b", "observed_at", *scoring.PRICES, "closed", "best_cost", "best_edge", "is_arb", "best_trade"))


_BOOKS_TWICE = _SQL["book_ticks"].replace("WHERE n = 1 AND game % 10 <> 9", "JOIN (VALUES (1), (2)) AS v(k) ON true WHERE n = 1 AND game % 10 <> 9").replace("round(qty + 1e-9, 6)", "round(k * qty + 1e-9, 6)").replace("round(profit + 1e-9, 6)", "round(k * profit + 1e-9, 6)").replace("SELECT CAST(game AS VARCHAR) AS team_a", "SELECT CAST(game AS VARCHAR) AS team_a, 1735689600000000 + (k - 1) * 86400000000 AS observed_at")


@_query("book_stream", _BOOKS_TWICE)
def _book_stream(spark, d):
    books = replays.book_lists(_levels(spark, d))
    ticks = replays.book_stream(spark, _book_games(books), books)
    return _flat_up(ticks.select("team_a", F.unix_micros("observed_at").alias("observed_at"), "kalshi_yes_a", "poly_yes_a", "kalshi_yes_b", "poly_yes_b", "is_exec", "exec_qty", "exec_profit", "best_trade"))


@_query("episode_stream", f"{_EP} SELECT {_EP_COLUMNS.replace('still_open, ', '')} FROM ep")
def _episode_stream(spark, d):
    return _flat(replays.episode_stream(spark, _ticks(spark, d), GAP).drop("still_open"))


_PAGED = lambda sql: sql.replace("(k % 5) * 100000000 + (k // 5) * 10000", f"((k % 5) * 1000000 + k // 5 // {replays.PAGE}) * 100000000 + k // 5 % {replays.PAGE} * 10000")
_DISCOVERED = f"""{_PAGED(_K_LISTED)}, {_PAGED(_P_LISTED)}, v_listings AS (SELECT 'K' AS venue, src_ord, team, opponent, CAST(game_date AS DATE) AS game_date, yes_price, market_id FROM kl UNION ALL SELECT 'P', src_ord, team, opponent, CAST(game_date AS DATE), yes_price, market_id FROM pl)"""


@_query("discovered_arbs", f"{_SCORED} SELECT * FROM sc".replace(f"WITH {cte('v_listings')}", _DISCOVERED).replace(f"<= {WEEK})", f"<= {matching.DAYS})"))
def _discovered_arbs(spark, d):
    from .sources.sinks import read_snapshot

    orders = replays.paged(_listed_orders(spark, d))
    base = replays.discovered(spark, _kalshi_event_texts(orders), _poly_event_texts(orders))
    return _flat(read_snapshot(spark, base, "arbs").select(*_SCORE_COLUMNS))


@_query("discovered_markets", f"{_PAGED(_K_LISTED)}, {_PAGED(_P_LISTED)} SELECT *, NULL AS token_id FROM kl UNION ALL BY NAME SELECT * FROM pl")
def _discovered_markets(spark, d):
    from .sources.sinks import read_snapshot

    orders = replays.paged(_listed_orders(spark, d))
    base = replays.discovered(spark, _kalshi_event_texts(orders), _poly_event_texts(orders))
    return _flat(read_snapshot(spark, base, "markets"))


# Listings of college football (even orders) and tennis (odd ones): names as listed and as the engine writes them.
_COLLEGES = (("Ole Miss", "mississippi", "Texas A&M", "texas am"), ("Pitt", "pittsburgh", "Ohio St.", "ohio state"), ("Miami (FL)", "miami fl", "LSU", "lsu"), ("App State", "appalachian state", "FAU", "florida atlantic"))
_PLAYERS = (("Ann-Marie O.Neil", "ann marie o neil", "Bo van der Berg", "bo van der berg"), ("José Diaz", "jos diaz", " Li  Na", "li na"), ("A. Smith-Jones", "a smith jones", "Cy Young", "cy young"), ("D. de la Cruz", "d de la cruz", "E2 Fox", "e2 fox"))
_SERIES_OF = "CASE WHEN k % 2 = 0 THEN 'KXNCAAFGAME' " + " ".join(f"WHEN c % 5 = {i} THEN '{x}'" for i, (x, _) in enumerate(jobs.SERIES["tennis"])) + " END"
_LEVEL_OF = "CASE WHEN k % 2 = 0 THEN 'college' " + " ".join(f"WHEN c % 5 = {i} THEN '{x}'" for i, (_, x) in enumerate(jobs.SERIES["tennis"])) + " END"
_TOUR_OF = "CASE c % 3 WHEN 0 THEN 'atp' WHEN 1 THEN 'wta' ELSE 'itf' END"
_SPORT_OF = "CASE WHEN k % 2 = 0 THEN 'cfb' ELSE 'tennis' END"
_EVENT_SLUG = f"concat(CASE WHEN k % 11 = 0 THEN 'outright-' ELSE '' END, CASE WHEN k % 2 = 0 THEN 'cfb' ELSE {_TOUR_OF} END, '-a', c, '-b', c, '-', day)"
_EVENT_TITLE = "CASE WHEN k % 2 = 0 THEN concat('on ', day) WHEN c % 5 = 0 THEN 'Juniors, final' WHEN c % 5 = 1 THEN 'City Challenger' WHEN c % 5 = 2 THEN 'WTA 125 City' ELSE 'City Open' END"


def _named(i: int) -> str:
    """Field i of the pair of teams or players that the customer's number picks; SQL for both engines."""
    pick = lambda pairs: "CASE c % 4 " + " ".join(f"WHEN {n} THEN '{p[i]}'" for n, p in enumerate(pairs)) + " END"
    return f"CASE WHEN k % 2 = 0 THEN {pick(_COLLEGES)} ELSE {pick(_PLAYERS)} END"


_SPORT_PAGE = f"((k % 5) * 1000000 + k // 5 // {replays.PAGE}) * 100000000"
_SPORT_POS = f"(row_number() OVER (PARTITION BY {{}}, k % 5, k // 5 // {replays.PAGE} ORDER BY k // 5) - 1) * 10000"
_SPORTS_LISTED = f"""WITH x AS ({_KEYED}), k0 AS (SELECT *, {_SERIES_OF} AS series FROM x),
  k1 AS (SELECT *, series || '-' || CASE WHEN k % 6 < 2 THEN 'X' ELSE upper(strftime(dt, '%y%b%d')) END || 'G' || k AS ev, {_SPORT_PAGE} + {_SPORT_POS.format("series")} AS place,
    CASE series WHEN 'KXWTAMATCH' THEN 1 WHEN 'KXITFMATCH' THEN 2 WHEN 'KXATPCHALLENGERMATCH' THEN 3 WHEN 'KXWTACHALLENGERMATCH' THEN 4 ELSE 0 END * 1000000000000000 AS shift FROM k0),
  kl AS (SELECT 'kalshi' AS exchange, ev || '-' || pos AS market_id, NULL AS token_id, ev AS event_id, CASE WHEN k % 4 < 2 THEN ev ELSE 'game ' || k END AS event_title,
    CASE pos WHEN 0 THEN {_named(1)} ELSE {_named(3)} END AS team, CASE pos WHEN 0 THEN {_named(3)} ELSE {_named(1)} END AS opponent, CASE WHEN pos = 0 THEN (10 + c % 80) / 100.0::DOUBLE ELSE 0.5 END AS yes_price,
    CAST(k % 100 AS DOUBLE) AS volume, day AS game_date, CASE pos WHEN 0 THEN CAST(dt + 1 AS VARCHAR) || 'T04:30:00Z' ELSE day || 'T10:00:00Z' END AS close_time, 'https://kalshi.com/markets/' || lower(series) || '/' || lower(ev) AS url,
    shift + place + pos AS src_ord, 0 AS live, 0 AS ended, {_SPORT_OF} AS sport, {_LEVEL_OF} AS level FROM (SELECT *, unnest([0, 1]) AS pos FROM k1)),
  p1 AS (SELECT *, {_EVENT_SLUG} AS slug, {_SPORT_PAGE} + {_SPORT_POS.format("k % 2")} AS place FROM x),
  pl AS (SELECT 'polymarket' AS exchange, 'M' || k AS market_id, CASE pos WHEN 0 THEN 'u' ELSE 'v' END || k AS token_id, slug AS event_id, {_EVENT_TITLE} AS event_title,
    CASE pos WHEN 0 THEN {_named(1)} ELSE {_named(3)} END AS team, CASE pos WHEN 0 THEN {_named(3)} ELSE {_named(1)} END AS opponent, CASE WHEN pos = 0 THEN (10 + c % 80) / 100.0::DOUBLE ELSE 0.25 END AS yes_price,
    5.0::DOUBLE AS volume, day AS game_date, day || 'T20:00:00Z' AS close_time, 'https://polymarket.com/event/' || slug AS url, place + pos AS src_ord, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS live, CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END AS ended,
    {_SPORT_OF} AS sport, CASE WHEN k % 2 = 0 THEN 'college' WHEN c % 5 IN (1, 2) THEN 'challenger' ELSE {_TOUR_OF} END AS level
    FROM (SELECT *, unnest([0, 1]) AS pos FROM p1) WHERE k % 11 <> 0 AND CASE WHEN k % 2 = 0 THEN k % 7 <> 0 ELSE k % 9 <> 0 AND c % 5 <> 0 END)"""


@_query("discovered_sports", f"{_SPORTS_LISTED} SELECT * FROM kl UNION ALL BY NAME SELECT * FROM pl")
def _discovered_sports(spark, d):
    """Listings of college football and of all series and tours of tennis, landed as pages, discovered, saved and read back. Events of
    other slugs (k % 11 = 0) or sports (k % 7 = 0), juniors (c % 5 = 0) and doubles (k % 9 = 0) have no rows."""
    from .sources.sinks import read_snapshot

    x = replays.paged(_listed_orders(spark, d)).selectExpr("page", "event_pos", "o_orderkey AS k", "o_custkey AS c", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day", "upper(date_format(CAST(o_orderdate AS DATE), 'yyMMMdd')) AS code")
    x = x.selectExpr("*", f"{_SERIES_OF} AS series", f"{_SPORT_OF} AS tag", f"{_EVENT_SLUG} AS slug", f"{_named(0)} AS one", f"{_named(2)} AS two", "CAST((10 + c % 80) / 100 AS STRING) AS price")
    x = x.selectExpr("*", "concat(series, '-', CASE WHEN k % 6 < 2 THEN 'X' ELSE code END, 'G', k) AS ev")
    market = lambda pos, name, price, closes, expires: f"named_struct('ticker', concat(ev, '-{pos}'), 'yes_sub_title', {name}, 'yes_ask_dollars', {price}, 'last_price_dollars', '0.5', 'volume_fp', CAST(k % 100 AS STRING), 'close_time', {closes}, 'expected_expiration_time', {expires})"
    markets = [market(0, "one", "price", "concat(day, 'T23:30:00-05:00')", "CAST(NULL AS STRING)"), market(1, "two", "''", "''", "concat(day, 'T10:00:00Z')"), market(2, "' - '", "price", "''", "''")]
    kalshi = x.selectExpr("series", "page", "event_pos", f"to_json(named_struct('event_ticker', ev, 'title', CASE WHEN k % 4 < 2 THEN '' ELSE concat('game ', k) END, 'markets', array({', '.join(markets)}))) AS value")
    kind = f"CASE WHEN k % 2 = 0 THEN CASE WHEN k % 7 = 0 THEN 'nfl' ELSE 'cfb' END WHEN k % 9 = 0 THEN 'atp-doubles' ELSE {_TOUR_OF} END"
    team = lambda name: f"named_struct('name', CASE WHEN k % 2 = 1 THEN {name} END, 'alias', {name})"
    line = "named_struct('id', concat('M', k), 'sportsMarketType', 'moneyline', 'closed', false, 'outcomes', to_json(array(one, two)), 'outcomePrices', to_json(array(price, '0.25')), 'clobTokenIds', to_json(array(concat('u', k), concat('v', k))), 'volume', '5', 'endDate', concat(day, 'T20:00:00Z'))"
    poly = x.selectExpr(
        "tag", "page", "event_pos", f"to_json(named_struct('id', concat('E', k), 'slug', slug, 'title', {_EVENT_TITLE}, 'sport', named_struct('sport', {kind}), 'teams', CASE WHEN k % 3 = 0 THEN array() ELSE array({team('one')}, {team('two')}) END, 'live', k % 3 = 0, 'ended', CASE WHEN k % 5 = 1 THEN 1 END, 'markets', array({line}))) AS value",
    )
    return _flat(read_snapshot(spark, replays.discovered_sports(spark, kalshi, poly), "markets"))


@_query("scanned_books", f"{_OPEN} SELECT {_OPEN_SQL.replace('round(qty', 'round(v.x * qty').replace('round(profit', 'round(v.x * profit')}, 1735689600000000 + (v.x - 1) * 86400000000 AS observed_at FROM od JOIN (VALUES (1), (2)) AS v(x) ON true")
def _scanned_books(spark, d):
    books = replays.book_lists(_levels(spark, d))
    out = replays.scanned(spark, _open_games(books), books)
    return _flat_up(out.select(*_OPEN_COLUMNS, F.unix_micros("observed_at").alias("observed_at")))


@_query("published_ticks", f"WITH {cte('v_ticks')}, n AS (SELECT *, row_number() OVER (ORDER BY tick_id % 3, observed_at, {KEY}) - 1 AS arrival FROM v_ticks) SELECT arrival AS tick_id, {KEY}, epoch_us(observed_at) AS observed_at, round(best_edge, 6) AS best_edge, live, best_trade FROM n WHERE is_arb = 1 AND CAST(observed_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'".replace("THEN NULL WHEN extract(day FROM ts) BETWEEN 11", "THEN 0 WHEN extract(day FROM ts) BETWEEN 11"))
def _published_ticks(spark, d):
    sql = f"SELECT tick_id, {KEY}, observed_at, best_edge, live, best_trade FROM price_ticks WHERE is_arb = 1 AND obs_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
    return _flat(replays.published(spark, _ticks(spark, d), sql))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
