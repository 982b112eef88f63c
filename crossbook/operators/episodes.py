"""Episodes: maximal runs of ticks whose edge meets a threshold, cut at gaps and status changes.

One shuffle on the match key (or, of long series, on match and day) serves every threshold: lag, lead and the number of runs so far are
computed in one order, then thresholds are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import game_status
from ..plans.tables import written

MATCH_KEY = ("sport", "game_date", "team_a", "team_b")
GAP_BREAK = 900.0
#: (least edge, whether it is enough itself)
THRESHOLDS = ((0.0, False), (0.01, True), (0.02, True), (0.03, True))
ALL = "all"
#: Parts that rows of one slice are dealt to when figures of slices are joined to them.
SALTS = 64
#: Ticks of a series that one task sorts; longer ones are cut into days.
LONG = 100_000
#: Rows of a counted table that is broadcast.
FEW = 10_000


def meets(edge: Column, min_edge: Column, inclusive: Column) -> Column:
    return F.coalesce(F.when(inclusive, edge >= min_edge).otherwise(edge > min_edge), F.lit(False))


def active(closed: Column, edge: Column, min_edge: Column, inclusive: Column) -> Column:
    """A price tick qualifies: open, with an edge at the threshold."""
    return (F.coalesce(closed, F.lit(0)) == 0) & meets(edge, min_edge, inclusive)


def qualifies(is_exec: Column, edge: Column, min_edge: Column, inclusive: Column) -> Column:
    """A book tick qualifies: executable, with an edge at the threshold."""
    return (F.coalesce(is_exec, F.lit(0)) != 0) & meets(edge, min_edge, inclusive)


def with_thresholds(df: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """A row for each threshold: min_edge, inclusive."""
    array = F.array(*[F.struct(F.lit(float(m)).alias("min_edge"), F.lit(i).alias("inclusive")) for m, i in thresholds])
    return df.withColumn("_t", F.explode(array)).withColumns({"min_edge": F.col("_t.min_edge"), "inclusive": F.col("_t.inclusive")}).drop("_t")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def with_slice_figures(df: DataFrame, figures: DataFrame) -> DataFrame:
    """df with the columns of figures (one row a slice, however many slices dirty data makes): a merge join, hot slices dealt to parts."""
    part = F.pmod(F.xxhash64(*MATCH_KEY), F.lit(SALTS)).cast("int")
    copies = figures.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_part", part).join(copies.hint("merge"), ["slice", "_part"]).drop("_part")


def _neighbours(ticks: DataFrame, key: list[str]) -> DataFrame:
    """For each day of a series the last tick before it and the first one after it, as rows of that day.

    The windows run over one row a day of a series."""
    side = F.struct("observed_at", "tick_id", "best_edge", "closed", "status")
    w = Window.partitionBy(*key).orderBy("_day")
    days = ticks.groupBy(*key, "_day").agg(F.min(side).alias("first"), F.max(side).alias("last"))
    days = days.select(*key, "_day", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    return days.select(*key, "_day", F.explode(F.filter(F.array("before", "after"), lambda s: s.isNotNull())).alias("s")).select(*key, "_day", "s.*")


def _stitched(parts: DataFrame, group: list[str], combine: list[Column]) -> DataFrame:
    """Parts of episodes (eid: runs begun so far that day) made whole. Only a day's first and last part can belong to an episode that
    crosses midnight; they are numbered over the days, the others are episodes as they are."""
    parts = parts.withColumn("_most", F.max("eid").over(Window.partitionBy(*group, "_day")))
    inner = (F.col("eid") > 0) & (F.col("eid") < F.col("_most"))
    w = Window.partitionBy(*group).orderBy("_day", "eid")  # two rows a day of a series at most
    outer = parts.where(~inner).withColumn("_run", F.sum(F.when(F.col("eid") > 0, 1).otherwise(0)).over(w)).groupBy(*group, "_run").agg(*combine)
    return parts.where(inner).drop("_most", "_day", "eid").unionByName(outer.drop("_run"))


def _runs(df: DataFrame, key: list[str], block: list[str], thresholds, gap_break: float) -> DataFrame:
    """The runs of each series, or of each of its blocks: a row for each threshold and run (eid)."""
    w = Window.partitionBy(*key, *block).orderBy("observed_at", "tick_id")
    near = {f"{p}_{c}": f(c).over(w) for p, f in (("p", F.lag), ("n", F.lead)) for c in ("observed_at", "best_edge", "closed", "status")}
    df = df.withColumns(near)
    df = df.where("_own") if block else df
    joined = F.col("p_observed_at").isNotNull() & (seconds(F.col("observed_at"), F.col("p_observed_at")) <= gap_break) & (F.col("p_status") == F.col("status"))
    joins = F.col("n_observed_at").isNotNull() & (seconds(F.col("n_observed_at"), F.col("observed_at")) <= gap_break) & (F.col("n_status") == F.col("status"))
    df = df.withColumns({"_joined": F.coalesce(joined, F.lit(False)), "_joins": F.coalesce(joins, F.lit(False))})
    on = lambda p, t: active(F.col(f"{p}closed"), F.col(f"{p}best_edge"), F.lit(float(t[0])), F.lit(t[1]))
    # Runs are counted at all thresholds in the order of the first window, so rows are sorted once for all of them.
    df = df.withColumns({f"_eid{i}": F.sum(F.when(on("", t) & ~(F.col("_joined") & on("p_", t)), 1).otherwise(0)).over(w) for i, t in enumerate(thresholds)})
    each = [
        F.struct(F.lit(float(t[0])).alias("min_edge"), F.lit(t[1]).alias("inclusive"), on("", t).alias("on"), F.col(f"_eid{i}").alias("eid"), F.when(F.col("_joins") & ~on("n_", t), F.col("n_observed_at")).otherwise(F.col("observed_at")).alias("off_end"))
        for i, t in enumerate(thresholds)
    ]
    df = df.select(*key, *block, "observed_at", "tick_id", "level", "live", "ended", "status", "best_edge", "best_trade", F.col("n_observed_at").isNull().alias("alive"), F.explode(F.array(*each)).alias("_t"))
    df = df.where("_t.on").select("*", "_t.min_edge", "_t.inclusive", "_t.eid", "_t.off_end").drop("_t")
    return df.groupBy(*key, "min_edge", "inclusive", *block, "eid").agg(
        F.min(F.struct("observed_at", "tick_id", "level", "live", "ended", "status")).alias("head"), F.max(F.struct("observed_at", "tick_id", "off_end", "alive")).alias("tail"),
        F.min(F.struct((-F.col("best_edge")).alias("edge"), "observed_at", "tick_id", "best_trade")).alias("peak"), F.min("observed_at").alias("start"), F.max("observed_at").alias("last_ts"),
        F.max("best_edge").alias("peak_edge"), F.count("*").alias("ticks"),
    )


def _runs_by_day(df: DataFrame, key: list[str], thresholds, gap_break: float) -> DataFrame:
    df = df.withColumn("_day", F.floor(F.unix_seconds("observed_at") / 86_400))
    df = df.withColumn("_own", F.lit(True)).unionByName(_neighbours(df, key), allowMissingColumns=True)
    least, greatest = ("head", "peak", "start"), ("tail", "last_ts", "peak_edge")
    combine = [*[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in greatest], F.sum("ticks").alias("ticks")]
    return _stitched(_runs(df, key, ["_day"], thresholds, gap_break), [*key, "min_edge", "inclusive"], combine)


def find_episodes(ticks: DataFrame, thresholds=THRESHOLDS, gap_break: float = GAP_BREAK, slices: bool = False, by_day: bool = False) -> DataFrame:
    """Episodes of ticks (tick_id, observed_at, match key, level, best_edge, best_trade, closed, live, ended) at each threshold.

    With slices, ticks have a column slice and series are told apart by it; the end of the data is that of the slice. With by_day, a
    series of more than LONG ticks is worked on in days of UTC that are joined at their borders, so that none is sorted in one task
    however long it is; the episodes are the same. Ticks without a time come first, as a day of their own. Series are counted for it."""
    df = ticks if slices else ticks.withColumn("slice", F.lit(ALL))
    df = df.withColumn("status", game_status(F.col("live"), F.col("ended")))
    ends = df.groupBy("slice").agg(F.max("observed_at").alias("global_end"))
    key = ["slice", *MATCH_KEY]
    df = df.select(*key, "tick_id", "observed_at", "level", "best_edge", "best_trade", "closed", "live", "ended", "status")
    long = written(df.groupBy(*key).count().where(F.col("count") > LONG).select(*key), "long-series") if by_day else None
    if long is None or long.isEmpty():
        df = _runs(df, key, [], thresholds, gap_break).drop("eid")
    else:
        # One row for every LONG ticks at most; as many ticks again take a merge join.
        of = long.hint("broadcast" if long.count() <= FEW else "merge").alias("l")
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"l.{c}")) for c in key]
        short = _runs(df.alias("t").join(of, same, "left_anti"), key, [], thresholds, gap_break).drop("eid")
        df = short.unionByName(_runs_by_day(df.alias("t").join(of, same, "left_semi"), key, thresholds, gap_break))
    df = with_slice_figures(df, ends) if slices else df.join(F.broadcast(ends), "slice")  # without slices one row
    still_open = F.col("tail.alive") & (seconds(F.col("global_end"), F.col("last_ts")) <= gap_break)
    out = df.select(
        *(["slice"] if slices else []), "sport", "head.level", "game_date", "team_a", "team_b", "peak.best_trade", "start", F.col("tail.off_end").alias("end"), "last_ts",
        F.greatest(F.lit(0.0), seconds(F.col("tail.off_end"), F.col("start"))).alias("duration_seconds"), "peak_edge", "ticks", still_open.alias("still_open"),
        "min_edge", "inclusive", "head.live", "head.ended", "head.status",
    )
    return out


def largest_first() -> list[Column]:
    """The order of reports: largest edge, longest, earliest."""
    return [F.desc("peak_edge"), F.desc("duration_seconds"), F.asc("start"), *[F.asc(k) for k in MATCH_KEY]]
