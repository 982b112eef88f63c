"""The same game on both venues: grouping, keyed date-band candidates, one-to-one assignment, prices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, written

DAYS = 1
_META = {"level": "string", "event_title": "string", "event_id": "string", "url": "string", "live": "int", "ended": "int"}
_PRICE = {"yes_price": "double", "market_id": "string", "token_id": "string"}


def group_games(outcomes: DataFrame) -> DataFrame:
    """One row a game (sport, pair, game_date): ord, meta of its first row, and the last row's prices of each team (a, b).

    outcomes: sport, team, opponent, game_date (date), src_ord; columns of meta and prices that are missing are null."""
    have = lambda names: F.struct(*[F.col(c) if c in outcomes.columns else F.lit(None).cast(kind).alias(c) for c, kind in names.items()])
    ok = "team <> '' and opponent <> '' and team <> opponent and game_date is not null"
    df = outcomes.where(ok).withColumns({"pair": F.array_sort(F.array("team", "opponent")), "_m": have(_META), "_p": have(_PRICE)})
    side = lambda i: F.max_by("_p", F.when(F.col("team") == F.get("pair", F.lit(i)), F.col("src_ord")))
    return df.groupBy("sport", "pair", "game_date").agg(F.min("src_ord").alias("ord"), F.min_by("_m", "src_ord").alias("meta"), side(0).alias("a"), side(1).alias("b"))


def _side(games: DataFrame, prefix: str) -> DataFrame:
    return games.select("sport", *[F.col(c).alias(f"{prefix}_{c}") for c in ("pair", "game_date", "ord", "meta", "a", "b")])


def _by_day(kg: DataFrame, days: int) -> DataFrame:
    return _side(kg, "k").withColumn("day", F.explode(F.sequence(F.date_sub("k_game_date", days), F.date_add("k_game_date", days))))


def _delta() -> Column:
    return F.abs(F.datediff("p_game_date", "k_game_date"))


def pair_candidates_exact(kg: DataFrame, pg: DataFrame, days: int = DAYS) -> DataFrame:
    """Games of the same two teams at most `days` apart: an equi-join on sport, pair and day."""
    p = _side(pg, "p").withColumns({"day": F.col("p_game_date"), "k_pair": F.col("p_pair")})
    return _by_day(kg, days).join(p.hint("merge"), ["sport", "k_pair", "day"]).drop("day").withColumns({"delta": _delta(), "map_a": F.get("k_pair", F.lit(0)), "map_b": F.get("k_pair", F.lit(1))})


def name_mapping(k: Column, p: Column, equal: Callable[[Column, Column], Column]) -> Column:
    """struct(map_a, map_b): the names in p of both names in k, or null if that isn't settled: one name has a single hit, and
    the other a single hit besides."""
    k1, k2, p1, p2 = F.get(k, F.lit(0)), F.get(k, F.lit(1)), F.get(p, F.lit(0)), F.get(p, F.lit(1))
    h11, h12, h21, h22 = equal(k1, p1), equal(k1, p2), equal(k2, p1), equal(k2, p2)
    straight = h11 & h22 & (~h12 | ~h21)
    crossed = h12 & h21 & (~h11 | ~h22)
    return F.when(straight, F.struct(p1.alias("map_a"), p2.alias("map_b"))).when(crossed, F.struct(p2.alias("map_a"), p1.alias("map_b")))


def pair_candidates_fuzzy(kg: DataFrame, pg: DataFrame, equal: Callable[[Column, Column], Column], days: int = DAYS, keys: Callable[[Column, bool], Column] | None = None) -> DataFrame:
    """Candidates whose names agree by `equal`. Includes the pairs of equal teams, which get no priority.

    keys(name, first) gives block keys of a name on the first and on the second side; names that agree share one. Games then meet on
    (sport, day, key) and count once, at the least key they share; without keys they meet on (sport, day). Ids and names alone are
    joined that way, and the games' other columns follow for the candidates found. Both sides are written first: each is read twice,
    and Spark would test the keys of every listing, below the grouping, instead of those of every game."""
    kg, pg = written(kg, "games"), written(pg, "games")
    p = _side(pg, "p").withColumn("day", F.col("p_game_date"))
    k = _by_day(kg, days)
    on, slim_k, slim_p = ["sport", "day"], k.select("sport", "day", "k_ord", "k_pair"), p.select("sport", "day", "p_ord", "p_pair")
    name = lambda pair, i: F.get(pair, F.lit(i))
    if keys:
        # A mapping gives the first side's first name a partner, whichever it is.
        same = lambda c: F.array(F.concat(F.lit("="), c))
        slim_k = slim_k.withColumn("k_keys", F.array_distinct(F.concat(same(name("k_pair", 0)), keys(name("k_pair", 0), True))))
        slim_p = slim_p.withColumn("p_keys", F.array_distinct(F.concat(*[x for i in (0, 1) for x in (same(name("p_pair", i)), keys(name("p_pair", i), False))])))
        slim_k, slim_p, on = slim_k.withColumn("key", F.explode("k_keys")), slim_p.withColumn("key", F.explode("p_keys")), [*on, "key"]
    df = slim_k.join(slim_p.hint("merge"), on)
    if keys:
        df = df.where(F.col("key") == F.array_min(F.array_intersect("k_keys", "p_keys")))
    own = F.struct(name("k_pair", 0).alias("map_a"), name("k_pair", 1).alias("map_b"))
    df = df.withColumn("m", F.when(F.col("k_pair") == F.col("p_pair"), own).otherwise(name_mapping(F.col("k_pair"), F.col("p_pair"), equal))).where("m is not null")
    found = df.select("sport", "k_ord", "p_ord", "m.*")
    return found.join(_side(kg, "k").hint("merge"), ["sport", "k_ord"]).join(_side(pg, "p").hint("merge"), ["sport", "p_ord"]).withColumn("delta", _delta())


def _free_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidates in order, those whose games are both free. Only the numbers of the games that one pair has taken are kept."""
    group, ks, ps = None, set(), set()
    for batch in batches:
        at = batch.schema.get_field_index
        free = []
        for g, k, p in zip(*(batch.column(at(c)).to_pylist() for c in ("_group", "k_ord", "p_ord")), strict=True):
            if g != group:
                group, ks, ps = g, set(), set()
            free.append(k not in ks and p not in ps)
            if free[-1]:
                ks.add(k)
                ps.add(p)
        yield batch.filter(pa.array(free, pa.bool_())).drop_columns(["_group"])


def assign_one_to_one(cand: DataFrame) -> DataFrame:
    """Greedy in arrival order within each (sport, pair): every game takes the free partner nearest in date.

    Who is free depends on all games before, so a pair is one sequence: its candidates pass in order through one task, in batches and in
    time linear in their number, and no list of them is made."""
    ordered = cand.withColumn("_group", F.to_json(F.struct("sport", "k_pair"))).repartition("_group")
    return ordered.sortWithinPartitions("_group", "k_ord", "delta", "p_game_date", "p_ord").mapInArrow(_free_ones, cand.schema)


def assign_in_rounds(cand: DataFrame) -> DataFrame:
    """The same assignment where candidates cross pairs: in every round a game takes its nearest free partner if no earlier game
    that is left could take it. The earliest game left always can, so every round settles some."""
    left, done = cut(cand), []
    while not left.isEmpty():
        best = left.groupBy("sport", "k_ord").agg(F.min_by("p_ord", F.struct("delta", "p_game_date", "p_ord")).alias("p_ord"))
        first = left.groupBy("sport", "p_ord").agg(F.min("k_ord").alias("k_ord"))
        won = cut(best.join(first.hint("merge"), ["sport", "k_ord", "p_ord"]))
        done.append(left.join(won.hint("merge"), ["sport", "k_ord", "p_ord"]))
        left = cut(left.join(won.select("sport", "k_ord").hint("merge"), ["sport", "k_ord"], "left_anti").join(won.select("sport", "p_ord").hint("merge"), ["sport", "p_ord"], "left_anti"))
    out = left
    for d in done:
        out = out.unionByName(d)
    return out


def attach_prices(assigned: DataFrame) -> DataFrame:
    """Matches: both teams' price, market and token on both venues; what is missing is null."""
    of = lambda name: F.when(F.get("p_pair", F.lit(0)) == F.col(name), F.col("p_a")).otherwise(F.col("p_b"))
    df = assigned.withColumns({"pa": of("map_a"), "pb": of("map_b")})
    truth = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    return df.select(
        "sport", F.col("k_meta.level").alias("level"), F.col("k_game_date").cast("string").alias("game_date"), F.col("p_game_date").cast("string").alias("poly_game_date"), F.get("k_pair", F.lit(0)).alias("team_a"), F.get("k_pair", F.lit(1)).alias("team_b"),
        F.col("k_meta.event_title").alias("kalshi_event"), F.col("p_meta.event_title").alias("polymarket_event"), F.col("k_meta.event_id").alias("kalshi_event_id"), F.col("k_a.market_id").alias("kalshi_id_a"), F.col("k_b.market_id").alias("kalshi_id_b"),
        F.coalesce(F.nullif(F.col("pa.market_id"), F.lit("")), F.col("pb.market_id")).alias("poly_id"), F.col("p_meta.event_id").alias("poly_event_id"), F.col("pa.token_id").alias("poly_token_a"), F.col("pb.token_id").alias("poly_token_b"),
        F.col("k_a.yes_price").alias("kalshi_yes_a"), F.col("pa.yes_price").alias("poly_yes_a"), F.col("k_b.yes_price").alias("kalshi_yes_b"), F.col("pb.yes_price").alias("poly_yes_b"),
        F.col("k_meta.url").alias("kalshi_url"), F.col("p_meta.url").alias("polymarket_url"), truth("p_meta.live").alias("live"), truth("p_meta.ended").alias("ended"), F.col("k_ord").alias("src_ord"),
    )


def match_markets(kalshi: DataFrame, poly: DataFrame, equal: Callable[[Column, Column], Column] | None = None, days: int = DAYS, keys: Callable[[Column, bool], Column] | None = None) -> DataFrame:
    kg, pg = group_games(kalshi), group_games(poly)
    if equal is None:
        return attach_prices(assign_one_to_one(pair_candidates_exact(kg, pg, days)))
    return attach_prices(assign_in_rounds(pair_candidates_fuzzy(kg, pg, equal, days, keys)))


def dedupe_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*reversed(keys)).orderBy(F.desc(order)))  # sorted by what differs most first
    return df.withColumn("_n", n).where("_n = 1").drop("_n")
