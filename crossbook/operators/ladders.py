"""Executable size of two ask ladders: a sweep over cumulative quantities instead of a join of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import game_status
from .outcomes import split_books

#: Segments up to this size are rounding.
DUST = 1e-9
#: Added to edges before they are rounded for a comparison: costs over 2**k units often end in a five, where the last bit would decide.
SHIFT = 1e-12


def _by(key: str | tuple[str, ...]) -> tuple[str, ...]:
    return (key,) if isinstance(key, str) else key


def _sweep(levels: DataFrame, *key: str) -> DataFrame:
    """Per key the cheapest ask of both sides, and the size and cost of the walk (null where nothing is executable).

    Each side's levels cover intervals of cumulative quantity; the union of their ends cuts both ladders in segments within which both
    prices are constant. Prices rise with quantity, so segments under 1 come first and no level is paired with more than it meets.
    Levels of one price end together, so all but one of them make segments of no size. The segments are made from the far end, where
    the price of a segment is the last one seen and its start the next end: each level is looked at once."""
    w = Window.partitionBy(*key, "side").orderBy("price").rangeBetween(Window.unboundedPreceding, 0)
    rungs = levels.where("price is not null and qty > 0").withColumn("hi", F.sum("qty").over(w))
    back = Window.partitionBy(*key).orderBy(F.desc("hi"), F.desc("side"))
    own = {s: F.when(F.col("side") == s, F.col("price")) for s in ("L", "R")}
    cuts = rungs.select(
        *key, *[own[s].alias(f"own_{s}") for s in own], (F.col("hi") - F.coalesce(F.lead("hi").over(back), F.lit(0.0))).alias("size"),
        F.round(sum(F.last(own[s], ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)) for s in ("R", "L")), 4).alias("combined"),
    )
    done = (F.col("combined") < 1.0) & (F.col("size") > DUST)
    return cuts.groupBy(*key).agg(
        F.min("own_L").alias("left_ask"), F.min("own_R").alias("right_ask"), F.sum(F.when(done, F.col("size"))).alias("qty"), F.sum(F.when(done, F.col("size") * F.col("combined"))).alias("total_cost"),
    )


def walk_ladders(levels: DataFrame, key: str | tuple[str, ...] = "match_id") -> DataFrame:
    """Rows (key, qty, total_cost, avg_cost, profit, edge) where the cheapest asks of both sides cost under 1 together.

    levels: (key, side L or R, price, qty)."""
    walked = _sweep(levels, *_by(key)).where("qty is not null").select(*_by(key), "qty", "total_cost")
    return walked.withColumns({"avg_cost": F.col("total_cost") / F.col("qty"), "profit": F.col("qty") - F.col("total_cost"), "edge": 1.0 - F.col("total_cost") / F.col("qty")})


def score_directions(levels: DataFrame, key: str | tuple[str, ...] = "match_id") -> DataFrame:
    """Per key with both ladders: top asks, and size, cost, profit and edge of the walk, or of the tops where nothing is executable."""
    combined = F.round(F.col("left_ask") + F.col("right_ask"), 4)
    return _sweep(levels, *_by(key)).where("left_ask is not null and right_ask is not null").select(
        *_by(key), "left_ask", "right_ask", combined.alias("combined_best"), F.coalesce("qty", F.lit(0.0)).alias("qty"), F.coalesce(F.col("total_cost") / F.col("qty"), combined).alias("avg_cost"),
        F.coalesce(F.col("qty") - F.col("total_cost"), F.lit(0.0)).alias("profit"), F.coalesce(1.0 - F.col("total_cost") / F.col("qty"), F.round(1.0 - combined, 4)).alias("edge"), F.col("qty").isNotNull().cast("int").alias("is_exec"),
    )


def match_legs(matches: DataFrame) -> DataFrame:
    """Four rows a match: direction (0: team A at the first venue), side, and the book it trades in."""
    return matches.selectExpr("*", "stack(4, 0, 'L', kalshi_id_a, 0, 'R', poly_token_b, 1, 'L', kalshi_id_b, 1, 'R', poly_token_a) as (dir, side, book_id)")


def _levels(legs: DataFrame) -> DataFrame:
    return split_books(legs) if "levels" in legs.columns else legs


def _legs_with_books(matches: DataFrame, books: DataFrame) -> DataFrame:
    return match_legs(matches).where("book_id is not null and book_id <> ''").join(books.hint("merge"), "book_id")


def attach_books(matches: DataFrame, books: DataFrame, *time: str) -> DataFrame:
    """Levels (match columns, dir, side, price, qty) of each match's four books. books: (book_id, price, qty, and time columns), or whole
    books (kind, levels), which are joined as they are and split afterwards."""
    return _levels(_legs_with_books(matches, books))


_KEYS = ("sport", "game_date", "team_a", "team_b")


def executable_directions(matches: DataFrame, books: DataFrame, *time: str) -> DataFrame:
    """Both buy directions of matches that haven't ended; time: columns of books (such as observed_at) that tell snapshots apart."""
    open_ones = matches.where(game_status(F.col("live"), F.col("ended")) != "ended")
    # One shuffle, of whole books where they come so, for all that is done to a direction. The hash comes first in its key, as sorts by
    # a number are faster than by names that are mostly alike.
    key = F.struct(*_KEYS, *time, "dir")
    legs = _legs_with_books(open_ones, books).select(F.xxhash64(*_KEYS, *time, "dir").alias("_hash"), key.alias("key"), "side", *[c for c in ("kind", "levels", "price", "qty") if c in books.columns]).repartition("_hash")
    scored = score_directions(_levels(legs), ("_hash", "key")).select(*[F.col(f"key.{c}").alias(c) for c in (*_KEYS, *time, "dir")], F.col("left_ask").alias("kalshi_ask"), F.col("right_ask").alias("poly_ask"), "combined_best", "qty", "avg_cost", "profit", "edge", "is_exec")
    info = open_ones.select(*_KEYS, "level", "live", "ended")
    first, second = (F.when(F.col("dir") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("team_a", "team_b"), ("team_b", "team_a")))
    text = F.concat(F.lit("Buy "), first, F.lit(" on Kalshi + "), second, F.lit(" on Polymarket"))
    return scored.join(info.hint("merge"), list(_KEYS)).withColumn("direction", text)


def best_direction(directions: DataFrame, *time: str) -> DataFrame:
    """The direction that is executable, then of the larger edge; the first of equal ones. Edges are sums whose last bits depend on the
    order of adding, so they are compared to nine places."""
    row = F.struct(*[c for c in directions.columns if c not in (*_KEYS, *time)])
    best = directions.groupBy(*_KEYS, *time).agg(F.max_by(row, F.struct("is_exec", F.round(F.col("edge") + SHIFT, 9), -F.col("dir"))).alias("b"))
    return best.select(*_KEYS, *time, "b.*")


def top_asks(matches: DataFrame, books: DataFrame, *time: str) -> DataFrame:
    """Per match: the cheapest ask of each of its four books, null where a book has none."""
    legs = attach_books(matches, books, *time).where("price is not null and qty > 0")
    ask = lambda d, side: F.min(F.when((F.col("dir") == d) & (F.col("side") == side), F.col("price")))
    return legs.groupBy(*_KEYS, *time).agg(ask(0, "L").alias("kalshi_yes_a"), ask(1, "R").alias("poly_yes_a"), ask(1, "L").alias("kalshi_yes_b"), ask(0, "R").alias("poly_yes_b"))


def quote_executable(matches: DataFrame, books: DataFrame, *time: str) -> DataFrame:
    """Book ticks: the best direction of each match with the cost and size it executes at, and the four top asks."""
    best = best_direction(executable_directions(matches, books, *time), *time).join(top_asks(matches, books, *time).hint("merge"), [*_KEYS, *time])
    done = F.col("is_exec") == 1
    return best.select(
        *time, "sport", "level", "game_date", "team_a", "team_b", "kalshi_yes_a", "poly_yes_a", "kalshi_yes_b", "poly_yes_b",
        F.round(F.when(done, F.col("avg_cost")).otherwise(F.col("combined_best")), 4).alias("best_cost"), F.round(F.when(done, F.col("edge")).otherwise(1.0 - F.col("combined_best")), 4).alias("best_edge"),
        "is_exec", F.col("direction").alias("best_trade"), F.when(done, F.col("qty")).otherwise(0.0).alias("exec_qty"), F.when(done, F.col("profit")).otherwise(0.0).alias("exec_profit"),
        F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("ended", F.lit(0)).alias("ended"),
    )


def executable_report(directions: DataFrame, n_misses: int = 5) -> tuple[DataFrame, DataFrame]:
    """Hits by edge, and the closest misses by combined cost; ties by match and direction."""
    tie = (*_KEYS, "dir")
    return directions.where("is_exec = 1").orderBy(F.desc("edge"), *tie), directions.where("is_exec = 0").orderBy("combined_best", *tie).limit(n_misses)
