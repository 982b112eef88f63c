"""Exact medians of any number of values, by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written


def _key(by: list[str]) -> Column:
    """One text for the values of by; null is a value of its own."""
    return F.to_json(F.struct(*by)) if by else F.lit("")


def _ordered(rows: DataFrame, by: list[str], value: str, **sums: Column) -> DataFrame:
    """A written table of the distinct values of each group with their numbers (_n) and sums, in ranges of (group, value): _part ascends
    with them. Values are counted before they are shuffled."""
    kept = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), *[c.alias(n) for n, c in sums.items()])
    counts = kept.groupBy(*by, "_v").agg(F.count("*").alias("_n"), *[F.sum(n).alias(n) for n in sums]).withColumn("_key", _key(by))
    return written(counts.repartitionByRange("_key", "_v").withColumn("_part", F.spark_partition_id()), "values")


def _selected(cut: DataFrame) -> DataFrame:
    """(_key, median): running sums over the ranges find those that hold a group's middle, and running sums in these the values."""
    w = Window.partitionBy("_key")  # a row for each range that a group touches
    sizes = cut.groupBy("_key", "_part").agg(F.sum("_n").alias("_size"))
    sizes = sizes.withColumns({"_total": F.sum("_size").over(w), "_before": F.sum("_size").over(w.orderBy("_part")) - F.col("_size")})
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    middle = sizes.where((F.col("_before") <= high) & (F.col("_before") + F.col("_size") > low)).drop("_size")
    near = cut.select("_key", "_part", "_v", "_n").join(middle.hint("merge"), ["_key", "_part"])
    near = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_key", "_part").orderBy("_v")))
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v")))
    return near.groupBy("_key").agg(((at(low) + at(high)) / 2).alias("median"))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(_key, median) of the groups that have any value."""
    return _selected(_ordered(rows, by, value))


def median_of_all(rows: DataFrame, value: str, default: float) -> DataFrame:
    """One row (median)."""
    return medians(rows, [], value).agg(F.coalesce(F.max("median"), F.lit(default)).alias("median"))


def with_median(figures: DataFrame, rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """figures (a row for each group) with the median of the groups' rows."""
    found = medians(rows, by, value).withColumnRenamed("median", name)
    return figures.withColumn("_key", _key(by)).join(found.hint("merge"), "_key", "left").drop("_key")


def duration_figures(episodes: DataFrame, by: list[str]) -> DataFrame:
    """Per group: n, open_n, mean, median, min and max of the episodes' durations, all from the counted values."""
    cut = _ordered(episodes, by, "duration_seconds", _open=F.col("still_open").cast("long"))
    sums = [
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_open"), F.lit(0)).alias("open_n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"),
    ]
    # Without groups there is one row, also for no episodes.
    figures = cut.groupBy(*by, "_key").agg(*sums) if by else cut.agg(*sums).withColumn("_key", _key(by))
    return figures.join(_selected(cut).hint("merge"), "_key", "left").select(*by, "n", "open_n", "mean", "median", "min", "max")
