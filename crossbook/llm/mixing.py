"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sources get targets in words: their weight's part of `share` times all words, but no more than `most` times what they have; the
   excess goes to the others by weight (a water level, found by sums over the table of sources).
2. Rows are dealt by hash into blocks of about BLOCK_WORDS words or BLOCK_ROWS rows. A source gives whole passes over its blocks and
   then the first blocks of a permuted order, up to its target; of the last of these blocks rows are taken, in the order of their
   hash, where they still fit, so that what is missing is less than the smallest row left there.
3. The sources' block quotas are split exactly among shards of equal numbers of blocks: a node's quotas are halved by a multivariate
   hypergeometric draw, again and again, as if all blocks had been shuffled and cut. A shard takes the next blocks of each source's
   permuted order, so draws are disjoint, and orders its rows by a hash.

Everything is drawn from hashes of the seed, the rows' contents and the numbers of equal rows, so reruns agree whatever the partitions.

Null and empty texts have size 0: they come along with their block. A null source is a source of its own, after all others; a null id
is like any id. Rows equal in all columns are told apart by number. A source of weight 0 has target 0. An empty table gives an empty
result. NumPy's hypergeometric draws allow 10**9 blocks in all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lake

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK_WORDS, BLOCK_ROWS = 1 << 16, 1 << 10
SHARD_WORDS = 1 << 24
SEED = 20_241
#: Equal rows that one task numbers at once.
COPIES = 10_000
#: Up to so many sources their figures are broadcast (under 150 bytes each); more are joined by shuffle, each dealt to PARTS keys.
BROADCAST_SOURCES, PARTS = 100_000, 64
#: log2 of the blocks whose words are summed up before sources' running sums, and of the shards a task splits a node into.
SEGMENT_BITS, FAN_BITS = 10, 6


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame) -> list[Column]:
    """128 bits that name a row's contents."""
    both = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(*both).alias("k1"), F.xxhash64(F.lit(SEED), *both).alias("k2")]


def _with_source(rows: DataFrame, sources: DataFrame, n_sources: int, on: str) -> DataFrame:
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(sources.hint("broadcast"), rows[on].eqNullSafe(sources[on])).drop(sources[on])
    dealt = sources.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("part", F.pmod(F.col("k1"), F.lit(PARTS)).cast("int"))
    return rows.join(dealt.hint("merge"), (rows["part"] == dealt["part"]) & rows[on].eqNullSafe(dealt[on])).drop(dealt[on]).drop("part")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with their rank by code point, null last, from 0. Only the sizes of the sorted parts reach the driver."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    cut = lake.written(sources.repartitionByRange(lake.parts(spark), *order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = dict(cut.groupBy("part").count().collect())  # one row a partition
    parts = sorted(sizes)
    before = dict(zip(parts, np.cumsum([0, *[sizes[p] for p in parts]]).tolist(), strict=False))
    shift = spark.createDataFrame([(p, before[p]) for p in parts], "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return cut.withColumn("rank", place).join(shift.hint("broadcast"), "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def with_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source_size, weight, ...) with their target. sources is a written table: it is summed once for each rise of the level."""
    cap, w = F.col("source_size") * most, F.col("weight")
    total, weight = (float(x or 0) for x in sources.agg(F.sum("source_size"), F.sum("weight")).first())
    level, capped = (share * total / weight if weight else 0.0), -1
    while True:
        full = w * level >= cap
        n, fixed, free = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, w))).first()
        if n == capped or not free:
            break
        capped, level = n, (share * total - (fixed or 0.0)) / free
    return sources.withColumn("target", F.when(w * level >= cap, cap).otherwise(w * level))


def split(lo: int, hi: int, counts: np.ndarray, leaves: int, sizes, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """Splits the block counts of shards lo to hi - 1 until a node has `leaves` shards at most: [(lo, hi, counts)]."""
    if hi - lo <= leaves:
        return [(lo, hi, counts)]
    mid = (lo + hi) // 2
    left = int(sizes(mid) - sizes(lo))
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi])))
    drawn = rng.multivariate_hypergeometric(counts, left, method="marginals")
    return split(lo, mid, drawn, leaves, sizes, seed) + split(mid, hi, counts - drawn, leaves, sizes, seed)


def _splitter(leaves: int, sizes, seed: int):
    def run(key, pdf):
        pdf = pdf.sort_values("rank")
        rank, out = pdf["rank"].to_numpy(), []
        for lo, hi, n in split(int(key[0]), int(key[1]), pdf["n"].to_numpy(), leaves, sizes, seed):
            some = np.flatnonzero(n)
            out.append(pd.DataFrame({"lo": np.full(len(some), lo), "hi": np.full(len(some), hi), "rank": rank[some], "n": n[some]}))
        return pd.concat(out)

    return run


def shard_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Rows (shard, rank, n): how many blocks of each source (rank, n) a shard gets. A node's group holds one row a source."""
    total = int(quotas.agg(F.sum("n")).first()[0] or 0)
    sizes = lambda shard: total * shard // shards
    nodes = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "rank", "n")
    rounds = max(1, math.ceil(math.log2(max(shards, 2)) / FAN_BITS))
    for k in range(rounds):
        nodes = nodes.groupBy("lo", "hi").applyInPandas(_splitter(1 << FAN_BITS * (rounds - 1 - k), sizes, seed), "lo long, hi long, rank long, n long")
    return nodes.select(F.col("lo").alias("shard"), "rank", "n")


def _place(k: Column | int) -> Column:
    """Place of a block in the order of pass k: an affine permutation of the source's blocks, whose number is a power of two."""
    k = F.lit(k) if isinstance(k, int) else k
    last = F.col("blocks") - 1
    odd = F.xxhash64(F.lit(SEED), "rank", k).bitwiseAND(F.lit((1 << 20) - 1)).bitwiseOR(F.lit(1))
    return (odd * F.col("block") + F.xxhash64(F.lit(SEED + 1), "rank", k).bitwiseAND(last)).bitwiseAND(last)


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of a source's last block that still fit, by hash; then the smallest of the others if the target comes nearer by it."""
    pdf = pdf.sort_values(["order", "k1", "k2", "copy"]).reset_index(drop=True)
    left, take = float(pdf["rest"].iloc[0]), np.zeros(len(pdf), dtype=bool)
    size = pdf["size"].to_numpy()
    for i, n in enumerate(size.tolist()):
        if n <= left:
            take[i] = True
            left -= n
    others = np.flatnonzero(~take)
    if len(others):
        least = others[np.argmin(size[others])]
        take[least] = size[least] < 2 * left
    pdf["shards"] = [s if t else s[:-1] for s, t in zip(pdf["shards"], take, strict=True)]
    return pdf


def draws(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): k1, k2 (contents), copy (number among equal rows), doc_id, size,
    source_size, target, shards (of its draws, in order of passes; empty where the mix doesn't take it)."""
    slim = docs.select(*_keyed(docs), "doc_id", "source", n_words().alias("size"))
    same = lake.written(slim.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("same")), "rows")
    table = ranked(same.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"), F.sum("same").alias("rows")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    blocks = F.greatest(F.col("source_size") / block_words, F.col("rows") / BLOCK_ROWS, F.lit(1.0))
    table = lake.written(table.withColumns({"weight": weight, "blocks": F.pow(F.lit(2.0), F.ceil(F.log2(blocks))).cast("long")}), "weights")
    table = with_targets(table, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    table = table.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    table = lake.written(table.drop("rows", "weight"), "targets")
    n_sources = table.count()

    numbered = same.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1, F.lit(COPIES).cast("long"))))
    numbered = numbered.repartition("k1", "k2", "lo").withColumn("copy", F.explode(F.sequence("lo", F.least(F.col("lo") + (COPIES - 1), F.col("same") - 1))))
    block = F.xxhash64(F.lit(SEED), "k1", "k2", "copy").bitwiseAND(F.col("blocks") - 1)
    placed = _with_source(numbered, table, n_sources, "source").withColumn("block", block)
    placed = lake.written(placed.select("k1", "k2", "copy", "doc_id", "size", "rank", "block", "source_size", "target"), "placed")

    # The last block of each source: running sums over segments of blocks, then over the blocks of one segment.
    figures = table.select("rank", "blocks", "passes", "rest")
    sums = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("k1").alias("k1"))
    sums = _with_source(sums, figures, n_sources, "rank").drop("k1").withColumn("place", _place(F.col("passes")))
    sums = lake.written(sums.withColumn("segment", F.shiftright("place", SEGMENT_BITS)), "blocks")
    before = lambda by: F.sum("words").over(Window.partitionBy("rank").orderBy(by)) - F.col("words")
    cuts = (F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    segment = sums.groupBy("rank", "rest", "segment").agg(F.sum("words").alias("words")).withColumn("before", before("segment")).where(cuts)
    inside = sums.join(segment.select("rank", "segment", F.col("before").alias("base")).hint("merge"), ["rank", "segment"]).withColumn("before", F.col("base") + before("place"))
    last = lake.written(inside.where(cuts).select("rank", F.col("place").alias("last"), (F.col("rest") - F.col("before")).alias("left")), "cuts")

    quotas = figures.join(last.hint("merge"), "rank", "left").withColumn("n", F.col("passes") * F.col("blocks") + F.coalesce(F.col("last") + 1, F.lit(0)))
    words = table.agg(F.sum("target")).first()[0] or 0.0
    leaves = shard_quotas(quotas.where("n > 0").select("rank", "n"), max(1, math.ceil(words / shard_words)))
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    drawn = leaves.withColumn("upto", upto).select("rank", "shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("draw"))

    # What each block is drawn for. A block is in every whole pass, and in the last one up to the cut.
    sums = sums.join(last.hint("merge"), "rank", "left").withColumn("final", F.coalesce(F.col("place") == F.col("last"), F.lit(False)))
    times = F.col("passes") + (F.coalesce(F.col("place") <= F.col("last"), F.lit(False))).cast("int")
    sums = sums.withColumn("times", times).where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    sums = sums.withColumn("draw", F.col("pass") * F.col("blocks") + _place(F.col("pass"))).join(drawn.hint("merge"), ["rank", "draw"])
    shards = F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"])  # a row a pass
    dealt = lake.written(sums.groupBy("rank", "block").agg(shards.alias("shards"), F.first("final").alias("final"), F.first("left").alias("rest")), "dealt")

    rows = placed.join(dealt.hint("merge"), ["rank", "block"], "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<long>")))
    rows = lake.written(rows.withColumn("order", F.xxhash64(F.lit(SEED + 2), "k1", "k2", "copy")), "drawn")
    filled = rows.where("final").groupBy("rank").applyInPandas(_fill, rows.schema)  # one block of a source
    return rows.where("not coalesce(final, false)").unionByName(filled).select("k1", "k2", "copy", "doc_id", "size", "source_size", "target", "shards")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows, as often as they are drawn, as (shard, place, row); place numbers a shard's rows from 0."""
    drawn = draws(docs, **how).select("k1", "k2", "copy", F.posexplode("shards").alias("pass", "shard"))
    keyed = docs.select(*_keyed(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = lake.written(keyed.groupBy("k1", "k2").agg(F.first("row").alias("row")), "contents")
    rows = keyed.join(drawn.hint("merge"), ["k1", "k2"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 3), "k1", "k2", "copy", "pass"), "k1", "k2", "copy", "pass")
    return rows.select("shard", (F.row_number().over(order) - 1).alias("place"), "row")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lake.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return draws(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")
