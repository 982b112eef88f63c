"""Snapshot tables, append-only histories and SQL views over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matching import dedupe_last
from ..plans.tables import written
from .log import Log

MATCH_KEY = ["sport", "game_date", "team_a", "team_b"]
SNAPSHOT_KEYS = {"markets": ["sport", "exchange", "market_id", "team"], "matches": MATCH_KEY, "arbs": MATCH_KEY}
HISTORIES = ("price_ticks", "arb_history", "book_ticks")
_FLAGS = ("live", "ended")


def evolve(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of ddl that it lacks, as nulls."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(ddl) if f.name not in have})


def _flags(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in _FLAGS if c in df.columns})


def _snapshots(spark: SparkSession, base: str) -> Log:
    return Log(spark, f"{base}/snapshots/_log")


class Conflict(Exception):
    """Another writer has published a snapshot since the one that this one was to follow."""


#: So many keys that come again are broadcast at most.
REPEATED = 250_000


def last_of_repeated(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """dedupe_last of a table, read twice, few of whose keys come again: hashes of keys are counted, and only rows of those found again are
    shuffled; the others stay where they are. With more than REPEATED such hashes all rows are shuffled."""
    key = F.xxhash64(*keys)  # keys of equal hashes are told apart by dedupe_last
    again = written(df.select(key.alias("_key")).groupBy("_key").count().where("count > 1").select("_key"), "repeated")
    if (n := again.count()) == 0:
        return df
    if n > REPEATED:
        return dedupe_last(df, keys, order)
    hashed = df.withColumn("_key", key)
    part = lambda how: hashed.join(F.broadcast(again), "_key", how).drop("_key")
    return part("left_anti").unionByName(dedupe_last(part("left_semi"), keys, order))


def save_snapshot(markets: DataFrame, matches: DataFrame, arbs: DataFrame, base: str, follows: int | None = None, rare: bool = False) -> str:
    """Writes the three tables in a folder of their own and publishes it as the next version, so readers see all or nothing. rare: they
    are tables to read, not to compute, and few of their keys come again.

    Two writers at once get two versions, the later one being current. follows: the version that this one must come right after;
    where another has been published meanwhile, Conflict is raised and nothing is published."""
    spark = matches.sparkSession
    folder = f"{base}/snapshots/{uuid.uuid4().hex}"
    for name, df in (("markets", markets), ("matches", matches), ("arbs", arbs)):
        df = _flags(df)
        if "market_id" in df.columns:
            df = df.withColumn("market_id", F.col("market_id").cast("string"))
        # The last row of a key to arrive.
        order = next((c for c in ("src_ord", "ord", "kalshi_event_id", "kalshi_event") if c in df.columns), "game_date")
        last = (last_of_repeated if rare else dedupe_last)(df, SNAPSHOT_KEYS[name], order)
        last.write.parquet(f"{folder}/{name}", compression="zstd")
    log = _snapshots(spark, base)
    while True:
        number = log.latest()[0]
        if follows is None or number == follows:
            if log.create(number + 1, {"folder": folder}):
                return folder
        if follows is not None:
            log.remove_folder(folder)
            raise Conflict(f"version {log.latest()[0]} was published after {follows}")


def snapshot_version(spark: SparkSession, base: str) -> int:
    """The current version's number, -1 where there is none."""
    return _snapshots(spark, base).latest()[0]


def read_snapshot(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    log = _snapshots(spark, base)
    entry = log.latest()[1] if version is None else log.read(version)
    if entry is None:
        raise FileNotFoundError(f"no snapshot {'' if version is None else version} in {base}")
    return spark.read.parquet(f"{entry['folder']}/{name}")


def expire_snapshots(spark: SparkSession, base: str, keep: int = 10) -> None:
    """Removes all but the last versions. Streams that were stopped longer than that read the current one."""
    log = _snapshots(spark, base)
    for number in log.numbers()[:-keep]:
        log.remove_folder(log.read(number)["folder"])
        log.delete(number)


# Histories: a batch of ticks is a folder of files by date; the log lists the batches that count. A row's tick_id is the first id of its
# part of the batch, which the log gives out in order of arrival, and its place in that part.
_EMPTY = {"batches": {}, "next": 0, "writers": {}, "schema": {"type": "struct", "fields": []}}
_OWN = ("batch", "part", "pos", "tick_id", "obs_date")


def _history(spark: SparkSession, path: str) -> Log:
    return Log(spark, f"{path}/_log")


def _merged(old: dict, df: DataFrame) -> dict:
    """The table's columns and those that df adds to them."""
    fields = {f.name: f for f in T.StructType.fromJson(old)}
    for f in df.schema:
        if f.name not in _OWN:
            have = fields.setdefault(f.name, T.StructField(f.name, f.dataType))
            if have.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {have.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType(list(fields.values())).jsonValue()


def append(df: DataFrame, path: str, writer: str | None = None, number: int | None = None) -> None:
    """Adds df to a history as one batch, whole or not at all. A writer numbers its batches; one that it has added before (a replay)
    isn't added again. Ticks are ordered by time and match within a batch, and after all earlier batches. Each of a batch's days is a
    folder of files, so one that spans years (a backfill) is better added month by month."""
    spark = df.sparkSession
    log, batch = _history(spark, path), f"b{uuid.uuid4().hex}"
    known = lambda state: writer is not None and state["writers"].get(writer, -1) >= number
    if known(log.latest()[1] or _EMPTY):
        return
    df = _flags(df.drop(*_OWN)).withColumn("obs_date", F.date_from_unix_date(F.floor(F.unix_seconds("observed_at") / 86400).cast("int")))
    df = df.sort("observed_at", *[c for c in MATCH_KEY if c in df.columns])
    df = df.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    df.write.partitionBy("obs_date").parquet(f"{path}/batch={batch}")
    written = spark.read.schema("part int, pos long").parquet(f"{path}/batch={batch}")
    sizes = sorted(written.groupBy("part").agg(F.max("pos") + 1).collect())  # one row a partition
    if not sizes:
        log.remove_folder(f"{path}/batch={batch}")
    while True:
        version, state = log.latest()
        state = state or _EMPTY
        if known(state):
            log.remove_folder(f"{path}/batch={batch}")
            return
        parts, first = [], state["next"]
        for part, n in sizes:
            parts.append([part, first])
            first += n
        entry = {"batches": state["batches"] | ({batch: parts} if parts else {}), "next": first, "writers": state["writers"] | ({writer: number} if writer else {}), "schema": _merged(state["schema"], df)}
        if log.create(version + 1, entry):
            return


def read_history(spark: SparkSession, path: str, version: int | None = None, batches: list[str] | None = None) -> DataFrame | None:
    """A history as of a version (now), or some batches of it; None where nothing has been added. Columns come from the log, so no
    file is opened for its schema, and filters on obs_date leave out folders."""
    log = _history(spark, path)
    state = log.latest()[1] if version is None else log.read(version)
    found = {b: p for b, p in (state or _EMPTY)["batches"].items() if batches is None or b in batches}
    if not found:
        return None
    columns = T.StructType.fromJson(state["schema"]).add("part", "integer").add("pos", "long").add("obs_date", "date").add("batch", "string")
    df = spark.read.schema(columns).option("basePath", path).parquet(*[f"{path}/batch={b}" for b in found])
    first = spark.createDataFrame([(b, part, n) for b, parts in found.items() for part, n in parts], "batch string, part int, first long")
    # A row for each part of the batches added since the last compaction.
    return df.join(F.broadcast(first), ["batch", "part"]).withColumn("tick_id", F.col("first") + F.col("pos")).drop("first", "part", "pos", "batch")


def compact(spark: SparkSession, path: str, least: int = 2) -> bool:
    """Rewrites the batches added since the last compaction, if there are so many, as one, in files by date and match. Readers of an
    earlier version go on reading its files until expire_history removes them. False where there was nothing to do or another
    compaction was first."""
    log = _history(spark, path)
    version, state = log.latest()
    old = [b for b, parts in (state or _EMPTY)["batches"].items() if parts != [[-1, 0]]]
    if len(old) < least:
        return False
    batch = f"b{uuid.uuid4().hex}"
    df = read_history(spark, path, version, old).withColumns({"part": F.lit(-1), "pos": F.col("tick_id")}).drop("tick_id")
    df = spark.sql("SELECT /*+ REBALANCE(obs_date) */ * FROM {df}", df=df)  # a long day is split by size
    order = [c for c in (*MATCH_KEY, "observed_at") if c in df.columns]
    df.sortWithinPartitions("obs_date", *order).write.partitionBy("obs_date").parquet(f"{path}/batch={batch}")
    while True:
        version, state = log.latest()
        if not all(b in state["batches"] for b in old):
            log.remove_folder(f"{path}/batch={batch}")
            return False
        left = {b: p for b, p in state["batches"].items() if b not in old}
        if log.create(version + 1, state | {"batches": left | {batch: [[-1, 0]]}}):
            return True


def expire_history(spark: SparkSession, path: str, keep: int = 20) -> None:
    """Removes all but the last versions, and the batches that only they list."""
    log = _history(spark, path)
    numbers = log.numbers()
    kept = {b for n in numbers[-keep:] for b in log.read(n)["batches"]}
    for n in numbers[:-keep]:
        for b in log.read(n)["batches"]:
            if b not in kept:
                log.remove_folder(f"{path}/batch={b}")
        log.delete(n)


def arb_rows(arbs: DataFrame, source: str) -> DataFrame:
    """Rows of the arb history: arbs only, and not of closed markets."""
    df = arbs.where("is_arb = 1")
    return (df.where("closed = 0") if "closed" in df.columns else df).withColumn("source", F.lit(source))


def append_arb_history(arbs: DataFrame, base: str, source: str) -> None:
    df = arbs if "observed_at" in arbs.columns else arbs.withColumn("observed_at", F.current_timestamp())
    append(arb_rows(df, source), f"{base}/arb_history")


def append_price_ticks(df: DataFrame, base: str) -> None:
    append(df, f"{base}/price_ticks")


def append_book_ticks(df: DataFrame, base: str) -> None:
    append(df, f"{base}/book_ticks")


def register_views(spark: SparkSession, base: str) -> list[str]:
    """The six tables, as they are now, as temporary views; those that hold anything."""
    found = []
    if snapshot_version(spark, base) >= 0:
        for name in SNAPSHOT_KEYS:
            read_snapshot(spark, base, name).createOrReplaceTempView(name)
            found.append(name)
    for name in HISTORIES:
        df = read_history(spark, f"{base}/{name}")
        if df is not None:
            df.createOrReplaceTempView(name)
            found.append(name)
    return found
