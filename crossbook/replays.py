"""Registered queries that run through files, streams and published tables: quotes, books and listings made from the star-schema tables
are landed as JSON, taken in by the engine's own readers, streams and sinks, and read back. Their SQL is computed from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import episodes
from .plans import jobs
from .plans.tables import freed_shuffles, setting, shared_folder, written
from .sources import landed, sinks
from .streaming import streams
from .views import view

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(rows: DataFrame, folder: str, **options) -> None:
    """Adds rows to a landing folder, a JSON object a line; null fields are left out. A file, which one task reads, has so many lines at most."""
    rows.write.mode("append").options(**{"maxRecordsPerFile": 500_000} | options).json(folder, compression="gzip")


def save_matches(matches: DataFrame, base: str) -> None:
    none = matches.limit(0)
    sinks.save_snapshot(none.select("sport", "level", F.lit("").alias("exchange"), F.lit("").alias("market_id"), F.lit("").alias("team"), F.lit(0).alias("src_ord")), matches, none, base)


def quote_lines(at: DataFrame, q: dict[str, str]) -> DataFrame:
    """Landed quotes of both venues at the times of at (k, t, observed_at): event payloads of the first venue, wrapped and bare markets of the second."""
    text = "date_format(observed_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    status = f"CASE WHEN {q['closed']} THEN 'settled' ELSE 'active' END"
    market = lambda side, price, state: f"named_struct('ticker', concat('{side}', k), 'yes_ask_dollars', CAST({price} AS STRING), 'status', {state})"
    both = f"CASE WHEN t = 0 OR k % 3 = 0 THEN array({market('A', q['ka'], status)}, {market('B', q['kb'], chr(39) + 'active' + chr(39))}) ELSE array({market('A', q['ka'], status)}) END"
    first = at.selectExpr("'k' AS venue", f"{text} AS observed_at", f"CASE WHEN k % 2 = 0 THEN named_struct('markets', {both}) END AS event", f"CASE WHEN k % 2 = 1 THEN {both} END AS markets")
    outcomes = "concat('[\"b', k, '\", \"a', k, '\"]')"
    prices = f"concat('[\"', {q['pb']}, '\", \"', {q['pa']}, '\"]')"
    bare = at.where("k % 2 = 0").selectExpr("'p' AS venue", f"{text} AS observed_at", "concat('P', k) AS id", f"{outcomes} AS outcomes", f"{prices} AS outcomePrices", "'true' AS active")
    wrapped = at.where("k % 2 = 1").selectExpr("'p' AS venue", f"{text} AS observed_at", f"named_struct('id', concat('P', k), 'outcomes', {outcomes}, 'outcomePrices', {prices}, 'active', 'true') AS p_market")
    out = first
    for df in (bare, wrapped):
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def price_stream(spark: SparkSession, d: str, q: dict[str, str]) -> DataFrame:
    """The history of price ticks of a stream that is stopped after the first batch and started again for the second. The match table is
    published anew in between: its new version holds the other half of the matches, too."""
    base = shared_folder(spark, "price-stream")
    x = view(spark, d, "orders").selectExpr("o_orderkey AS k", "timestamp_seconds(883612800 + o_orderkey % 80000) AS at")  # polls of a day
    tasks = 4 * spark.sparkContext.defaultParallelism  # a few for each core, so that none waits long for the last ones
    x = x.repartition(tasks, "k")  # even landed files, whatever the table's
    matches = x.selectExpr("'tennis' AS sport", "'atp' AS level", "'d' AS game_date", "concat('a', k) AS team_a", "concat('b', k) AS team_b", "concat('A', k) AS kalshi_id_a", "concat('B', k) AS kalshi_id_b", "concat('P', k) AS poly_id", "0 AS live", "0 AS ended", "k AS src_ord")
    for t in (0, 1):
        save_matches(matches.where("src_ord % 2 = 0") if t == 0 else matches, base)
        land(quote_lines(x.selectExpr("k", f"{t} AS t", f"timestampadd(HOUR, {t}, at) AS observed_at"), q), f"{base}/quotes")
        with setting(spark, "spark.sql.files.minPartitionNum", str(tasks)), setting(spark, "spark.sql.adaptive.coalescePartitions.minPartitionNum", str(tasks)):
            streams.price_tick_stream(spark, f"{base}/quotes", base, base, f"{base}/checkpoint").awaitTermination()
    return sinks.read_history(spark, f"{base}/price_ticks")


def book_lists(levels: DataFrame) -> DataFrame:
    """A row for each book (match_id, side, levels), written: the levels are computed once for all landings. levels: (match_id, side, price, qty)."""
    return written(levels.groupBy("match_id", "side").agg(F.sort_array(F.collect_list(F.struct("price", "qty"))).alias("levels")), "books")


def book_lines(books: DataFrame, k: int) -> DataFrame:
    """Landed order books of the k-th day, of k times the sizes: NO bids of the first venue, asks of the second. books: as book_lists."""
    at = f"2025-01-0{k}T00:00:00Z"
    first = books.where("side = 'L'").selectExpr("concat('L', match_id) AS ticker", f"'{at}' AS observed_at", f"named_struct('no_dollars', transform(levels, x -> array(CAST(round(1 - x.price, 4) AS STRING), CAST(x.qty * {k} AS STRING)))) AS orderbook_fp")
    asks = books.where("side = 'R'").selectExpr("concat('R', match_id) AS token_id", f"'{at}' AS observed_at", f"transform(levels, x -> named_struct('price', CAST(x.price AS STRING), 'size', CAST(x.qty * {k} AS STRING))) AS asks")
    return first.unionByName(asks, allowMissingColumns=True)


def book_stream(spark: SparkSession, matches: DataFrame, books: DataFrame) -> DataFrame:
    """The history of book ticks of a stream over two landings of all books, the second with twice the sizes, started anew for each; the
    history is compacted between them."""
    base = shared_folder(spark, "book-stream")
    save_matches(matches.withColumn("src_ord", F.lit(0)), base)
    for k in (1, 2):
        land(book_lines(books, k), f"{base}/books")
        streams.book_tick_stream(spark, f"{base}/books", base, base, f"{base}/checkpoint").awaitTermination()
        sinks.compact(spark, f"{base}/book_ticks", 1)
    return sinks.read_history(spark, f"{base}/book_ticks")


def episode_stream(spark: SparkSession, ticks: DataFrame, gap: float) -> DataFrame:
    """Episodes of a stream of all ticks, at all thresholds. Ticks come in batches by a time that is up to two days off; at last two rows
    of another match move the watermark past all of them."""
    base = shared_folder(spark, "episode-stream")
    ticks = ticks.select("tick_id", "observed_at", *episodes.MATCH_KEY, "level", "best_edge", "best_trade", "closed", "live", "ended")
    jitter = F.pmod(F.xxhash64("tick_id"), F.lit(172_800))
    batch = F.floor((F.unix_seconds("observed_at") + jitter) / (12 * 86_400)).cast("long")
    ticks.withColumn("batch", batch).write.partitionBy("batch").parquet(f"{base}/ticks")
    cut = spark.read.parquet(f"{base}/ticks")
    sizes = dict(cut.groupBy("batch").count().collect())  # one for each 12 days
    files = 8 if min(sizes.values(), default=0) >= 10_000 else 1  # of each batch, so that a trigger takes one batch
    last = ticks.agg(F.max("observed_at").alias("m")).select(F.expr("stack(2, 0, 1) AS n"), "m")
    end = last.select(
        F.lit(None).cast("long").alias("tick_id"), F.expr("m + make_interval(0, 0, 0, 30 * (n + 1))").alias("observed_at"), *[F.lit("-").alias(c) for c in (*episodes.MATCH_KEY, "level")],
        F.lit(None).cast("double").alias("best_edge"), F.lit("-").alias("best_trade"), F.lit(0).alias("closed"), F.lit(0).alias("live"), F.lit(0).alias("ended"), "n",
    )
    lots = [cut.where(F.col("batch") == b).drop("batch").repartition(files) for b in sorted(sizes)] + [end.where(f"n = {n}").drop("n").coalesce(1) for n in (0, 1)]
    for lot in lots:
        lot.write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(cut.drop("batch").schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    out = streams.stream_episodes(stream, episodes.THRESHOLDS, gap, "3 days")
    run = out.writeStream.format("parquet").option("path", f"{base}/episodes").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True)
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", _ROCKS):
        run.start().awaitTermination()
    return spark.read.parquet(f"{base}/episodes")


#: Events of a landed page.
PAGE = 2000


def paged(rows: DataFrame) -> DataFrame:
    """Rows of events (page, event_pos, and other columns) cut into pages of PAGE events, in the same order; a page's rows are in one task,
    and sorted. Texts are made of them afterwards, so that no text is shuffled or sorted."""
    places = rows.withColumns({"page": F.expr(f"CAST(page * 1000000 + event_pos div {PAGE} AS BIGINT)"), "event_pos": F.expr(f"event_pos % {PAGE}")})
    return places.repartition("page").sortWithinPartitions("page", "event_pos")


def discovered(spark: SparkSession, kalshi: DataFrame, poly: DataFrame) -> str:
    """Lands the listings of both venues, paged, discovers, and gives the folder with the snapshots and the arb history."""
    base = shared_folder(spark, "discover")
    with freed_shuffles(spark):
        landed.land_pages(kalshi, f"{base}/landing/kalshi_events/series=KXNFLGAME", '{"events": [', '], "cursor": null}')
        landed.land_pages(poly, f"{base}/landing/poly_events/tag=nfl")
    jobs.discover(spark, f"{base}/landing", base, ("nfl",))
    return base


def discovered_sports(spark: SparkSession, kalshi: DataFrame, poly: DataFrame) -> str:
    """As discovered, for college football and tennis. Events of the first venue have a column series, those of the second a column tag."""
    base = shared_folder(spark, "discover-sports")
    sports = ("cfb", "tennis")
    with freed_shuffles(spark):
        for sport in sports:
            for series, _ in jobs.SERIES[sport]:
                landed.land_pages(kalshi.where(F.col("series") == series), f"{base}/landing/kalshi_events/series={series}", '{"events": [', '], "cursor": null}')
            landed.land_pages(poly.where(F.col("tag") == sport), f"{base}/landing/poly_events/tag={sport}")
    jobs.discover(spark, f"{base}/landing", base, sports)
    return base


def scanned(spark: SparkSession, matches: DataFrame, books: DataFrame) -> DataFrame:
    """Both directions of every match over books landed at two times, the second with twice the sizes."""
    base = shared_folder(spark, "scan")
    for k in (1, 2):
        lines = book_lines(books, k)
        land(lines.where("ticker IS NOT NULL").select("ticker", "observed_at", "orderbook_fp"), f"{base}/kalshi_books")
        land(lines.where("token_id IS NOT NULL").select("token_id", "observed_at", "asks"), f"{base}/poly_books")
    return jobs.scan_executable(spark, matches, base, lines=True)


def published(spark: SparkSession, ticks: DataFrame, sql: str) -> DataFrame:
    """SQL over the published tables: ticks come in three batches by their old id, the first two of which are compacted while a reader
    holds the version before; old versions are removed once it is done."""
    base = shared_folder(spark, "published")
    path = f"{base}/price_ticks"
    for b in range(3):
        sinks.append(ticks.where(F.col("tick_id") % 3 == b), path, "load", b)
        sinks.append(ticks.where(F.col("tick_id") % 3 == b), path, "load", b)  # a replay adds nothing
        if b == 1:
            reader = sinks.read_history(spark, path)
            sinks.compact(spark, path)
            if reader.count() != sinks.read_history(spark, path).count():
                raise RuntimeError("a reader of the version before a compaction must see the same ticks")
    sinks.expire_history(spark, path, 1)
    own = spark.newSession()
    sinks.register_views(own, base)
    return own.sql(sql)
