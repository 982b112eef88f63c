import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from crossbook.functions.scalars import name_keys, names_equal
from crossbook.operators import matching, scoring

OUT = "sport string, level string, team string, opponent string, game_date date, yes_price double, market_id string, src_ord long"
D = date(2025, 1, 10)


def serial(cand):
    """cand: (k, delta, p_date, p); each k in order takes its nearest free p."""
    used_k, used_p, out = set(), set(), set()
    for k, _, _, p in sorted(cand):
        if k not in used_k and p not in used_p:
            used_k.add(k)
            used_p.add(p)
            out.add((k, p))
    return out


def test_fold_and_rounds_equal_serial(spark):
    rng, rows, want = random.Random(1), [], set()
    for pair in range(15):
        games = {v: [(pair * 100 + i * 2 + (v == "p"), D + timedelta(days=rng.randint(0, 6))) for i in range(rng.randint(1, 6))] for v in "kp"}
        cand = [(k, abs((pd - kd).days), pd, p) for k, kd in games["k"] for p, pd in games["p"] if abs((pd - kd).days) <= 2]
        want |= serial(cand)
        rows += [("x", [f"a{pair}", f"b{pair}"], k, dlt, pd, p) for k, dlt, pd, p in cand]
    df = spark.createDataFrame(rows, "sport string, k_pair array<string>, k_ord long, delta int, p_game_date date, p_ord long")
    for f in (matching.assign_one_to_one, matching.assign_in_rounds):
        assert {(r.k_ord, r.p_ord) for r in f(df).collect()} == want


def test_group_games_first_meta_last_price(spark):
    rows = [("nfl", "pro", "b", "a", D, 0.4, "m1", 1), ("nfl", "x", "b", "a", D, 0.5, "m2", 5), ("nfl", "pro", "a", "b", D, 0.6, "m3", 3), ("nfl", "pro", "a", "a", D, 0.1, "m", 4), ("nfl", "pro", "a", "", D, 0.1, "m", 4), ("nfl", "pro", "a", "b", None, 0.1, "m", 4)]
    r = matching.group_games(spark.createDataFrame(rows, OUT)).collect()
    assert len(r) == 1
    assert (r[0].pair, r[0].ord, r[0].meta.level, r[0].a.yes_price, r[0].b.yes_price, r[0].b.market_id) == (["a", "b"], 1, "pro", 0.6, 0.5, "m2")


def test_match_within_a_day_without_cartesian(spark):
    k = spark.createDataFrame([("nfl", "pro", "a", "b", D, 0.4, "k", 1), ("nfl", "pro", "b", "a", D, 0.5, "k2", 2)], OUT)
    p = spark.createDataFrame([("nfl", "pro", "a", "b", D + timedelta(days=1), 0.5, "p", 1), ("nfl", "pro", "b", "a", D + timedelta(days=1), 0.45, "p", 2), ("nfl", "pro", "a", "b", D + timedelta(days=2), 0.1, "q", 3)], OUT)
    m = matching.match_markets(k, p)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    r = scoring.score_arbs(m).collect()
    assert len(r) == 1
    assert (r[0].best_cost, r[0].best_edge, r[0].is_arb, r[0].best_trade) == (0.85, 0.15, 1, "buy a Kalshi YES + b Polymarket YES")


def test_fuzzy_players(spark):
    row = lambda t, o, n, i: ("tennis", "atp", t, o, D, 0.5, n, i)
    k = spark.createDataFrame([row("carlos alcaraz", "jannik sinner", "k", 1), row("jannik sinner", "carlos alcaraz", "k", 2), row("j smith", "a smith", "k3", 3)], OUT)
    p = spark.createDataFrame([row("c alcaraz", "sinner", "p", 1), row("sinner", "c alcaraz", "p", 2), row("smith", "b jones", "p3", 3)], OUT)
    for keys in (None, name_keys):
        r = matching.match_markets(k, p, names_equal, keys=keys).collect()
        assert [(x.team_a, x.poly_id) for x in r] == [("carlos alcaraz", "p")]


def test_equal_names_share_a_key(spark):
    """And so blocks lose no candidate."""
    rng = random.Random(7)
    part = lambda: "".join(rng.choice("abe") for _ in range(rng.randint(1, 4)))
    names = sorted({" ".join(part() for _ in range(rng.randint(1, 3))) for _ in range(150)} | {"a", "ab", "van de", "x van abe", "de la"})
    df = spark.createDataFrame([(n,) for n in names], "x string")
    a, b = df.select(F.col("x").alias("a"), name_keys(F.col("x"), True).alias("ka")), df.select(F.col("x").alias("b"), name_keys(F.col("x"), False).alias("kb"))
    equal = a.crossJoin(b).where(names_equal(F.col("a"), F.col("b")))
    assert equal.count() > len(names)
    assert equal.where(~F.arrays_overlap("ka", "kb")).count() == 0
    rows = [("tennis", "atp", *pair, D + timedelta(days=i % 3), 0.5, str(i), i) for i in range(60) for x, y in [rng.sample(names, 2)] for pair in ((x, y), (y, x))]
    kg, pg = (matching.group_games(spark.createDataFrame(rows[i::2], OUT)) for i in (0, 1))
    found = [sorted((r.k_ord, r.p_ord, r.map_a, r.map_b) for r in matching.pair_candidates_fuzzy(kg, pg, names_equal, keys=keys).collect()) for keys in (None, name_keys)]
    assert found[0] == found[1] and len(found[0]) > 50


def test_scoring_drops_unpriced(spark):
    df = spark.createDataFrame([("a", "b", 0.5, 0.5, 0.5, None)], "team_a string, team_b string, kalshi_yes_a double, poly_yes_a double, kalshi_yes_b double, poly_yes_b double")
    assert scoring.score_arbs(df).count() == 0
    q = scoring.score_quotes(df).first()
    assert (q.best_cost, q.best_edge, q.is_arb, q.best_trade) == (None, None, 0, None)


def test_dedupe_last(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, o int")
    assert matching.dedupe_last(df, ["k"], "o").select(F.col("v")).collect() == [("y",)]


def test_cluster_needs_a_checkpoint_folder():
    from types import SimpleNamespace as Fake

    from crossbook.plans import tables

    def session(master, base):
        made = []
        sc = Fake(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
        df = Fake(sparkSession=Fake(sparkContext=sc, conf=Fake(get=lambda key, default: base)), checkpoint=lambda: "cut")
        return df, made

    df, _ = session("spark://host:7077", None)
    with pytest.raises(ValueError):
        tables.cut(df)
    for master, base in (("spark://host:7077", "hdfs://c"), ("local[4]", None)):
        df, made = session(master, base)
        assert tables.cut(df) == "cut" and len(made) == 1 and (base is None or made == [base])


def test_a_pair_that_plays_daily_takes_linear_time(spark):
    """33,333 days in a row, each game touching the next: 100,000 candidates of one pair."""
    import time

    n = 33_333
    day = lambda k: f"date_add(DATE '1990-01-01', CAST({k} AS INT))"
    cand = spark.range(n).selectExpr("'nfl' AS sport", "array('a', 'b') AS k_pair", "id AS k_ord", f"{day('id')} AS k_game_date", "explode(array(-1, 0, 1)) AS off").where(f"k_ord + off BETWEEN 0 AND {n - 1}")
    cand = cand.selectExpr("*", "k_ord + off AS p_ord", f"{day('k_ord + off')} AS p_game_date", "abs(off) AS delta").drop("off")
    start = time.time()
    got = matching.assign_one_to_one(cand).select("k_ord", "p_ord").collect()
    assert len(got) == n and all(r.k_ord == r.p_ord for r in got) and time.time() - start < 60


def test_keys_of_names_are_made_of_games_not_of_listings(spark):
    rows = [("tennis", a, b, D, i) for i in range(6) for a, b in (("ann lee", "bo fox"), ("bo fox", "ann lee"))]
    games = matching.group_games(spark.createDataFrame(rows, "sport string, team string, opponent string, game_date date, src_ord long"))
    df = matching.pair_candidates_fuzzy(games, games, names_equal, 1, name_keys)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()  # games are read as written
    assert [(r.k_ord, r.p_ord, r.map_a) for r in df.collect()] == [(0, 0, "ann lee")]
