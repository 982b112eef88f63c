import random
from statistics import median

from crossbook.operators import medians, stats


def test_medians_of_groups(spark):
    """Distinct and equal values, one value, groups with null keys, null values and a group without any."""
    rng = random.Random(3)
    rows = [("a", 1, rng.random()) for _ in range(5001)] + [("a", None, float(k % 7)) for k in range(1000)] + [(None, 1, float(k)) for k in range(10)] + [("b", 2, 4.0), ("b", 2, None), ("c", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "x string, y int, v double")
    want = {}
    for x, y, v in rows:
        if v is not None:
            want.setdefault((x, y), []).append(v)
    figures = df.groupBy("x", "y").count()
    got = {(r.x, r.y): r.m for r in medians.with_median(figures, df, ["x", "y"], "v", "m").collect()}
    assert got == {k: median(v) for k, v in want.items()} | {("c", 1): None}
    assert medians.median_of_all(df, "v", 8.0).first()[0] == median([v for _, _, v in rows if v is not None])
    assert medians.median_of_all(df.limit(0), "v", 8.0).first()[0] == 8.0


def test_durations_without_percentile(spark):
    df = spark.createDataFrame([("s", float(k), k % 2 == 0) for k in range(1, 2001)], "status string, duration_seconds double, still_open boolean")
    out = stats.duration_stats(df, "status")
    assert "percentile" not in out._jdf.queryExecution().toString().lower()
    r = out.first()
    assert (r.n, r.open_n, r.mean, r.median, r.min, r.max) == (2000, 1000, 1000.5, 1000.5, 1.0, 2000.0)
    assert stats.duration_stats(df.limit(0), "status").count() == 0
