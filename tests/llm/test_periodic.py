import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossbook.llm import periodic


def brute(words):
    """Runs by comparing every word with the one q words before, for all q; a stretch counts for its smallest period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x - r] for x in range(start + r, j)) for r in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    flat = np.array([ids[w] for t in texts for w in t], dtype=np.int64)
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(counts) - counts
    out = [[] for _ in texts]
    for s, n, q in zip(*periodic.find_runs(flat, counts), strict=True):
        d = int(np.searchsorted(base + counts, s, side="right"))
        out[d].append((int(s - base[d]), int(n), int(q)))
    return out


def strings():
    rng = random.Random(5)
    for _ in range(300):
        yield [rng.choice("ab") for _ in range(rng.randint(0, 60))]
    for _ in range(200):  # stretches of repeats, some nested, between other words
        t = []
        for _ in range(rng.randint(1, 4)):
            root = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            t += root * rng.randint(1, 7) + root[: rng.randint(0, len(root))] + [rng.choice("abcdxyz") for _ in range(rng.randint(0, 6))]
        yield t * rng.choice([1, 1, 4])
    fib = ["a", "ab"]
    while len(fib) < 11:
        fib.append(fib[-1] + fib[-2])
    yield from (list(x) for x in fib)
    thue = "a"
    for _ in range(8):
        thue += thue.translate(str.maketrans("ab", "ba"))
    yield list(thue)
    yield ["x"] * 500
    yield ["x", "y"] * 200 + ["x"] + ["x"] * 30
    yield []


def test_runs_against_brute_force():
    texts = list(strings())
    assert found(texts) == [brute(t) for t in texts]
    assert sum(map(len, found(texts))) > 300


def test_small_slices(monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 7)
    texts = list(strings())[250:320]
    assert found(texts) == [brute(t) for t in texts]


def test_one_long_repeat():
    rng = random.Random(1)
    root = [str(rng.randrange(1000)) for _ in range(700)]
    assert found([root * 300, ["w"] * 200_000]) == [[(0, 210_000, 700)], [(0, 200_000, 1)]]


def wanted(doc_id, text, rewrite=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    if len(set(words)) == 1 and len(words) > 1000:
        runs = [(0, len(words), 1)]
    else:
        runs = brute(words) if len(words) < 3000 else []
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("shift", [0, 1000, 2000])
def test_query_against_brute_force(spark, make, corpus, tmp_path, shift):
    """With repeated and null ids, null and empty texts and columns of clashing names."""
    rows = [(i + shift, t) for i, t in corpus] + [(None, "la la la la la la " * 3), (None, None), (7, "a b " * 9), (7, "a b " * 9)]
    rows = [r for r in rows if not (r[1] and len(r[1]) > 50_000 and zlib.crc32(str(r[0]).encode()) % 10 == 0)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted((wanted(*r) for r in rows), key=key)


def test_operator_without_rewriting(make):
    (row,) = periodic.runs(make([(1, "so it goes on and on and on and on and on, he said")])).withColumn("collapsed", F.col("collapsed").cast("string")).collect()
    assert [tuple(r) for r in row.runs] == [(3, 8, 2)] and row.collapsed == "so it goes on and on, he said"


def test_empty(make):
    assert periodic.runs(make([])).count() == 0
