import re
from collections import Counter

import numpy as np
import pytest

from crossbook.llm import mixing


def wanted(sizes, share=1.5, most=2.0):
    """Targets by the plain rule: share by weight, cap, reshare."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = dict(zip(names, [5, 2, 1] * len(names), strict=False))
    total, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(out.values())
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            return out | part
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def run(make, rows, **how):
    return mixing.draws(make(rows), **how).collect()


@pytest.fixture(scope="module")
def mix_rows(corpus):
    names = ["b", "a", "é", "A", None, "zz", "hot"]
    rows = [(i, t, names[i % 7] if i % 3 else "hot") for i, t in corpus]
    return [*rows, (None, "a few words here", "a"), (None, "a few words here", "a"), (4, "a few words here", "a"), (4, None, "void"), (5, "", "void")]


@pytest.mark.parametrize("block_words", [1 << 16, 64])
def test_targets_and_draws(make, mix_rows, block_words):
    got = run(make, mix_rows, block_words=block_words, shard_words=500)
    source = {(i, t): s for i, t, s in mix_rows}
    sizes = Counter()
    for _, t, s in mix_rows:
        sizes[s] += size(t)
    targets = wanted(dict(sizes))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in mix_rows)
    by_key = {}
    for (i, t), s in source.items():
        by_key.setdefault((i, size(t)), set()).add(s)
    taken = Counter()
    for r in got:
        assert len(r.shards) <= 2
        (s,) = by_key[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6
        taken[s] += r.size * len(r.shards)
    longest = Counter()
    for _, t, s in mix_rows:
        longest[s] = max(longest[s], size(t))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(longest[s] / 2, 1)


def test_reruns_agree_whatever_the_partitions(make, mix_rows):
    key = lambda rows: sorted(map(str, rows))
    a = mixing.draws(make(mix_rows), block_words=64, shard_words=500).collect()
    b = mixing.draws(make(list(reversed(mix_rows))).repartition(7), block_words=64, shard_words=500).collect()
    assert key(a) == key(b)


def test_many_sources_by_shuffle(make, mix_rows, monkeypatch):
    a = mixing.draws(make(mix_rows), block_words=64).collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.draws(make(mix_rows), block_words=64).collect())) == sorted(map(str, a))


def test_mix_holds_every_draw_once(make, mix_rows):
    drawn = Counter()
    for r in run(make, mix_rows, block_words=64, shard_words=500):
        for s in r.shards:
            drawn[s, r.doc_id, r.size] += 1
    out = mixing.mixed(make(mix_rows), block_words=64, shard_words=500).collect()
    assert Counter((r.shard, r.row.doc_id, size(r.row.text)) for r in out) == drawn
    for s in {r.shard for r in out}:
        assert sorted(r.place for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_equal_rows_are_spread(make):
    got = run(make, [(None, "one two", "s")] * 12_000 + [(1, "x " * 300, "t")], block_words=64)
    of = [r for r in got if r.size == 2]
    assert len(of) == 12_000 and abs(sum(2 * len(r.shards) for r in of) - of[0].target) <= 2


def test_splitting_tree(spark):
    """Exact quotas, shards of equal numbers of blocks, and draws with the hypergeometric mean and variance."""
    quotas = spark.createDataFrame([(0, 700), (1, 250), (2, 50)], "rank long, n long")
    got = np.zeros((100, 3), dtype=int)
    for r in mixing.shard_quotas(quotas, 100).collect():  # more than one round
        got[r.shard, r.rank] = r.n
    assert got.sum(axis=0).tolist() == [700, 250, 50] and set(got.sum(axis=1)) == {10}
    first = []
    for seed in range(1500):
        first.append(mixing.split(0, 4, np.array([20, 10, 10]), 1, lambda k: 10 * k, seed)[1][2])
    first = np.array(first)
    assert np.allclose(first.mean(axis=0), [5, 2.5, 2.5], atol=0.15)
    assert np.allclose(first.var(axis=0), [10 * p * (1 - p) * 30 / 39 for p in (0.5, 0.25, 0.25)], rtol=0.15)


def test_empty(make):
    assert run(make, []) == []
