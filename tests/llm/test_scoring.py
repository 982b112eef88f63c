import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from crossbook.llm import eliasfano, scoring


def test_elias_fano_round_trip_and_successor():
    rng = np.random.default_rng(4)
    for n, top in ((1, 5), (200, 100), (1000, 10**6), (5000, 2**62)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        ef = eliasfano.EliasFano.of(v)
        assert (ef.get(np.arange(n)) == v).all()
        x = np.concatenate((v, rng.integers(0, top, 300).astype(np.uint64), [np.uint64(top)]))
        assert (ef.successor(x) == np.searchsorted(v, x)).all()
    assert eliasfano.EliasFano.of(np.array([], dtype=np.uint64)).successor(np.array([3], dtype=np.uint64)).tolist() == [0]


def test_trie_of_three_levels(tmp_path):
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(1, 2**63, 50).astype(np.uint64))
    two = np.unique(rng.integers(0, len(words) * 40, 300))
    three = np.unique(rng.integers(0, len(two) * 30, 900))
    level2 = eliasfano.Level.of(len(words), two // 40, two % 40, np.log(two + 1.0))
    level3 = eliasfano.Level.of(len(two), three // 30, three % 30, np.log(three + 1.0))
    trie = eliasfano.Trie(eliasfano.EliasFano.of(words), *eliasfano.quantised(np.arange(len(words)) * 1.0), [level2, level3])
    trie.save(str(tmp_path / "t"))
    trie = eliasfano.Trie.open(str(tmp_path / "t"))
    assert (trie.word_ids(words) == np.arange(len(words))).all() and trie.word_ids(words[:1] + np.uint64(1)).tolist() == [-1]
    a, b, c = (rng.integers(0, k, 4000) for k in (len(words), 40, 30))
    at2 = {int(x): i for i, x in enumerate(two)}
    at3 = {int(x): i for i, x in enumerate(three)}
    want2 = [at2.get(int(x * 40 + y), -1) for x, y in zip(a, b)]
    assert trie.find([a, b]).tolist() == want2
    want3 = [at3.get(i * 30 + int(z), -1) if i >= 0 else -1 for i, z in zip(want2, c)]
    assert trie.find([a, b, c]).tolist() == want3 and max(want3) > 0
    hit = np.array([i for i in want3 if i >= 0])
    assert np.abs(trie.levels[1].value(hit) - np.log(three[hit] + 1.0)).max() < 1e-3


def brute(rows):
    """Interpolated Witten-Bell of order three, by dictionaries; 0 is the marker before a text, None its end."""
    text = lambda t: [*(t or "").encode().lower().split(), None]
    train = [zlib.crc32(str("" if d is None else d).encode()) % 5 != 1 for d, _ in rows]
    c, follow = Counter(), defaultdict(Counter)
    for (_, t), ok in zip(rows, train, strict=True):
        if ok:
            c.update(text(t))
            for u, v, w in zip([0, 0, *text(t)], [0, *text(t)], text(t), strict=False):
                follow[v,][w] += 1
                follow[u, v][w] += 1
    n = sum(c.values())
    mass = n + 0.5 * (len(c) + 1)

    def p(context, w):
        if not context:
            return (c[w] + 0.5) / mass
        after = follow.get(context)
        return p(context[1:], w) if after is None else (after[w] + len(after) * p(context[1:], w)) / (after.total() + len(after))

    out = []
    for (d, t), ok in zip(rows, train, strict=True):
        base = sum(math.log10(p((), w)) for w in text(t))
        score = sum(math.log10(p((u, v), w)) for u, v, w in zip([0, 0, *text(t)], [0, *text(t)], text(t), strict=False))
        out.append((str(d), not ok, len(text(t)), sum(c[w] > 0 for w in text(t)), n, base, score))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("shard_tokens", [1_000_000, 500])
def test_against_brute_force(make, corpus, monkeypatch, shard_tokens):
    monkeypatch.setattr(scoring, "SHARD_TOKENS", shard_tokens)
    rows = [*corpus, (None, "no id"), (1, "second row")]
    got = sorted(map(tuple, scoring.scores(make(rows)).collect()), key=lambda r: (str(r[0]), r[2]))
    want = brute(rows)
    assert [(str(g[0]), *g[1:5]) for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-3 * w[2])


def test_shards_of_frequent_words(make, corpus, monkeypatch):
    """Words dealt to several contexts: the same scores in one shard as in many, and held-out texts gain over the base."""
    monkeypatch.setattr(scoring, "HEAVY", 40)
    rows, found = [*corpus, *((i + 100, t) for i, t in corpus[:30])], []
    for size in (1_000_000, 700):
        monkeypatch.setattr(scoring, "SHARD_TOKENS", size)
        found.append(sorted(map(tuple, scoring.scores(make(rows)).collect()), key=lambda r: r[0]))
    for a, b in zip(*found, strict=True):
        assert a[:5] == b[:5] and a[6] == pytest.approx(b[6], abs=2e-3 * a[2])
    held = [r for r in found[0] if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


@pytest.mark.parametrize(("heavy", "shard_tokens"), [(40, 700), (3, 300), (40, 1_000_000)])
def test_frequent_words_follow_the_formula(make, corpus, monkeypatch, heavy, shard_tokens):
    """Where a frequent word's n-grams are counted doesn't change the model, and so the size of the corpus doesn't."""
    monkeypatch.setattr(scoring, "HEAVY", heavy)
    monkeypatch.setattr(scoring, "SHARD_TOKENS", shard_tokens)
    rows = [*corpus, *((i + 100, t) for i, t in corpus[:30]), (None, "no id")]
    got = sorted(map(tuple, scoring.scores(make(rows)).collect()), key=lambda r: (str(r[0]), r[2]))
    for g, w in zip(got, brute(rows), strict=True):
        assert g[1:5] == w[1:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-3 * w[2])


def test_frequent_words_read_one_shuffle(make, corpus):
    """The n-grams that shards count pairs from and that they score are shuffled once."""
    scored = scoring.scores(make(corpus))
    scored.collect()
    assert "ReusedExchange" in scored._jdf.queryExecution().executedPlan().toString()


def test_differences_round_trip():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 10**9, 500)
    assert (scoring._walked(scoring._steps(x)) == x).all() and scoring._steps(x).min() >= 0
    key = np.sort(rng.integers(0, 40, 500))
    x = x[np.lexsort((x, key))]
    d = scoring._within(x, key)
    assert (scoring._whole(d, key) == x).all() and d.min() >= 0 and scoring._whole(d[:0], key[:0]).tolist() == []


def test_files_cut_otherwise_between_jobs(spark, make, corpus, tmp_path):
    """The plan is made with one number of cores and one split size and run with others, as on a cluster whose executors come and go."""
    path = str(tmp_path / "docs")
    make(corpus).repartition(8).write.parquet(path)
    want = sorted(map(tuple, scoring.scores(spark.read.parquet(path)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism")
    try:
        for a, b in ((1, 8), (8, 1), (4, 2)):
            for name, many in zip(names[1:], (a, a), strict=True):
                spark.conf.set(name, many)
            scored = scoring.scores(spark.read.parquet(path))
            for name, value in zip(names, (3_000, b, b), strict=True):
                spark.conf.set(name, value)
            got = sorted(map(tuple, scored.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
            assert [g[:5] for g in got] == [w[:5] for w in want]
            assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-3)
            spark.conf.unset(names[0])
    finally:
        for name in names:
            spark.conf.unset(name)


def test_empty_and_untrained(make):
    assert scoring.scores(make([])).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = scoring.scores(make([(held, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0.0)
