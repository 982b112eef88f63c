import itertools
import random

import numpy as np
import pytest

from crossbook.llm import graph, jaccard, lake


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows}  # rows of one id are one node

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and min(len(s), len(t)) * 5 >= 4 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return sorted((d, len(s), top(d)) for d, s in sets)


def edited(rng, n_groups, size, words, rate, first=1000):
    rows, i = [], first
    for _ in range(n_groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        for _ in range(size):
            i += 1
            rows.append((i, " ".join(f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in base)))
    return rows


@pytest.mark.parametrize("rate", [0.01, 0.022, 0.04])
def test_against_brute_force(make, corpus, rate):
    """Groups whose members lie around the limit, so that components hang on single links; sizes from one shingle on."""
    rng = random.Random(int(rate * 1000))
    rows = [*corpus, *edited(rng, 3, 30, 120, rate), *edited(rng, 20, 5, 9, rate, 2000), *edited(rng, 10, 4, 40, rate, 3000)]
    rows += [(5, rows[-1][1]), (6, rows[-30][1])]  # other texts under ids that are there
    assert sorted(map(tuple, jaccard.near_duplicates(make(rows)).collect())) == brute(rows)


def test_small_pieces_lose_no_link(make, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 8)
    monkeypatch.setattr(jaccard, "GATHER", 500)
    rows = edited(random.Random(9), 2, 40, 100, 0.02)
    assert sorted(map(tuple, jaccard.near_duplicates(make(rows)).collect())) == brute(rows)


def test_partners_share_a_block():
    """Pigeonhole: sets at the limit of similarity agree in a key, for all sizes."""
    rng = np.random.default_rng(3)
    for n in [*range(4, 60), 100, 250, 700, 3000]:
        for _ in range(6):
            common = rng.integers(1, 2**63, n).astype(np.uint64)
            a, b = n // 4 if n >= 4 else 0, 0
            k = int(rng.integers(0, a + 1))
            one, two = (np.concatenate((common, rng.integers(1, 2**63, x).astype(np.uint64))) for x in (k, a - k + b))
            sizes = [len(one), len(two)]
            assert 100 * n >= 80 * (n + a)
            keys = []
            for h in (one, two):
                s = np.array([len(h)])
                keys.append({int(x) for low in (False, True) for x in jaccard._block_keys(np.zeros(len(h), dtype=np.int64), h, s, low)[0]})
            assert keys[0] & keys[1], sizes


def test_rarest_blocks_are_enough():
    """Partners still share a key when each leaves out its spare most frequent ones, whatever the frequencies."""
    rng = np.random.default_rng(8)
    for n in (8, 25, 60, 250, 900):
        for _ in range(40):
            common = rng.integers(1, 2**63, n).astype(np.uint64)
            sets = [np.concatenate((common, rng.integers(1, 2**63, x).astype(np.uint64))) for x in (n // 8, n // 4 - n // 8)]
            often, kept = {}, []
            for h in sets:
                at, s, mine = np.zeros(len(h), dtype=np.int64), np.array([len(h)]), set()
                for low in (False, True):
                    keys = {int(x) for x in jaccard._block_keys(at, h, s, low)[0]}
                    # Keys of both are more frequent than others, as in a corpus.
                    order = sorted(keys, key=lambda k: (often.setdefault(k, rng.random() + 2 * (k % 3 == 0)), k))
                    mine |= set(order[: len(order) - int(jaccard._spare(at, h, s, low)[0])])
                kept.append(mine)
            assert kept[0] & kept[1]


def test_parity_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for n, m, both in ((50, 60, 20), (500, 480, 400), (3, 200, 1)):
        x = rng.integers(1, 2**63, both).astype(np.uint64)
        a, b = (np.concatenate((x, rng.integers(1, 2**63, k - both).astype(np.uint64))) for k in (n, m))
        assert np.bitwise_count(jaccard._folded(jaccard._parity(a), 8) ^ jaccard._folded(jaccard._parity(b), 8)).sum() <= n + m - 2 * both


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in {x for a, b in edges if a != b for x in (a, b)}}


def test_nulls_repeats_and_empty(make):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(5, t), (5, t), (None, t), (2, t), (7, "other words here now then some"), (None, "nobody else has these words"), (8, None)]
    got = sorted(map(str, jaccard.near_duplicates(make(rows)).collect()))
    assert got == sorted(f"Row(doc_id={d}, n_shingles={n}, component_id={c})" for d, n, c in [(5, 26, 2), (5, 26, 2), (None, 26, 2), (2, 26, 2), (7, 2, 7), (None, 1, None), (8, 0, 8)])
    assert sorted(r.doc_id for r in jaccard.deduplicated(make(rows[:5])).collect()) == [2, 7]
    assert jaccard.near_duplicates(make([])).count() == 0


def test_partitions_without_words(make):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e f g h"), (5, "a b c d e f g h"), (6, None)]
    got = sorted(map(tuple, jaccard.near_duplicates(make(rows).repartition(6, "doc_id")).collect()))
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 4, 4), (5, 4, 4), (6, 0, 6)]
    assert sorted(r.doc_id for r in jaccard.deduplicated(make(rows).repartition(6, "doc_id")).collect()) == [1, 2, 3, 4, 6]


def test_rows_of_files_keep_their_name(make, corpus, tmp_path):
    """Rows named by their place in files give what a numbered copy gives."""
    make([*corpus, *corpus[:9], (None, "nobody else has these words"), (None, None)]).repartition(3).write.parquet(str(tmp_path / "t"))
    docs = make([]).sparkSession.read.parquet(str(tmp_path / "t"))
    assert lake.row_id(docs) is not None and lake.row_id(docs.where("doc_id > 0")) is None
    one, two = (sorted(((r.doc_id or 0), r.text or "") for r in jaccard.deduplicated(docs, i).collect()) for i in (lake.row_id(docs), None))
    assert one == two and len(one) > 20


def test_rows_without_id_and_repeats_leave_one(make):
    """Unique rows without an id stay, similar ones leave one; so do exact repeats under one id, of which other texts stay."""
    t, u = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, t), (5, t), (None, t), (2, t), (7, "other words here now then some"), (None, "nobody else has these words"), (8, None), (None, None)]
    rows += [(None, u), (None, u), (None, u + " more"), (9, "one text under an id"), (9, "one text under an id"), (9, "and another text under it"), (2, "second text of the least id")]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), (r.text or "")[:6]) for r in jaccard.deduplicated(make(rows)).collect())
    assert got == [(-1, ""), (-1, "nobody"), (-1, "v0 v1 "), (2, "second"), (2, "w0 w1 "), (7, "other "), (8, ""), (9, "and an"), (9, "one te")]
