import random
import re
from collections import defaultdict

import pytest

from crossbook.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = "item_id long, text string, name string"


def words(t):
    return WORD.findall((t or "").encode().lower().decode())


def brute(rows, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if 0 < len(w) < window:
            windows[tuple(w)].add(str(i))
        for k in range(len(w) - window + 1):
            windows[tuple(w[k : k + window])].add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[k : k + size])):
                    found |= ids
                    hit.update(range(k, k + size))
        out.append((str(d), len(w), len(hit), sorted(found)))
    return sorted(out)


def items_of(corpus, short):
    rng = random.Random(8)
    out = []
    for i in range(25):
        w = words(corpus[rng.randrange(len(corpus))][1])
        a = rng.randrange(max(1, len(w) - 30))
        out.append((i, ", ".join(w[a : a + rng.randint(10, 30)]).upper()))
    out += [(3, out[3][1]), (100, ""), (101, None), (102, "...")]
    return out + ([(200, "x"), (201, "changed changed"), (202, " ".join(words(corpus[0][1])[:4]))] if short else [])


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("block_words", [200_000, 60])
def test_against_brute_force(spark, make, corpus, short, block_words):
    """In one automaton and in several, with and without items shorter than a window."""
    items = items_of(corpus, short)
    bench = spark.createDataFrame([(i, t, "n") for i, t in items], BENCH)
    rows = [*corpus, (None, items[0][1])]
    got = decontamination.matches(make(rows).select("doc_id", "text"), bench, block_words=block_words)
    got = got.select("doc_id", "_n_words", "_n_hit", "_items").collect()
    want = brute(rows, items)
    assert sorted((str(a), b, c, list(d)) for a, b, c, d in got) == want
    assert any(w[2] for w in want)


def test_spans_go_and_covered_texts_go(spark, make):
    item = " ".join(f"w{i}" for i in range(12))
    clean = " ".join(f"c{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item, "n")], BENCH)
    docs = make([(1, f"{clean} {item.upper()} {clean}"), (2, item), (3, clean), (4, None)])
    out = {r.doc_id: r for r in decontamination.decontaminated(docs, bench).collect()}
    assert set(out) == {1, 3, 4} and words(out[1].text) == words(f"{clean} {clean}") and out[1].n_chars == len(out[1].text)
    assert out[3].text == clean and out[4].text is None and out[1].kept == "k"


def test_empty(spark, make):
    assert decontamination.matches(make([]).select("doc_id", "text"), spark.createDataFrame([], BENCH)).count() == 0
    assert decontamination.matches(make([(1, "a")]).select("doc_id", "text"), spark.createDataFrame([], BENCH)).first()["_hits"] is None
