import hashlib

import pytest
from pyspark.sql import functions as F

from crossbook.llm import substrings


def brute(rows, window):
    first, big = {}, 1 << 62
    split = [((big if d is None else d), (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = b" ".join(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), (n, w) in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < n:
                gone.update(range(i, i + window))
        out.append((str(d), len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window, bits", [(50, 27), (50, 8), (7, 20)])
def test_against_brute_force(make, corpus, window, bits):
    """Also with a sketch far too small: it then lets more windows through and loses none."""
    rows = [*corpus, (3, "another text under id 3 " * 20), (None, corpus[4][1]), (None, corpus[4][1])]
    got = substrings.without_repeats(make(rows), window, bits=bits).withColumn("kept", F.sha2("kept", 256)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, window)


def test_empty(make):
    assert substrings.without_repeats(make([]), bits=10).count() == 0
