import re
from collections import Counter, defaultdict

import pytest

from crossbook.llm import quality

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed


def brute(rows, min_docs, share):
    norm = lambda x: " ".join(LETTERS.findall(x.encode().lower().decode()))
    seen, total = defaultdict(list), Counter()
    for d, t, host in rows:
        total[host or ""] += 1
        for line in {norm(x) for x in (t or "").split("\n")} - {""}:
            seen[host or "", line].append(d)
    often = {k: min(v) for k, v in seen.items() if len(v) > min_docs and len(v) > share * total[k[0]]}
    out = []
    for d, t, host in rows:
        n, *_, failed = base(t)
        gone = sum(len(x.split()) for x in (t or "").split("\n") if often.get((host or "", norm(x)), d) != d)
        out.append((d, *base(t), gone, not failed and not (gone and (n - gone < 50 or n - gone < 0.3 * n))))
    return sorted(out)


@pytest.fixture
def rows(corpus):
    line = "Subscribe to our NEWS-letter, now!"
    texts = [(d, (t or "") + ("\n" + line if d % 2 else "\nsubscribe to our news letter now" if d % 4 == 0 else "") if t is not None else None) for d, t in corpus]
    rows = [(d, t, f"h{d % 3}" if d % 7 else None) for d, t in texts]
    lots = " ".join(f"v{i}" for i in range(60))
    return rows + [(1000 + i, f"{lots}\nown {i}", "h1") for i in range(12)]


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(make, rows, monkeypatch, small):
    if not small:  # as if there were more lines than may be broadcast
        monkeypatch.setattr(quality, "BROADCAST_LINES", -1)
    got = quality.judged(make(rows), min_docs=5, share=0.1).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_boilerplate_words, r.kept) for r in got)
    assert got == brute(rows, 5, 0.1)
    assert sum(g[7] > 0 for g in got) > 10


def test_filtered_removes_lines_but_keeps_the_first(make, rows):
    out = {r.doc_id: r for r in quality.filtered(make(rows), min_docs=5, share=0.1).collect()}
    want = {r[0] for r in brute(rows, 5, 0.1) if r[-1]}
    assert set(out) == want and 1000 in out and 1001 not in out  # of a text that many repeat, one stays
    again = [r for r in out.values() if "ubscribe" in r.text]
    assert len(again) <= 4 and all(r.n_chars == len(r.text) and r.row == "r" for r in out.values())  # one for each host


@pytest.mark.parametrize("size", [200, 3000])
@pytest.mark.parametrize("bound", [10**6, 15, -1])
def test_limit_does_not_rise_with_the_host(make, monkeypatch, size, bound):
    """A banner in 30 documents goes from all but the first, in a small and in a large host; with few lines, and with more than are broadcast."""
    monkeypatch.setattr(quality, "BROADCAST_LINES", bound)
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(60))
    banner = lambda i, n: "".join("\n" + " ".join(f"banner{k}{c}" for c in "abcdef") for k in range(20)) if i < n else ""
    rows = [(i, own(i) + banner(i, 30), "big") for i in range(size)] + [(size + i, own(i) + banner(i, 25), "small") for i in range(100)]
    got = {r.doc_id: r for r in quality.judged(make(rows)).collect()}
    assert {i for i, r in got.items() if r.n_boilerplate_words} == set(range(1, 30)) and got[1].n_boilerplate_words == 120
    clean = {r.doc_id: r.text for r in quality.filtered(make(rows)).collect()}
    assert len(clean) == len(rows) and sum("banner" in t for t in clean.values()) == 1 + 25


@pytest.mark.parametrize("bound", [10**6, -1])
def test_one_row_is_spared_whatever_the_ids(make, monkeypatch, bound):
    """40 documents without an id, 40 under one id and 40 with ids of their own: of each host one keeps the banner, the one with an id first."""
    monkeypatch.setattr(quality, "BROADCAST_LINES", bound)
    text = lambda h, i: " ".join(f"{h}{i}x{k}" for k in range(60)) + "\nthe banner of all"
    rows = [(None, text("n", i), "nulls") for i in range(40)] + [(7, text("s", i), "same") for i in range(40)] + [(i, text("o", i), "own") for i in range(40)]
    rows += [(None, text("m", i), "mixed") for i in range(40)] + [(5, text("m", 99), "mixed")] + [(9, text("e", 0), "equal")] * 30
    out = quality.filtered(make(rows)).collect()
    left = Counter((r.source, r.doc_id) for r in out if "banner" in r.text)
    assert len(out) == len(rows) and left == {("nulls", None): 1, ("same", 7): 1, ("own", 0): 1, ("mixed", 5): 1, ("equal", 9): 30}


def test_empty(make):
    assert quality.judged(make([])).count() == 0
