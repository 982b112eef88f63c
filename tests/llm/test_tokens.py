import functools

import public_tokenizers
import pytest

from crossbook.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def viterbi(word, scores):
    longest, worst = max(map(len, scores)), min(scores.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + worst * n, best[end - 1][1] - n)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
        best.append(max(options))
    return -best[-1][1]


@pytest.mark.parametrize("cache", [800_000, 50])
def test_against_brute_force(make, corpus, monkeypatch, cache):
    monkeypatch.setattr(tokens, "WORD_CACHE", cache)
    rows = [*corpus, (None, "no id 汉字 🙂"), (1, "again")]
    scores = tokens.pieces(PATH)
    of = functools.cache(lambda x: viterbi("▁" + x.decode(), scores))
    want = sorted((str(d), len(w), sum(map(of, w))) for d, t in rows for w in [(t or "").encode().split()])
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in tokens.token_counts(make(rows), PATH).collect()) == want


def test_shared_prefixes():
    scores = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -4.0, "c": -1.0, "bc": -1.2}
    words = sorted(["a", "ab", "abab", "abc", "abcab", "b", "xb"])
    assert tokens.trie_counts(words, scores) == [viterbi(w, scores) for w in words]


def test_empty(make):
    assert tokens.token_counts(make([]), PATH).count() == 0
