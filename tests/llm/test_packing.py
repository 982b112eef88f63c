import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crossbook.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_ids_and_places(make, corpus):
    rows = packing.pack(packing.pieces(make([*corpus, (None, "no id"), (1, "a second row of id 1")]), PATH)).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for d, t in [*corpus, (None, "no id"), (1, "a second row of id 1")]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want.append((d, k, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)) == sorted(map(key, want))
    assert check_places(rows, 4096) == -(-sum(w[3] for w in want) // 4096)


@pytest.mark.parametrize("text", ["Don't stop, it's 3.5% OF Ünïcode-ÉCOLE!", "İstanbul I'LL  we'Ve", "<|endoftext|> x", "áb é.", "x y 　z", "...,, a.,b", "ª º µ ß ﬁ", "١٢ abc1 \x1c\x85"])
def test_words_encode_as_the_text(text):
    encode, _ = packing._word_encoder(PATH)
    for _ in range(2):  # fresh, then remembered
        assert np.frombuffer(encode(text.encode()), dtype="<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_patterns_use_every_length_once():
    rng = random.Random(2)
    for _ in range(20):
        h = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
        patterns = packing.fill_patterns(h, 100)
        used = {}
        for p, times in patterns:
            assert sum(n * k for n, k in p.items()) <= 100
            for n, k in p.items():
                used[n] = used.get(n, 0) + k * times
        assert used == h


def test_fullest_bin_is_found():
    # The best bin for 60 is 60 + 25 + 15; first-fit decreasing would take 60 + 30
    assert packing.fill_patterns({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == ({60: 1, 25: 1, 15: 1}, 1)


def test_empty(make):
    assert packing.pack(packing.pieces(make([]), PATH)).count() == 0
