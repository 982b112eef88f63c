import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossbook.llm import textkit

PATTERNS = ((textkit.PLAIN, r"[^\x20\x09-\x0D]+", False), (textkit.LOWER, r"[^\x20\x09-\x0D]+", True), (textkit.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True))


def scanned(texts, mapping):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return textkit.scan(data, np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64), mapping)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb1é .,\n\t\x00\x0b\x1c", max_size=30), min_size=1, max_size=5))
def test_words_and_hashes(texts):
    for mapping, pattern, lower in PATTERNS:
        words = scanned(texts, mapping)
        low = (lambda t: t.encode().lower().decode()) if lower else (lambda t: t)
        want = [re.findall(pattern, low(t)) for t in texts]
        assert words.counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        got = words.hashes().tolist()
        assert len(set(got)) == len(set(flat)) and all((a == b) == (x == y) for a, x in zip(got, flat) for b, y in zip(got, flat))


def test_windows_are_told_apart():
    words = scanned(["a b c a b c", "b c a b"], textkit.PLAIN)
    starts = words.runs(3)
    h = textkit.sequence_hashes(words.hashes(), starts, 3).tolist()
    assert starts.tolist() == [0, 1, 2, 3, 6, 7] and h[:3] == h[3:] and len(set(h)) == 3


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_chunks_cover_all(size):
    texts = [b"abc", b"", b"x" * 50, None, b"de"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"]).slice(1)
    got = [d[o[i] : o[i + 1]].tobytes() for _, _, d, o in textkit.chunks(batch, "text", size) for i in range(len(o) - 1)]
    assert got == [b"", b"x" * 50, b"", b"de"]
