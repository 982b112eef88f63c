"""Vectorised word scanning shared by the corpus operators.

Texts reach Python as Arrow binary columns. A chunk of texts is one byte buffer; words are found and hashed with
NumPy over that buffer, so no Python object is made per word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = (2 << 20) - 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _table(20240607)
_BYTES2 = _table(97)


def byte_map(separators: bytes, lower: bool) -> np.ndarray:
    """256 entries: the byte a byte is read as, 0 for those that separate words."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[np.frombuffer(separators, dtype=np.uint8)] = 0
    return out


SPACES = b"\x00 \t\n\r\x0b\x0c"[1:]
#: Words of [^\x20\x09-\x0D]+. Byte 0 is a word byte there, so words are told apart by `is_word`, not by the value.
PLAIN = byte_map(SPACES, lower=False)
LOWER = byte_map(SPACES, lower=True)
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = byte_map(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)
_IS_WORD = {}
for _m, _sep in ((PLAIN, SPACES), (LOWER, SPACES), (ALNUM, None)):
    _w = np.ones(256, dtype=bool)
    if _sep is None:
        _w = _m != 0
    else:
        _w[np.frombuffer(_sep, dtype=np.uint8)] = False
    _IS_WORD[id(_m)] = _w

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2**64. Kept for the longest n asked for."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for base in (_BASE, inverse):
            p = np.ones(size, dtype=np.uint64)
            filled, step = 1, base
            with np.errstate(over="ignore"):
                while filled < size:
                    k = min(filled, size - filled)
                    p[filled : filled + k] = p[:k] * step
                    step = step * step
                    filled += k
            both.append(p)
        have = _powers[0] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sequence_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Hash of values[start : start + length] for each start: polynomial prefix sums, so the cost doesn't depend on length."""
    n = len(values)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=prefix[1:])
        return mix((prefix[starts + lengths] - prefix[starts]) * down[starts] + np.asarray(lengths, dtype=np.uint64))


@dataclass
class Words:
    """Words of a chunk of texts, in order. starts and ends are byte positions in data."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # index of the text in the chunk, of each word
    counts: np.ndarray  # words of each text
    first: np.ndarray  # index of each text's first word
    offsets: np.ndarray  # byte positions of the texts, one more than there are texts
    mapping: np.ndarray

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word as mapped (lower-cased where the mapping does)."""
        table = (_BYTES2 if second else _BYTES)[self.mapping]
        return sequence_hashes(table[self.data], self.starts, self.ends - self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def runs(self, k: int) -> np.ndarray:
        """Indexes of words that start k words of one text."""
        n = len(self.doc)
        if n < k:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])


def scan(data: np.ndarray, offsets: np.ndarray, mapping: np.ndarray) -> Words:
    word = _IS_WORD[id(mapping)][data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return Words(data, starts, ends, doc, counts, first, offsets, mapping)


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column, or where there is none the text field of packed rows (so that texts aren't sent twice)."""
    at = batch.schema.get_field_index(column)
    return batch.column(at) if at >= 0 else pc.struct_field(batch.column(batch.schema.get_field_index("row")), "text")


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch as (first row, end row, bytes, offsets within them); column is Arrow binary, or text in packed rows."""
    col = texts(batch, column)
    if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n, at + 60_000)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
