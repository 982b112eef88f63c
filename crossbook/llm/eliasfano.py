"""Elias-Fano sequences and an n-gram trie over them; arrays can be memory-mapped, queries are vectorised."""

from __future__ import annotations

import json

import numpy as np

class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._places: tuple[np.ndarray, np.ndarray] | None = None

    def _bits(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the set and the unset high bits, laid out at the first question: a level is asked for many values at once."""
        if self._places is None:
            bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
            kind = np.int32 if len(bits) < 1 << 31 else np.int64
            self._places = np.flatnonzero(bits).astype(kind), np.flatnonzero(bits == 0).astype(kind)
        return self._places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        high = np.zeros((n + (most >> bits) + 2 + 63) // 64 * 64, dtype=np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(high, bitorder="little").view(np.uint64)
        low = np.zeros((n * bits + 63) // 64 + 2, dtype=np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = shift > 0
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(n, bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.low_bits
        shift = (at & 63).astype(np.uint64)
        left = np.where(shift > 0, self.low[(at >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[at >> 6] >> shift | left) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        high = self._bits()[0][i].astype(np.int64) - i
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value of at least x (n: none)."""
        x = np.asarray(x, dtype=np.uint64)
        out = np.full(len(x), self.n, dtype=np.int64)
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = self._bits()[1]
        ok = np.flatnonzero(top < len(zeros))
        if not self.n or not len(ok):
            return out
        h, low = top[ok], x[ok] & np.uint64((1 << self.low_bits) - 1)
        end = np.minimum(zeros[h] - h, self.n)
        at = np.where(h > 0, zeros[np.maximum(h - 1, 0)] - (h - 1), 0)
        run = np.flatnonzero(at < end)  # values of equal high bits ascend, so these are halved
        while len(run):
            middle = (at[run] + end[run]) >> 1
            less = self._low(middle) < low[run]
            at[run[less]] = middle[less] + 1
            end[run[~less]] = middle[~less]
            run = run[at[run] < end[run]]
        out[ok] = at
        return out

    def parts(self) -> dict[str, np.ndarray]:
        return {"n": np.array([self.n, self.low_bits]), "low": self.low, "high": self.high}


class Level:
    """Children of every node of the level above: context-relative ids in one monotone sequence, and quantised values.

    A node's children are coded from its smallest child on and its span begins where the span of the node before it ends, so a
    child is found by one successor search within the node's span."""

    def __init__(self, pointers: EliasFano, bases: EliasFano, keys: EliasFano, least: np.ndarray, codes: np.ndarray, scale: np.ndarray):
        self.pointers, self.bases, self.keys, self.least, self.codes, self.scale = pointers, bases, keys, least, codes, scale

    @classmethod
    def of(cls, parents: int, parent: np.ndarray, child: np.ndarray, values: np.ndarray) -> Level:
        """parent, child: sorted by both, distinct."""
        count = np.bincount(parent, minlength=parents)
        pointers = np.concatenate(([0], np.cumsum(count)))
        full = count > 0
        least, span = np.zeros(parents, dtype=np.int64), np.zeros(parents, dtype=np.int64)
        least[full] = child[pointers[:-1][full]]
        span[full] = child[pointers[1:][full] - 1] - least[full] + 1
        bases = np.concatenate(([0], np.cumsum(span)))
        keys = bases[parent] + child - least[parent]
        return cls(EliasFano.of(pointers), EliasFano.of(bases), EliasFano.of(keys), least.astype(np.uint32), *quantised(values))

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Index of each (parent, child), -1 where there is none or either is -1."""
        out = np.full(len(parent), -1, dtype=np.int64)
        asked = np.flatnonzero((parent >= 0) & (child >= 0))
        parent, child = parent[asked], child[asked]
        base, until = self.bases.get(parent).astype(np.int64), self.bases.get(parent + 1).astype(np.int64)
        x = base + child - self.least[parent].astype(np.int64)
        ok = np.flatnonzero((x >= base) & (x < until))
        at = self.keys.successor(x[ok])
        hit = at < self.keys.n
        hit[hit] = self.keys.get(at[hit]) == x[ok][hit].astype(np.uint64)
        out[asked[ok[hit]]] = at[hit]
        return out

    def value(self, at: np.ndarray) -> np.ndarray:
        return self.scale[0] + self.scale[1] * self.codes[at]


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes, and (least value, step)."""
    lo, hi = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (hi - lo) / 65535 or 1.0
    return np.rint((values - lo) / step).astype(np.uint16), np.array([lo, step])


class Trie:
    """Levels of an n-gram trie. The first holds the words (sorted 64-bit hashes), each further one the ids below a node."""

    def __init__(self, words: EliasFano, codes: np.ndarray, scale: np.ndarray, levels: list[Level]):
        self.words, self.codes, self.scale, self.levels = words, codes, scale, levels

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        at = self.words.successor(hashes)
        hit = at < self.words.n
        hit[hit] = self.words.get(at[hit]) == hashes[hit]
        return np.where(hit, at, -1)

    def word_value(self, ids: np.ndarray) -> np.ndarray:
        return self.scale[0] + self.scale[1] * self.codes[ids]

    def find(self, path: list[np.ndarray]) -> np.ndarray:
        """Index, on the level of the path's length, of each path of a word id and ids below it; -1: none."""
        at = np.asarray(path[0], dtype=np.int64)
        for level, ids in zip(self.levels, path[1:]):
            ok = np.flatnonzero(at >= 0)
            below = np.full(len(at), -1, dtype=np.int64)
            below[ok] = level.find(at[ok], np.asarray(ids, dtype=np.int64)[ok])
            at = below
        return at

    def save(self, path: str) -> None:
        arrays = {f"w.{k}": v for k, v in self.words.parts().items()} | {"codes": self.codes, "scale": self.scale}
        for i, x in enumerate(self.levels):
            for name in ("pointers", "bases", "keys"):
                arrays |= {f"{i}.{name}.{k}": v for k, v in getattr(x, name).parts().items()}
            arrays |= {f"{i}.least": x.least, f"{i}.codes": x.codes, f"{i}.scale": x.scale}
        index, at = {}, 0
        for k, v in arrays.items():
            index[k] = (at, v.dtype.str, len(v))
            at += -(-v.nbytes // 8) * 8
        head = json.dumps(index).encode()
        head += b" " * (-len(head) % 8)
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for v in arrays.values():
                f.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 8))

    @classmethod
    def open(cls, path: str) -> Trie:
        data = np.memmap(path, dtype=np.uint8, mode="r")
        size = int.from_bytes(data[:8].tobytes(), "little")
        index = json.loads(data[8 : 8 + size].tobytes())

        def arr(k: str) -> np.ndarray:
            at, kind, n = index[k]
            return data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind)

        def seq(k: str) -> EliasFano:
            n, bits = arr(f"{k}.n").tolist()
            return EliasFano(n, bits, arr(f"{k}.low"), arr(f"{k}.high"))

        levels = []
        while f"{len(levels)}.least" in index:
            i = len(levels)
            levels.append(Level(seq(f"{i}.pointers"), seq(f"{i}.bases"), seq(f"{i}.keys"), arr(f"{i}.least"), arr(f"{i}.codes"), arr(f"{i}.scale")))
        return cls(seq("w"), arr("codes"), arr("scale"), levels)
