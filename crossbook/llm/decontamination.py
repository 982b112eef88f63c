"""Removal of benchmark passages by a generalised suffix automaton of the test items.

The items' normalised words make one generalised suffix automaton (a block of bounded words per automaton; a benchmark
beyond the bound is taken block by block, each pass adding to the marks of the one before). Training tokens are streamed
through it and the longest matching length is tracked at every word; where it reaches the window, the words of the window
are marked. Words are read as 64-bit hashes. Stretches whose neighbouring word pairs do not all occur in the items cannot
hold a match of the shortest window, so only the others are streamed.

Null and empty texts or items have no words and match nothing. Rows with the same doc_id are judged separately; items with
the same id count once. Empty tables give empty results or no marks. Other columns are carried through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake, textkit

WINDOW = 10
#: Words of items in one automaton (about 100 bytes of broadcast each).
BLOCK_WORDS = 200_000
#: Marked spans are removed; a text of which more than this share is marked goes as a whole.
MAX_COVERAGE = 0.8


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.len)
        #: The state that holds the suffix of `window` words, for states that long.
        self.top = [-1] * n
        for v in sorted(range(n), key=self.len.__getitem__):
            if self.len[v] >= window:
                p = self.link[v]
                self.top[v] = self.top[p] if self.len[p] >= window else v
        self.items: dict[int, set[str]] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            v = 0
            for i, w in enumerate(words, 1):
                v = self.next[v][w]
                if i >= window:
                    self.items.setdefault(self.top[v], set()).add(name)
            if 0 < len(words) < window:
                ends.setdefault(v, []).append((len(words), name))
        self.short: dict[int, list[tuple[int, str]]] = {}
        if ends:
            for v in range(1, n):
                found, u = [], v
                while u > 0:
                    found += ends.get(u, [])
                    u = self.link[u]
                if found:
                    self.short[v] = found
        self.least = min([window, *(k for e in ends.values() for k, _ in e)])

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def match(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals of all windows found (overlapping ones), and the items they are of."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        spans, found, v, n = [], set(), 0, 0
        for i, w in enumerate(words, 1):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            v = nxt[v].get(w, 0)
            n = n + 1 if v else 0
            if n >= window:
                spans.append((i - window, i))
                found |= self.items[self.top[v]]
            if v in self.short:
                for k, name in self.short[v]:
                    if k <= n:
                        spans.append((i - k, i))
                        found.add(name)
        return spans, found


class Matcher:
    """An automaton over word hashes, with the word and word-pair tables that rule out most of a text."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        data = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in items]))).astype(np.int64)
        words = textkit.scan(data, offsets, textkit.ALNUM)
        self.vocab, ids = np.unique(words.hashes(), return_inverse=True)
        self.automaton = SuffixAutomaton([(name, ids[a : a + n].tolist()) for (name, _), a, n in zip(items, words.first, words.counts, strict=True)], window)
        at = words.runs(2)
        self.pairs = np.unique(ids[at] * len(self.vocab) + ids[at + 1]) if len(at) else np.zeros(0, dtype=np.int64)

    def marks(self, words: textkit.Words) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(text, merged word intervals in the chunk, items) for texts with a hit."""
        least = self.automaton.least
        hashes = words.hashes()
        if not len(self.vocab) or len(hashes) < least:
            return
        ids = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        good = self.vocab[ids] == hashes
        if least > 1:
            pair = good[:-1] & good[1:] & (words.doc[:-1] == words.doc[1:])
            at = np.flatnonzero(pair)
            if not len(at) or not len(self.pairs):
                return
            key = ids[at] * len(self.vocab) + ids[at + 1]
            pair[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
            good = pair
        edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        lo, hi = edges[::2], edges[1::2] + (least > 1)
        long = hi - lo >= least
        of: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for a, b in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
            spans, found = self.automaton.match(ids[a:b].tolist())
            while least == 1 and words.doc[a] != words.doc[b - 1]:  # a stretch of known words may run over texts
                cut = a + int(np.searchsorted(words.doc[a:b], words.doc[a], side="right"))
                self._add(of, words, a, *self.automaton.match(ids[a:cut].tolist()))
                a = cut
                spans, found = self.automaton.match(ids[a:b].tolist())
            self._add(of, words, a, spans, found)
        for d in sorted(of):
            yield d, _merge(of[d][0]), of[d][1]

    @staticmethod
    def _add(of: dict, words: textkit.Words, a: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        if spans:
            have = of.setdefault(int(words.doc[a]), ([], set()))
            have[0].extend((a + x, a + y) for x, y in spans)
            have[1].update(found)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(df: DataFrame, matcher, carry: list[str], cut: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            hits, items = col["_hits"].to_pylist(), [list(x or ()) for x in col["_items"].to_pylist()]
            for row, end, data, offsets in textkit.chunks(batch, "_text"):
                words = textkit.scan(data, offsets, textkit.ALNUM)
                n_words[row:end] = words.counts
                for d, spans, found in m.marks(words):
                    first, origin = words.first[d], words.offsets[d]
                    old = np.frombuffer(hits[row + d] or b"", dtype="<i4").reshape(-1, 4).tolist()
                    both = _merge([(a - first, b - first) for a, b in spans] + [(a, b) for a, b, _, _ in old])
                    hits[row + d] = np.array([[a, b, words.starts[first + a] - origin, words.ends[first + b - 1] - origin] for a, b in both], dtype="<i4").tobytes()
                    items[row + d] = sorted(found.union(items[row + d]))
            n_hit = [0 if h is None else int(np.diff(np.frombuffer(h, dtype="<i4").reshape(-1, 4)[:, :2]).sum()) for h in hits]
            made = {"_n_words": pa.array(n_words), "_n_hit": pa.array(n_hit, pa.int64()), "_hits": pa.array(hits, pa.binary()), "_items": pa.array(items, pa.list_(pa.string()))}
            if cut:
                texts = textkit.texts(batch, "_text")
                made["_clean"] = pa.array([None if h is None else _without(texts[r].as_py(), h) for r, h in enumerate(hits)], pa.string())
            yield pa.RecordBatch.from_arrays([*[col[c] for c in carry], *made.values()], names=[*carry, *made])

    return lake.map_arrow(df, run, lake.schema(df, carry, "_n_words long, _n_hit long, _hits binary, _items array<string>" + ", _clean string" * cut))


def _without(text: str | bytes, hits: bytes) -> str:
    """text without the bytes of the marked spans."""
    raw = text.encode() if isinstance(text, str) else text
    keep, at = [], 0
    for _, _, a, b in np.frombuffer(hits, dtype="<i4").reshape(-1, 4).tolist():
        keep.append(raw[at:a])
        at = b
    return b"".join([*keep, raw[at:]]).decode("utf-8", "replace")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """docs with _n_words, _n_hit, _hits (packed 32-bit word from, word to, byte from, byte to; null: none) and _items (sorted ids); with
    cut also _clean: the text without the marked spans (null where there are none).

    docs needs a text column, or rows as packed by lake; benchmark needs item_id and text."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.size(F.split("text", "[^a-zA-Z0-9\u0080-\U0010ffff]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    carry = docs.columns
    df = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_hits": F.lit(None).cast("binary"), "_items": F.array().cast("array<string>")})
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()  # a block of bounded words
        matcher = spark.sparkContext.broadcast(Matcher(sorted((r.name, r.text.encode()) for r in rows), window))
        if "text" in carry:
            df = df.withColumn("_text", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
        df = _scan(df, matcher, carry, cut and k == blocks - 1)
        if k < blocks - 1:
            df = lake.written(df, "matched")  # so a task holds one block's automaton at a time
    return df


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without marked spans of text, and without the texts of which more than max_coverage is marked."""
    found = matches(lake.packed(docs), benchmark, window, cut=True)
    found = found.where(F.col("_n_hit") <= max_coverage * F.col("_n_words"))
    return lake.unpacked(found, docs, F.coalesce("_clean", "row.text"), F.col("_clean").isNotNull())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(lake.table(spark, sf_dir, "documents").select("doc_id", "text"), lake.table(spark, sf_dir, "benchmark"))
    n_hit = F.col("_n_hit")
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
