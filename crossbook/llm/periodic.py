"""Runs of repeated word sequences (maximal periodicities), by the branching-tandem test on an enhanced suffix array.

Texts of a chunk are sorted as word suffixes, text by text: prefix doubling refines only suffixes that are not yet told apart. LCP values
come from the irreducible ones, whose sum is small, and are carried on to the others. For each LCP interval, given by its bounds in the
arrays, the suffixes of the smaller part test by the inverse suffix array whether the suffix `depth` words further on or back lies in the
other part: then both start a square of period `depth` that can't move right. Such a square is rotated left as far as it goes, which
gives the run that ends there; of squares that end together, those that only repeat a smaller period of the run are merged into it.
No tree nodes are made; all steps are NumPy over whole chunks, and cost n log n in the words of a text.

Texts in which no five words occur twice hold no run and are left out before sorting. Words are compared by 64-bit hashes.

Null and empty texts have no words and no runs, and an empty collapsed text. Each row is a text of its own, whatever its id. Texts are
never cut: a very long one is a chunk by itself. Of runs with the same start the one of smaller period comes first. An empty table gives
an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake, textkit

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Elements handled at once where a step spreads ranges.
SLICE = 1 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
Order = Callable[[int | None, int], np.ndarray | None]


def suffix_array(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions sorted by (text, suffix up to the text's end), and the place of each position."""
    n = len(ids)
    key = doc * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    active, h = np.arange(n), 1
    while True:
        alone = new[active].copy()
        alone &= np.append(new, True)[active + 1]
        active = active[~alone]
        if not len(active):
            return order, rank
        suffix = order[active]
        further = suffix + h
        second = np.where(further < end[suffix], rank[np.minimum(further, n - 1)] + 1, 0)
        key = head[active] * (n + 1) + second
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[active] = suffix
        first = np.ones(len(active), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        new[active] = first
        head[active] = np.maximum.accumulate(np.where(first, active, 0))
        rank[suffix] = head[active]
        h *= 2


def _common(ids: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, sign: int = 1) -> np.ndarray:
    """How many words from a and from b on (back, where sign is -1) are equal, at most room."""
    out = np.zeros(len(a), dtype=np.int64)
    live, width = np.flatnonzero(room > 0), 4
    while len(live):
        step, still = np.arange(width), []
        for part in np.array_split(live, max(1, len(live) * width // SLICE)):
            at = out[part][:, None] + step
            inside = at < room[part][:, None]
            at = np.where(inside, at, 0) * sign
            same = (ids[a[part][:, None] + at] == ids[b[part][:, None] + at]) & inside
            equal = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[part] += equal
            still.append(part[equal == width])
        live, width = np.concatenate(still), min(4 * width, 4096)
    return out


def lcp_array(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Equal words of each suffix and the one sorted before it; -1 for the first of a text."""
    n = len(ids)
    before = np.where(rank > 0, order[rank - 1], 0)
    fresh = (rank == 0) | (doc[before] != doc)
    at = np.arange(n)
    start = np.ones(n, dtype=bool)
    start[1:] = doc[1:] != doc[:-1]
    # Reducible: the words before both are equal, and so are the suffixes there; the value is one less than the last one's.
    reducible = ~fresh & ~start & (before > 0) & (ids[before - 1] == ids[at - 1]) & (doc[before - 1] == doc)
    reducible[1:] &= ~fresh[:-1]
    hard = np.flatnonzero(~fresh & ~reducible)
    value = np.zeros(n, dtype=np.int64)
    a, b = hard, before[hard]
    value[hard] = _common(ids, a, b, np.minimum(end[a] - a, end[b] - b)) + hard
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    value = value[source] - at
    value[fresh] = -1
    return value[order]


def _last_below(values: np.ndarray, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each at, the last place before it whose value is below bound. values[0] is below every bound."""
    levels = [values]
    while len(levels[-1]) > 1:
        x = levels[-1]
        if len(x) & 1:
            levels[-1] = x = np.append(x, np.iinfo(np.int64).max)
        levels.append(np.minimum(x[::2], x[1::2]))
    out, pos = np.empty(len(at), dtype=np.int64), at.copy()
    live = np.arange(len(at))
    for j, level in enumerate(levels):
        if not len(live):
            break
        p = pos[live]
        hit = (p & 1).astype(bool)
        hit[hit] = level[p[hit] - 1] < bound[live[hit]]
        node, who = p[hit] - 1, live[hit]
        for lower in levels[j - 1 :: -1] if j else ():
            right = 2 * node + 1
            node = np.where(lower[right] < bound[who], right, right - 1)
        out[who] = node
        live = live[~hit]
        pos[live] >>= 1
    return out


def branching_squares(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares that can't move right, of periods that fit LEAST_TIMES into the text."""
    n = len(ids)
    order, rank = suffix_array(ids, doc, end)
    lcp = lcp_array(ids, doc, end, order, rank)
    k = np.flatnonzero((lcp > 0) & (LEAST_TIMES * lcp <= lengths[order]))
    depth = lcp[k]
    left = _last_below(lcp, k, depth)
    right = n - _last_below(np.append(lcp, -1)[::-1].copy(), n - k, depth + 1)
    small = k - left <= right - k
    lo, hi = np.where(small, left, k), np.where(small, k, right)  # the smaller part
    lo2, hi2 = np.where(small, k, left), np.where(small, right, k)
    size = hi - lo
    starts, periods = [], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + SLICE, SLICE))
    for x, y in zip(cuts, [*cuts[1:], len(k)], strict=True):
        if x >= y:
            continue
        s = size[x:y]
        of = np.repeat(np.arange(x, y), s)
        suffix = order[np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + lo[of]]
        for other, first in ((suffix + depth[of], suffix), (suffix - depth[of], suffix - depth[of])):
            inside = (other >= 0) & (other < n)
            place = rank[np.where(inside, other, 0)]
            hit = inside & (place >= lo2[of]) & (place < hi2[of])
            starts.append(first[hit])
            periods.append(depth[of[hit]])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *periods])


def find_runs(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (places in ids), lengths and periods of the runs of texts that lie one after another; sorted by start, then period."""
    doc = np.repeat(np.arange(len(counts)), counts)
    stop = np.cumsum(counts)
    end, begin, lengths = stop[doc], (stop - counts)[doc], counts[doc]
    start, period = branching_squares(ids, doc, end, lengths)
    till = start + 2 * period
    by = np.lexsort((period, till))
    start, period, till = start[by], period[by], till[by]
    found = []
    while len(start):  # a round for each primitive period of squares that end together
        first = np.ones(len(start), dtype=bool)
        first[1:] = till[1:] != till[:-1]
        s, q, e = start[first], period[first], till[first]
        length = e - s + _common(ids, s - 1, s - 1 + q, s - begin[s], -1)
        found.append((e - length, length, q))
        of = np.cumsum(first) - 1
        rest = ~first & ((period % q[of] != 0) | (2 * period > length[of]))
        start, period, till = start[rest], period[rest], till[rest]
    start, length, period = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
    keep = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _may_repeat(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts in which five words occur twice: the shortest run, of six equal words, has such."""
    n = LEAST_WORDS - 1
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(doc) < n:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    with np.errstate(over="ignore"):
        grams = textkit.sequence_hashes(hashes, at, n) + textkit.mix(doc[at].astype(np.uint64) + np.uint64(1))
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return np.unique(doc[at[np.isin(grams, twice)]])


def _chunk(data: np.ndarray, offsets: np.ndarray, doc_ids: list, order: Order | None) -> tuple[list, list, np.ndarray, np.ndarray, list[bytes]]:
    words = textkit.scan(data, offsets, textkit.PLAIN)
    hashes, counts = words.hashes(), words.counts
    orders = [order(d, n) if order and n else None for d, n in zip(doc_ids, counts.tolist(), strict=True)]
    if any(x is not None for x in orders):
        source = np.concatenate([first + (np.arange(n) if o is None else o) for first, n, o in zip(words.first.tolist(), counts.tolist(), orders, strict=True)])
        hashes = hashes[source]
    some = _may_repeat(hashes, counts)
    chosen = np.isin(words.doc, some)
    _, ids = np.unique(hashes[chosen], return_inverse=True)
    start, length, period = find_runs(ids, counts[some])
    base = np.cumsum(counts[some]) - counts[some]
    at = np.searchsorted(base, start, side="right") - 1
    start, doc = start - base[at], some[at]
    number = np.bincount(doc, minlength=len(counts))
    first = np.cumsum(number) - number
    collapsed = []
    for i, (n, o) in enumerate(zip(number.tolist(), orders, strict=True)):
        text = words.text(i).split()
        if o is not None:
            text = [text[j] for j in o.tolist()]
        if n:
            gone = np.zeros(len(text) + 1, dtype=np.int64)
            mine = slice(first[i], first[i] + n)
            np.add.at(gone, start[mine] + period[mine], 1)
            np.add.at(gone, start[mine] + length[mine], -1)
            text = [text[j] for j in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
        collapsed.append(b" ".join(text))
    return counts, number, np.stack([start, length, period]), first, collapsed


def runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, runs (by start, then period; word numbers from 0) and the collapsed text, the
    words that no run holds after its first period, joined by one space (binary). order(doc_id, number of words) may give the numbers
    of the words to read instead, as many as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textkit.chunks(batch, "text"):
                counts, number, found, _, collapsed = _chunk(data, offsets, batch.column(0)[lo:hi].to_pylist(), order)
                fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32()), fields)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    return lake.map_arrow(lake.text_bytes(docs, "doc_id"), run, RUNS)


def tenth_repeats(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's word order: every tenth text, by a hash of its id (null: none), repeats a stretch of itself from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs(lake.table(spark, sf_dir, "documents"), tenth_repeats)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    length, start, period = F.col("best.n"), -F.col("best.s"), -F.col("best.p")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
