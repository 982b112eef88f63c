"""Near-duplicate join on word shingles by parity sketches.

Documents with equal shingle sets form a class; only classes are compared. For sets with a Jaccard similarity of at least
80 % the symmetric difference is at most a ninth of the sum of the sizes, so at most a quarter of either size.

* Size bands grow by a factor of 1.25, so partners lie in the same or in neighbouring bands. A band's sketch is a parity
  vector cut in blocks: every shingle belongs to one block and is XORed into it. A shingle of the symmetric difference
  changes one block, so the number of differing blocks (the Hamming distance over blocks) is a lower bound of the
  difference, and with more blocks than the band's largest allowed difference two partners agree in one block that
  isn't empty (pigeonhole). Sets too clustered for that also emit their empty blocks, which only sets of their kind share.
* Partners agree in all their filled blocks but a quarter of their size. So a class keeps only that many and one of its blocks,
  the rarest of the corpus (blocks that no other class has count first): the most frequent blocks, those of passages and lines
  that many documents share, go, and with them nearly all classes that have no partner.
* The sorted 64-bit shingle hashes of the classes left, and bit-parity sketches of them, are written once, by one pass over their
  texts. A first round compares each class with the most connected class of its blocks, which links groups of near copies without
  their pairs. Blocks whose classes are linked already are left out. In each of the others the classes outside the block's largest
  group are compared with all its classes, in pieces of bounded size, by sketch (Hamming distance lower-bounds the difference);
  the closest pairs that would join its groups are passed on, not all. Blocks with pairs left beyond those are compared again
  with 32 times as many, until none is left that isn't joined.
* Every pair passed on is verified on the whole sets.

Null texts and texts without words have empty sets: no links, a component of their own. Texts of fewer words than a
shingle are one shingle. In the result of `near_duplicates` rows that repeat a doc_id belong to one component, and the component
of rows that have no id, nor a partner with one, is null. `deduplicated` goes by similarity only and leaves one row of each
group, and every row without words. An empty table gives an empty result. Columns other than the id and the text are
carried through by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graph, lake, textkit

WORDS = 5
PERCENT = 80
#: Classes, and shingles, of a block that are compared at once; a larger block is compared in pieces.
PIECE, PIECE_SHINGLES = 2048, 1 << 20
#: (block, class) pairs that a task gathers before it looks for shared blocks.
GATHER = 500_000
#: Rows of a few numbers that may be broadcast, once counted; beyond, they are joined by shuffle.
BROADCAST_ROWS = 250_000
#: Pairs, or classes, that a task holds so as not to pass them on twice.
REMEMBER = 200_000
_LARGEST = 1 << 40


def _bands() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest size, largest difference of partners, and number of blocks of each band."""
    lo = [1]
    while lo[-1] < _LARGEST:
        lo.append(lo[-1] * 5 // 4 + 1)
    low = np.array(lo[:-1], dtype=np.int64)
    high = np.array(lo[1:], dtype=np.int64) - 1
    most = (high + high * 5 // 4) // 9
    return low, high, most, -(-high * 29 // 100) + 2


LOW, HIGH, MOST, BLOCKS = _bands()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles in order of text, and the sizes of the sets."""
    words = textkit.scan(data, offsets, textkit.LOWER)
    hashes = words.hashes()
    starts = words.runs(k)
    h, doc = textkit.sequence_hashes(hashes, starts, k), words.doc[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        h = np.concatenate((h, textkit.sequence_hashes(hashes, words.first[short], words.counts[short])))
        doc = np.concatenate((doc, short))
    key = textkit.mix(h ^ textkit.mix(doc.astype(np.uint64) + np.uint64(1)))
    at = np.sort(np.unique(key, return_index=True)[1])
    if len(short):
        at = at[np.argsort(doc[at], kind="stable")]
    return doc[at], h[at], np.bincount(doc[at], minlength=len(offsets) - 1)


def _sums(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free fingerprints of each set, of 63 and 64 bits (the first is even)."""
    with np.errstate(over="ignore"):
        total = np.zeros((2, len(h) + 1), dtype=np.uint64)
        np.cumsum(textkit.mix(h), out=total[0, 1:])
        np.cumsum(textkit.mix(h + np.uint64(0x51ED27)), out=total[1, 1:])
        ends = np.cumsum(sizes)
        sums = total[:, ends] - total[:, ends - sizes]
    return textkit.mix(sums[0] + sizes.astype(np.uint64)) & ~np.uint64(1), textkit.mix(sums[1])


def _placed(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, lower: bool) -> tuple[np.ndarray, ...]:
    """The sets that have blocks in their own band or (lower) in the band below if partners may lie there: their band, number of
    blocks and first block, the block of each hash of theirs, and which hashes these are."""
    band = np.searchsorted(LOW, np.maximum(sizes, 1), side="right") - 1
    use = sizes >= 4  # of smaller sets no two that differ are similar
    if lower:
        band = band - 1
        use &= (band >= 0) & (-(-sizes * 4 // 5) <= HIGH[band])
    blocks = np.where(use, BLOCKS[band], 0)
    base = np.concatenate(([0], np.cumsum(blocks)))
    mine = use[doc]
    doc, h = doc[mine], h[mine]
    at = base[doc] + ((h >> np.uint64(20)) % blocks[doc].astype(np.uint64)).astype(np.int64)
    return band, blocks, base, at, mine


def _spare(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, lower: bool) -> np.ndarray:
    """How many of its most frequent blocks each set can do without: partners agree in all filled ones but a quarter of its size."""
    band, blocks, base, at, _ = _placed(doc, h, sizes, lower)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    full = np.bincount(owner[np.bincount(at, minlength=base[-1]) > 0], minlength=len(sizes))
    return np.where(full > MOST[band], np.maximum(full - sizes // 4 - 1, 0), 0)


def nodes(docs: DataFrame, *carry: str) -> DataFrame:
    """Rows (carried columns, n_shingles, fp, fp2, spare, spare_low) of all documents."""
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in textkit.chunks(batch, "text"):
                doc, h, sizes = shingle_sets(data, offsets)
                fp, fp2 = _sums(h, sizes)
                spare = [_spare(doc, h, sizes, lower) for lower in (False, True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, end - row) for i in range(k)), *(pa.array(x.view(np.int64)) for x in (sizes.astype(np.int64), fp, fp2)), *(pa.array(x.astype(np.int64)) for x in spare)],
                    names=[*carry, "n_shingles", "fp", "fp2", "spare", "spare_low"],
                )

    df = lake.text_bytes(docs, *carry)
    return lake.map_arrow(df, run, lake.schema(df, list(carry), "n_shingles long, fp long, fp2 long, spare long, spare_low long"))


def _block_keys(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of the blocks of each set, in its own band or (lower) in the band below if partners may lie there."""
    band, blocks, base, at, mine = _placed(doc, h, sizes, lower)
    value = np.zeros(base[-1], dtype=np.uint64)
    np.bitwise_xor.at(value, at, h[mine])
    filled = np.bincount(at, minlength=base[-1]) > 0
    owner = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(base[-1]) - base[owner]
    place = textkit.mix((band[owner] << 34).astype(np.uint64) + number.astype(np.uint64))
    full = np.bincount(owner[filled], minlength=len(sizes))
    clustered = full <= MOST[band]
    keys = textkit.mix(np.where(filled, value ^ place, place + np.uint64(1)))
    keep = filled | clustered[owner]
    return keys[keep], owner[keep]


def shared_blocks(docs: DataFrame) -> DataFrame:
    """Rows (key, tag): block keys that sets with different fingerprints share. tag: the fingerprint, odd for the band below the
    set's own. A row may come more than once."""
    buckets = lake.parts(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in textkit.chunks(batch, "text"):
                doc, h, sizes = shingle_sets(data, offsets)
                fp = _sums(h, sizes)[0]
                once = np.zeros(len(sizes), dtype=bool)
                once[np.unique(fp, return_index=True)[1]] = True
                sizes = np.where(once, sizes, 0)
                (k, o), (k2, o2) = (_block_keys(doc, h, sizes, lower) for lower in (False, True))
                keys, owner = np.concatenate((k, k2)), np.concatenate((o * 2, o2 * 2 + 1))
                bucket = (keys % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, keys, owner = bucket[order], keys[order], owner[order].astype("<u4")
                if not len(bucket):
                    continue
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cut[1:], len(bucket))
                table = fp.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut]), pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                     pa.array([owner[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([table] * len(cut), pa.binary())],
                    names=["bucket", "keys", "owners", "fps"],
                )

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], names=["key", "tag"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, fps = keys[order], fps[order]
            same = keys[1:] == keys[:-1]
            many = np.concatenate((same, [False])) | np.concatenate(([False], same))
            k, f = keys[many], fps[many]
            order = np.lexsort((f, k))
            k, f = k[order], f[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
            k, f = k[new], f[new]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(first, len(k)))
            of = np.repeat(n, n)
            if last:
                if (of > 1).any():
                    yield out(k[of > 1], f[of > 1])
                held, size = [], 0
                return
            # A block of many classes is passed on now; two of its classes stay to meet those still to come.
            rank = np.arange(len(k)) - np.repeat(first, n)
            large = of > PIECE
            if large.any():
                yield out(k[large], f[large])
            stay = ~large | (rank < 2)
            held = [(np.concatenate((keys[~many], k[stay])), np.concatenate((fps[~many], f[stay])))]
            size = len(held[0][0])

        settled, current = 0, None
        for batch in batches:
            for bucket, keys, owners, fps in zip(*batch.columns, strict=True):
                if bucket.as_py() != current and held:  # a key is in one bucket
                    yield from settle(True)
                    settled = 0
                current = bucket.as_py()
                k = np.frombuffer(keys.as_buffer(), dtype=np.uint64)
                owner = np.frombuffer(owners.as_buffer(), dtype="<u4")
                held.append((k, np.frombuffer(fps.as_buffer(), dtype=np.uint64)[owner >> 1] | (owner & 1)))
                size += len(k)
                if size > settled + GATHER:
                    yield from settle(False)
                    settled = size
        if held:
            yield from settle(True)

    blobs = lake.map_arrow(lake.text_bytes(docs), emit, "bucket int, keys binary, owners binary, fps binary")
    return lake.map_arrow(blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket"), gather, "key long, tag long")


def _members(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, node): the blocks that a class has to be looked up by."""
    rows = blocks.distinct().select("key", F.col("tag").bitwiseAND(F.lit(-2)).alias("fp"), F.col("tag").bitwiseAND(F.lit(1)).alias("low"))
    known = classes.select("fp", "node", "spare", "spare_low")
    rows = lake.written(rows.join(known.hint("merge"), "fp").select("key", "node", "low", F.when(F.col("low") == 0, F.col("spare")).otherwise(F.col("spare_low")).alias("spare")), "rows")
    # A pair is looked up in the own band of one of the two.
    often = rows.groupBy("key").agg(F.count("*").alias("often"), F.min("low").alias("least")).where("often > 1 and least = 0").drop("least")
    rank = F.row_number().over(Window.partitionBy("node", "low").orderBy(F.desc("often"), "key"))
    return rows.join(often.hint("merge"), "key").withColumn("rank", rank).where("rank > spare").select("key", "node")


def _mixed(rooted: DataFrame) -> DataFrame:
    """The rows (key, node, root) of blocks that hold more than one root."""
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return rooted.join(mixed.hint("merge"), "key", "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, shingles: sorted 64-bit hashes, sketch) of the classes wanted (node, rep: a document's id and the hash of its text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for row, end, data, offsets in textkit.chunks(batch, "text"):
                node = batch.column(0).slice(row, end - row).to_pylist()
                new = [i for i, x in enumerate(node) if x not in seen and not seen.add(x)]
                if len(seen) > REMEMBER:
                    seen = set()
                if not new:
                    continue
                _, h, sizes = shingle_sets(data, offsets)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in new], pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*[(np.sort(h[a:b]).tobytes(), _parity(h[a:b])) for a, b in ((ends[i] - sizes[i], ends[i]) for i in new)], strict=True))], names=["node", "shingles", "sketch"])

    names = wanted.select("node", F.col("rep.doc_id").alias("id"), F.col("rep.hash").alias("of"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text")).where("text is not null")
    picked = texts.join(names.hint(_small(names)), F.col("hash").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return lake.map_arrow(picked.select("node", "text"), run, "node long, shingles binary, sketch binary").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))


def _small(df: DataFrame) -> str:
    """The join hint for a table that has been written: broadcast if its rows, now counted, are few."""
    return "broadcast" if df.count() <= BROADCAST_ROWS else "merge"


def _leader_pairs(rooted: DataFrame) -> DataFrame:
    """Rows (a, b, ra, rb): each node with a most connected node of another root with which it shares blocks, and their roots."""
    degree = rooted.groupBy("node").agg(F.count("*").alias("degree"))
    leaders = rooted.join(degree.hint("merge"), "node").groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("degree", "node")).alias("to"))
    shared = rooted.join(leaders.hint("merge"), "key").where("root <> to.root").groupBy("node", "root", "to").agg(F.count("*").alias("n"))
    best = shared.groupBy("node").agg(F.max_by(F.struct("root", "to"), F.struct("n", "to")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.to.node").alias("b"), F.col("best.root").alias("ra"), F.col("best.to.root").alias("rb"))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    joint = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * joint >= PERCENT * (len(x) + len(y) - joint)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the roots of pairs that are similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lake.map_arrow(both.select("ra", "rb", "sa", "sb"), run, "a long, b long").distinct()


def _units(rooted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (key, i, j, node, root, n_shingles, others, all): pieces of the blocks to compare. The classes outside a block's largest root (others)
    meet all its classes once; a unit has at most about PIECE rows and PIECE_SHINGLES shingles of either kind."""
    # Blocks with the same classes give the same pairs, so one of them will do.
    alike = rooted.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    rooted = rooted.join(alike.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key").hint("merge"), "key", "left_semi").join(sizes.hint("merge"), "node")
    by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    blocks = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "root", "w")).alias("most"))
    pieces = lambda n, w: F.ceil(F.greatest(n / PIECE, w / PIECE_SHINGLES)).cast("int")
    blocks = blocks.select("key", F.col("most.root").alias("largest"), pieces(F.col("n"), F.col("w")).alias("of_all"), pieces(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("of_others"))
    df = rooted.join(blocks.hint("merge"), "key").withColumn("others", F.col("root") != F.col("largest"))
    i, j = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(c)).cast("int") for k, c in ((2, "of_others"), (3, "of_all")))
    unit = lambda i, j, others, every: F.struct(i.alias("i"), j.alias("j"), others.alias("others"), every.alias("all"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    span = lambda c: F.sequence(zero, F.col(c) - 1)
    many = F.concat(F.transform(span("of_others"), lambda x: unit(x, j, no, yes)), F.when(F.col("others"), F.transform(span("of_all"), lambda x: unit(i, x, yes, no))).otherwise(F.array().cast("array<struct<i:int,j:int,others:boolean,all:boolean>>")))
    df = df.withColumn("unit", F.explode(F.when(F.col("of_all") * F.col("of_others") == 1, F.array(unit(zero, zero, F.col("others"), yes))).otherwise(many)))
    return df.select("key", "unit.i", "unit.j", "node", "root", "n_shingles", "unit.others", "unit.all")


def _forest_pairs(rooted: DataFrame, classes: DataFrame, sets: DataFrame, layers: int) -> tuple[DataFrame, DataFrame]:
    """Rows (a, b, ra, rb) of pairs to verify with their roots, and the blocks (key) where that may not have been all: in each unit
    the closest pairs that join its roots, so many times over (layers)."""
    units = _units(rooted, classes.select("node", "n_shingles")).join(sets.select("node", "sketch").hint("merge"), "node")
    units = units.repartition(lake.parts(rooted.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, found = None, [], set()
        for batch in batches:
            left = []
            key, i, j, node, root, n, others, every = (batch.column(c).to_pylist() for c in range(8))
            for k, sketch in enumerate(batch.column(8)):
                if unit != (key[k], i[k], j[k]):
                    if _forest(rows, layers, found):
                        left.append(unit[0])
                    unit, rows = (key[k], i[k], j[k]), []
                rows.append((node[k], root[k], n[k], others[k], every[k], sketch.as_py()))
            yield _found(set(), left)
            if len(found) > REMEMBER:
                yield _found(found, [])
                found = set()
        yield _found(found, [unit[0]] if _forest(rows, layers, found) else [])

    out = units.select("key", "i", "j", "node", "root", "n_shingles", "others", "all", "sketch")
    out = lake.written(lake.map_arrow(out, run, "key long, a long, b long, ra long, rb long"), "forest")
    return out.where("a is not null").select("a", "b", "ra", "rb").distinct(), out.where("a is null").select("key").distinct()


def _found(found: set[tuple[int, int, int, int]], left: list[int]) -> pa.RecordBatch:
    """Rows (null, a, b, ra, rb) of pairs, and (key, null...) of blocks with pairs left."""
    none = [None] * len(left)
    return pa.RecordBatch.from_arrays([pa.array([None] * len(found) + left, pa.int64()), *(pa.array([x[c] for x in found] + none, pa.int64()) for c in range(4))], names=["key", "a", "b", "ra", "rb"])


def _forest(rows: list[tuple], layers: int, found: set[tuple[int, int, int, int]]) -> bool:
    """Adds to found the pairs of a unit's rows (node, root, n, others, all, sketch) that join its roots, closest first; each further
    layer joins them again by pairs that those before didn't use. True if pairs are left."""
    if len(rows) < 2:
        return False
    left = list(_close_pairs(rows))
    for _ in range(layers):
        up: dict[int, int] = {}

        def top(k: int, up=up) -> int:
            while (v := up.get(k, k)) != k:
                up[k] = up.get(v, v)
                k = v
            return k

        unused = []
        for x, y in left:
            r, t = top(rows[x][1]), top(rows[y][1])
            if r == t:
                unused.append((x, y))
            else:
                up[r] = t
                a, b = (rows[x], rows[y]) if rows[x][0] > rows[y][0] else (rows[y], rows[x])
                found.add((a[0], b[0], a[1], b[1]))
        left = unused
        if not left:
            return False
    return True


def _close_pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Pairs of a unit's rows, one of others and one of all, of different roots, whose sizes and sketches allow a link; closest first."""
    width = min(len(r[5]) for r in rows)
    n, root = (np.array([r[k] for r in rows]) for k in (2, 1))
    left, right = (np.flatnonzero(np.array([r[k] for r in rows])) for k in (3, 4))
    bits = np.stack([_folded(r[5], width) for r in rows])
    found = []
    step = max(1, (1 << 19) // max(1, len(right) * bits.shape[1]))
    for lo in range(0, len(left), step):
        some = left[lo : lo + step]
        d = np.bitwise_count(bits[some, None, :] ^ bits[None, right, :]).sum(axis=2, dtype=np.int32)
        a, b = n[some, None], n[None, right]
        x, y = np.nonzero((9 * d <= a + b) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (root[some, None] != root[None, right]))
        found.append((d[x, y] / (n[some[x]] + n[right[y]]), some[x], right[y]))
    close, x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
    order = np.argsort(close, kind="stable")
    yield from zip(x[order].tolist(), y[order].tolist(), strict=True)


def _parity(h: np.ndarray) -> bytes:
    """Bit-parity sketch: each hash flips one of 2**i bits, of which there are eight or more a shingle. Halves can be XORed together."""
    width = 1 << max(6, int(len(h) * 8 - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1).tobytes()


def _folded(sketch: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(sketch, dtype=np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _moved(rows: DataFrame, moved: DataFrame, how: str) -> DataFrame:
    """rows with their root replaced by that of moved (node, root) where it has one."""
    new = moved.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return rows.join(new.hint(how), "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")


def _components(docs: DataFrame, every: DataFrame) -> DataFrame:
    """Rows (fp, fp2, n_shingles, group) of the distinct sets of every, the written nodes of docs (doc_id, hash, ...)."""
    classes = every.where("n_shingles > 0").groupBy("fp", "fp2", "n_shingles").agg(F.min("spare").alias("spare"), F.min("spare_low").alias("spare_low"), F.min(F.struct("doc_id", "hash")).alias("rep"))
    classes = lake.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = lake.written(_members(lake.written(shared_blocks(docs), "blocks"), classes), "members")
    rooted = lake.written(_mixed(members.withColumn("root", F.col("node"))), "rooted")
    roots = None
    if not rooted.isEmpty():
        wanted = lake.written(classes.select("node", "rep").join(rooted.select("node").distinct().hint("merge"), "node", "left_semi"), "wanted")
        sets = lake.written(_sets(docs, wanted), "sets")
    layers = 0
    while not rooted.isEmpty():
        if not layers:
            pairs, layers = _leader_pairs(rooted), 8
        else:
            pairs, left = _forest_pairs(rooted, classes, sets, layers)
            rooted, layers = lake.written(rooted.join(left.hint("merge"), "key", "left_semi"), "left"), layers * 32
        links = lake.written(_verified(lake.written(pairs, "pairs"), sets), "links")
        if links.isEmpty():
            continue
        moved = lake.written(graph.components(links), "moved")
        how = _small(moved)
        roots = lake.written(moved if roots is None else _moved(roots, moved, how).unionByName(moved).distinct(), "roots")
        rooted = lake.written(_mixed(_moved(rooted, moved, how)), "rooted")
    groups = classes.select("fp", "fp2", "n_shingles", "node", F.col("node").alias("root"))
    if roots is not None:
        groups = groups.drop("root").join(roots.hint(_small(roots)), "node", "left")
    return groups.select("fp", "fp2", "n_shingles", F.coalesce("root", "node").alias("group"))


def _grouped(docs: DataFrame, every: DataFrame) -> DataFrame:
    """every with the group of each row; null for rows without words."""
    groups = _components(docs, every)
    return lake.written(every.drop("spare", "spare_low").join(groups.hint("merge"), ["fp", "fp2", "n_shingles"], "left"), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = _grouped(docs, lake.written(nodes(docs.withColumn("hash", F.xxhash64("text")), "doc_id", "hash"), "nodes"))
    named = rows.where("doc_id is not null and group is not null").select("doc_id", "group")
    # Groups that share an id are one component; its smallest doc_id names it.
    many = named.groupBy("doc_id").agg(F.min("group").alias("b"), F.max("group").alias("most")).where("b <> most").select("doc_id", "b")
    links = lake.written(named.join(many.hint("merge"), "doc_id").where("group <> b").select(F.col("group").alias("a"), "b").distinct(), "links")
    groups = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    if not links.isEmpty():
        roots = lake.written(graph.components(links), "roots")
        rooted = groups.join(roots.withColumnRenamed("node", "group").hint("merge"), "group", "left").withColumn("root", F.coalesce("root", "group"))
        least = rooted.groupBy("root").agg(F.min("component_id").alias("component_id"))
        groups = rooted.select("group", "root").join(least.hint("merge"), "root").drop("root")
    joined = rows.join(groups.hint("merge"), "group", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """docs with one row of each group of similar texts: that with the smallest doc_id (none is last), then hash of the text.
    Rows that share an id but no similar text all stay, and so do rows without words. row_id: a long that stays with each
    row however often docs is read (lake.row_id); without one a numbered copy of docs is written."""
    numbered = lake.packed(docs, row_id.alias("number")) if row_id is not None else lake.written(lake.packed(docs, F.monotonically_increasing_id().alias("number")), "numbered")
    texts = numbered.select("number", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    rows = _grouped(texts, lake.written(nodes(texts.withColumn("hash", F.xxhash64("text")), "number", "doc_id", "hash"), "nodes"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "number")).alias("least")
    first = rows.where("group is not null").groupBy("group").agg(least).select("least.number")
    # Rows that go are few beside those that stay.
    gone = lake.written(rows.where("group is not null").select("number", "doc_id", "hash").join(first.hint("merge"), "number", "left_anti"), "gone")
    same = (F.col("n.number") == F.col("g.number")) & F.col("n.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("n.row.text") == F.col("g.hash"))
    out = numbered.alias("n").join(gone.alias("g").hint(_small(gone)), same, "left_anti")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(lake.table(spark, sf_dir, "documents"))
