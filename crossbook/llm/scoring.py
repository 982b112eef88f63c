"""Language-model scores of documents by sharded Elias-Fano trigram tries.

The model is interpolated Witten-Bell of order three over all training n-grams, none left out:

    p(w | u v) = (c(uvw) + t(uv) p(w | v)) / (c(uv) + t(uv)),   p(w | v) = (c(vw) + t(v) p(w)) / (c(v) + t(v)),

with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and t(x) the number of different words that follow x in training; a context that
never occurs passes on the shorter one's probability. A text begins after two markers and ends with the end token.

1. Texts are read once, in chunks of bounded bytes, and the chunks are written encoded. The distinct words of every chunk, with their
   training counts, go to the word's bucket, which adds them up and gives every word a number, small for frequent words, and returns
   numbers and counts to the chunks. How Spark cuts the files can't matter later, as nothing reads the texts again.
2. Written chunks meet their words' numbers, and send their (u, v, w, text, count) to the shard of v, packed: one shuffle of
   a few bytes a token. A shard holds whole contexts v. A word v with more than HEAVY occurrences is dealt to several shards by
   the hash of u, so a frequent word doesn't gather in one task, and what one text repeats is counted before it is sent.
3. Shards that hold part of a frequent word send their different pairs (v, w), counted, to buckets of pairs, which add them up and
   return c(vw) and their share of t(v). They read the shuffle of step 2, which is not made again. So where words are cut is of no
   effect on the model.
4. A shard makes two tries from its training n-grams: words, words v and words after them; words v, words u before them
   and words after both. Their levels (monotone pointers, quantised log probabilities and back-off weights) are written,
   memory-mapped, and asked for all n-grams of the shard by successor search. Each text's parts are then added up.

What is gathered grows with the corpus: there is no table of all words or contexts, and no n-gram is cut. Null and empty texts are
one end token. Rows are scored separately, also where they repeat a doc_id; a null doc_id counts as the empty string when documents are
held out. Without training documents every word is unknown. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import eliasfano, lake, textkit

FOLDS, HELD_OUT = 5, 1
#: Tokens of a shard, and occurrences of a word that go to one shard at most.
SHARD_TOKENS = 1_000_000
HEAVY = 250_000
CHUNK_BYTES = (4 << 20) - 16
#: Bytes of a row group of written chunks: a reader holds one.
GROUP_BYTES = 8 << 20
#: Stands for the hash of the end token; the number of the marker before a text.
END = np.uint64(1)
BEGIN = 0


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a chunk (an end token after each text), the text of each, and tokens a text."""
    words = textkit.scan(data, offsets, textkit.LOWER)
    n = words.counts + 1
    tokens = np.full(int(n.sum()), END, dtype=np.uint64)
    tokens[np.arange(len(words.doc)) + words.doc] = words.hashes()
    return tokens, np.repeat(np.arange(len(n)), n), n


def _training(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str(i if i is not None else "").encode()) % FOLDS != HELD_OUT for i in ids], dtype=bool)


def _cuts(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    return at, np.append(at[1:], len(shard))[: len(at)]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as byte planes of their least width, compressed."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x, dtype="<u8")
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        out += [struct.pack("<IB", len(x), width), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, width = struct.unpack_from("<IB", data, at)
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at + 5).reshape(width, n).T
        out.append(wide.reshape(-1).view("<i8"))
        at += 5 + n * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences to the number before, as whole numbers from 0 (even: up, odd: down)."""
    d = np.diff(x, prepend=0)
    return d << 1 ^ d >> 63


def _walked(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps >> 1 ^ -(steps & 1))


def _within(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Differences of numbers that ascend within equal keys; the first of a key is whole."""
    d, new = np.diff(x, prepend=0), np.diff(key, prepend=-1) != 0
    d[new] = x[new]
    return d


def _whole(d: np.ndarray, key: np.ndarray) -> np.ndarray:
    new, s = np.flatnonzero(np.diff(key, prepend=-1)), np.cumsum(d)
    return s - np.repeat(s[new] - d[new], np.diff(np.append(new, len(d))))


def encoded(docs: DataFrame, buckets: int) -> DataFrame:
    """Chunks of docs (doc_id, text): for each a row without bucket (ids; packed: its tokens as places of its words by falling frequency,
    tokens a text, those words' places by hash), and for each bucket a row of the chunk's words there, by hash, and their training counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, end, data, offsets in textkit.chunks(batch, "text", CHUNK_BYTES):
                ids = batch.column(0).slice(row, end - row).to_pylist()
                tokens, doc, n = _tokens(data, offsets)
                words, at, seen = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-seen, kind="stable")  # small numbers for frequent words: fewer bytes
                place = np.empty(len(words), dtype=np.int64)
                place[order] = np.arange(len(words))
                count = np.bincount(at[_training(ids)[doc]], minlength=len(words))
                bucket = ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)  # ascends with the word
                a, b = _cuts(bucket)
                none = [None] * len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | number] * (len(a) + 1), pa.int64()), pa.array([None, *bucket[a].tolist()], pa.int32()), pa.array([None, *(_pack(np.diff(words[x:y], prepend=np.uint64(0))) for x, y in zip(a, b, strict=True))], pa.binary()),
                     pa.array([None, *(_pack(count[x:y]) for x, y in zip(a, b, strict=True))], pa.binary()), pa.array([_pack(place[at], n, _steps(order)), *none], pa.binary()), pa.array([ids, *none], pa.list_(pa.int64()))],
                    names=["chunk", "bucket", "words", "counts", "packed", "ids"],
                )
                number += 1

    return lake.map_arrow(lake.text_bytes(docs, "doc_id"), emit, "chunk long, bucket int, words binary, counts binary, packed binary, ids array<long>")


def vocabulary(chunks: DataFrame, buckets: int) -> DataFrame:
    """Of written chunks, rows (chunk, bucket, packed: ranks within the bucket and training counts of the chunk's words there, in order of
    their hashes), and for each bucket one without chunk: how many words and tokens it has in training, and how many texts end there."""
    def number(key, group):
        bucket = key[0].as_py()
        words = [np.cumsum(_unpack(w.as_py())[0].view(np.uint64)) for w in group.column("words")]
        counts = [_unpack(n.as_py())[0] for n in group.column("counts")]
        vocab, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        rank = np.empty(len(vocab), dtype=np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(vocab))
        ends = np.cumsum([len(w) for w in words])
        packed = [_pack(rank[x], total[x]) for x in np.split(at, ends[:-1])]
        return pa.table(
            {"chunk": pa.array([*group.column("chunk").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (len(words) + 1), pa.int32()), "packed": pa.array([*packed, None], pa.binary()),
             "n_words": pa.array([None] * len(words) + [int((total > 0).sum())], pa.int64()), "n_tokens": pa.array([None] * len(words) + [int(total.sum())], pa.int64()), "n_ends": pa.array([None] * len(words) + [int(total[vocab == END].sum())], pa.int64())}
        )

    return chunks.where("bucket is not null").select("bucket", "chunk", "words", "counts").groupBy("bucket").applyInArrow(number, "chunk long, bucket int, packed binary, n_words long, n_tokens long, n_ends long")


def _parts(count: np.ndarray, before: np.ndarray, heavy: int) -> np.ndarray:
    """Which part of a word that occurs so often takes it after the word before. It only tells where an n-gram is counted."""
    k = np.maximum(1, -(-count // heavy)).astype(np.uint64)
    return (textkit.mix(before.astype(np.uint64)) % k).astype(np.int64)


def _by_pair(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of pairs by (v, w), where in it new ones begin, and the number of each pair in the order given."""
    order = np.lexsort((w, v))
    a, b = v[order], w[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    at = np.empty(len(v), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), at


class _Shard:
    """The n-grams of a shard's rows: v, u, w (positions in name), times, train; and what each row holds."""

    def __init__(self, group: pa.Table):
        self.blocks = [_unpack(x.as_py()) for x in group.column("packed")]
        own = [np.cumsum(b[0]) for b in self.blocks]
        self.name, first = np.unique(np.concatenate(own), return_index=True)
        self.count = np.concatenate([_walked(b[1]) for b in self.blocks])[first]
        grams = []
        for o, b in zip(own, self.blocks, strict=True):
            x = np.cumsum(b[2])
            y = _whole(b[3], x)
            grams.append([np.searchsorted(self.name, o)[i] for i in (x, y, _whole(b[4], x << 32 | y))])
        self.v, self.u, self.w = (np.concatenate(x) for x in zip(*grams, strict=True))
        self.times = np.concatenate([b[6] for b in self.blocks]) + 1
        self.train = np.concatenate([b[5] < n for b, n in zip(self.blocks, group.column("learn").to_numpy(), strict=True)])


def _pair_bucket(v: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    h = textkit.mix(textkit.mix(v.astype(np.uint64)) + w.astype(np.uint64))
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pair_totals(blocks: DataFrame, shards: int, heavy: int) -> DataFrame:
    """For shards of blocks that hold words of more than heavy occurrences, rows (shard, asked: words v; of different pairs v, w; totals: the
    pairs' training counts in all shards; for each asked word the different words after it in the row's bucket).

    A shard sends each bucket its pairs there, and all its frequent words, which are few: each fills a good part of a shard."""
    buckets = shards // 8 + 1

    def send(key, group):
        s = _Shard(group)
        often = np.flatnonzero(s.count[s.v] > heavy)
        v, w, k = s.v[often], s.w[often], len(s.name)
        pairs, at = np.unique(v * k + w, return_inverse=True)
        n = np.bincount(at, weights=(s.times * s.train)[often], minlength=len(pairs)).astype(np.int64)
        x, y = s.name[pairs // k], s.name[pairs % k]
        asked, bucket = np.unique(x), _pair_bucket(x, y, buckets)
        order = np.argsort(bucket, kind="stable")  # by pair within a bucket
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)] if len(asked) else []
        return pa.table({
            "shard": pa.array([key[0].as_py()] * len(rows), pa.int64()), "bucket": pa.array(range(len(rows)), pa.int32()),
            "asked": pa.array([_pack(np.diff(asked, prepend=0), np.diff(x[r], prepend=0), _within(y[r], x[r])) for r in rows], pa.binary()), "counts": pa.array([_pack(n[r]) for r in rows], pa.binary()),
        })

    def total(key, group):
        asked = [_unpack(x.as_py()) for x in group.column("asked")]
        v = [np.cumsum(a[1]) for a in asked]
        w = [_whole(a[2], x) for a, x in zip(asked, v, strict=True)]
        ends = np.cumsum([len(x) for x in v])[:-1]
        v, w = np.concatenate(v), np.concatenate(w)
        order, first, at = _by_pair(v, w)
        n = np.bincount(at, weights=np.concatenate([_unpack(x.as_py())[0] for x in group.column("counts")]), minlength=len(first)).astype(np.int64)
        words, kinds = np.unique(v[order[first]][n > 0], return_counts=True)
        words, kinds = np.append(words, np.iinfo(np.int64).max), np.append(kinds, 0)
        out = []
        for a, x in zip(asked, np.split(at, ends), strict=True):
            ask = np.cumsum(a[0])
            place = np.searchsorted(words, ask)
            out.append(_pack(n[x], np.where(words[place] == ask, kinds[place], 0)))
        return pa.table({"shard": group.column("shard"), "asked": group.column("asked"), "totals": pa.array(out, pa.binary())})

    sent = blocks.groupBy("shard").applyInArrow(send, "shard long, bucket int, asked binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(total, "shard long, asked binary, totals binary")


def _frequent(totals: pa.Table) -> tuple[np.ndarray, ...]:
    """Pairs v, w with their counts, and words with how many different ones follow them, of a shard's rows of pair_totals."""
    if not len(totals):
        return (np.zeros(0, dtype=np.int64),) * 5
    asked, found = ([_unpack(x.as_py()) for x in totals.column(c)] for c in ("asked", "totals"))
    v = [np.cumsum(a[1]) for a in asked]
    w = [_whole(a[2], x) for a, x in zip(asked, v, strict=True)]
    return np.concatenate(v), np.concatenate(w), np.concatenate([f[0] for f in found]), np.cumsum(asked[0][0]), np.sum([f[1] for f in found], axis=0)


class _Model:
    """The two tries of a shard, from its training n-grams."""

    def __init__(self, names: np.ndarray, count: np.ndarray, mass: float, v, u, w, n, frequent):
        """names, count: numbers of the training words (sorted) and how often each occurs; v, u, w: their positions; n: times seen.
        frequent: of words that other shards hold, too, pairs v, w (positions) and their counts, words and how many different ones follow."""
        alone, k = (count + 0.5) / mass, len(names)
        fv, fw, fn, words, kinds = frequent
        pairs, pair = np.unique(np.concatenate((v * k + w, fv * k + fw)), return_inverse=True)
        pair, given = pair[: len(v)], pair[len(v) :]
        contexts = np.union1d(pairs // k, words)  # a word may be followed by none of its pairs here
        of = np.searchsorted(contexts, pairs // k)
        longer, long_at, _ = self._unique(v * k + u)
        triples, triple, some = self._unique(long_at * k + w)
        c2, c3 = (np.bincount(x, weights=n, minlength=m) for x, m in ((pair, len(pairs)), (triple, len(triples))))
        c1, cl = count[contexts].astype(np.float64), np.bincount(long_at, weights=n, minlength=len(longer))
        t1, tl = np.bincount(of, minlength=len(contexts)), np.bincount(triples // k, minlength=len(longer))
        c2[given] = fn
        t1[np.searchsorted(contexts, words)] = kinds
        ofl = triples // k
        p2 = (c2 + t1[of] * alone[pairs % k]) / (c1 + t1)[of]
        p3 = (c3 + tl[ofl] * p2[pair[some]]) / (cl + tl)[ofl]
        words, level = eliasfano.EliasFano.of(names), eliasfano.Level.of
        codes = eliasfano.quantised(np.log10(alone))
        self.short = eliasfano.Trie(words, *codes, [level(k, contexts, np.zeros(len(contexts), dtype=np.int64), np.log10(t1 / (c1 + t1))), level(len(contexts), of, pairs % k, np.log10(p2))])
        self.long = eliasfano.Trie(words, *codes, [level(k, longer // k, longer % k, np.log10(tl / (cl + tl))), level(len(longer), ofl, triples % k, np.log10(p3))])
        self.unknown = np.log10(0.5 / mass)

    @staticmethod
    def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, first, at = np.unique(x, return_index=True, return_inverse=True)
        return values, at, first

    def mapped(self) -> _Model:
        """The same with tries that are memory-mapped files."""
        for name in ("short", "long"):
            fd, path = tempfile.mkstemp()
            os.close(fd)
            getattr(self, name).save(path)
            setattr(self, name, eliasfano.Trie.open(path))
            os.unlink(path)  # the mapping keeps it until the task is done with it
        return self

    def log10(self, names: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 p(w | u v) of n-grams given by positions in names, numbers of words. Each part of an n-gram is looked up once."""
        ids = self.short.word_ids(names.astype(np.uint64))
        p = np.full(len(names), self.unknown)
        p[ids >= 0] = self.short.word_value(ids[ids >= 0])
        p = p[w]
        for trie, next_ in ((self.short, np.zeros(len(v), dtype=np.int64)), (self.long, ids[u])):
            context, at, first = self._unique(v * (int(next_.max(initial=0)) + 2) + next_ + 1)
            found = trie.find([ids[v[first]], next_[first]])
            weight = np.zeros(len(context))
            weight[found >= 0] = trie.levels[0].value(found[found >= 0])
            p += weight[at]
            gram, back, first = self._unique(at * len(names) + w)
            full = trie.levels[1].find(found[at[first]], ids[w[first]])[back]
            p[full >= 0] = trie.levels[1].value(full[full >= 0])
        return p


def scores(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text)."""
    buckets = lake.parts(docs.sparkSession)
    chunks = lake.written(encoded(docs.select("doc_id", "text"), buckets), "chunks", **{"parquet.block.size": GROUP_BYTES})
    words = lake.written(vocabulary(chunks, buckets), "words")
    total, kinds, begins = words.where("chunk is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "n_ends"))).first()
    shards, heavy = max(1, -(-total * FOLDS // (FOLDS - 1) // SHARD_TOKENS)), HEAVY
    mass = total + 0.5 * (kinds + 1)

    def spread(key, left, right):
        bucket = right.column("bucket").to_numpy()
        order = np.argsort(bucket)
        ranks, counts = zip(*(_unpack(right.column("packed")[int(i)].as_py()) for i in order), strict=True)
        name, count = np.concatenate([r * buckets + b + 1 for r, b in zip(ranks, bucket[order].astype(np.int64), strict=True)]), np.concatenate(counts)
        at, n, by_hash = _unpack(left.column("packed")[0].as_py())
        local = _walked(by_hash)[at]
        ids = left.column("ids")[0].as_py()
        train = _training(ids)
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, weights=np.log10(count + 0.5)[local], minlength=len(n))
        known = np.bincount(doc, weights=(count > 0)[local], minlength=len(n))
        # Positions ascend with the words' numbers, 0 is the marker before a text; texts are numbered with those of training first.
        order = np.argsort(name)
        spot = np.empty(len(name), dtype=np.int64)
        spot[order] = np.arange(1, len(name) + 1)
        name, count = np.concatenate(([BEGIN], name[order])), np.concatenate(([begins], count[order]))
        place = np.empty(len(n), dtype=np.int64)
        place[np.argsort(~train, kind="stable")] = np.arange(len(n))
        doc, first = place[doc], np.cumsum(n) - n
        w = spot[local]
        v = np.concatenate(([0], w[:-1]))
        v[first] = 0
        u = np.concatenate(([0], v[:-1]))
        u[first] = 0
        part = _parts(count[v], name[u], heavy)
        route = textkit.mix(textkit.mix(name[v].astype(np.uint64)) + part.astype(np.uint64))
        shard = ((route >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((doc, w, v << 32 | u, shard))
        shard, v, u, w, doc = (x[order] for x in (shard, v, u, w, doc))
        new = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]))))
        times = np.diff(np.append(new, len(v)))
        shard, v, u, w, doc = (x[new] for x in (shard, v, u, w, doc))
        packed, a_b, back = [], list(zip(*_cuts(shard), strict=True)), np.zeros(len(name), dtype=np.int64)
        for a, b in a_b:
            own = np.unique(np.concatenate((v[a:b], u[a:b], w[a:b])))
            back[own] = np.arange(len(own))
            x, y, z = back[v[a:b]], back[u[a:b]], back[w[a:b]]
            packed.append(_pack(np.diff(name[own], prepend=0), _steps(count[own]), np.diff(x, prepend=0), _within(y, x), _within(z, x << 32 | y), doc[a:b], times[a:b] - 1))
        k = len(packed)
        lead = key[0].as_py() % k  # the row that carries the documents
        put = lambda x, kind: pa.array([x if i == lead else None for i in range(k)], kind)
        return pa.table(
            {"shard": pa.array([int(shard[a]) for a, _ in a_b], pa.int64()), "chunk": pa.array([key[0].as_py()] * k, pa.int64()), "learn": pa.array([int(train.sum())] * k, pa.int32()), "packed": pa.array(packed, pa.binary()),
             "ids": put(ids, pa.list_(pa.int64())), "figures": put(_pack(n, known.astype(np.int64)), pa.binary()), "base": put(base.tobytes(), pa.binary())}
        )

    def score(key, group, totals):
        s = _Shard(group)
        name, v, u, w, times, train = s.name, s.v, s.u, s.w, s.times, s.train
        known = np.flatnonzero(s.count > 0)
        names, at = name[known], np.cumsum(s.count > 0) - 1
        fv, fw, fn, words, kinds = _frequent(totals)
        seen = fn > 0  # pairs that are only asked for aren't in the model
        frequent = (np.searchsorted(names, fv[seen]), np.searchsorted(names, fw[seen]), fn[seen], np.searchsorted(names, words[kinds > 0]), kinds[kinds > 0])
        model = _Model(names, s.count[known], mass, at[v[train]], at[u[train]], at[w[train]], times[train], frequent).mapped()
        # Each n-gram is asked for once.
        longer, pair = np.unique(v * len(name) + u, return_inverse=True)
        grams, gram, some = _Model._unique(pair * len(name) + w)
        p = model.log10(name, v[some], u[some], w[some])[gram] * times
        docs, sums, x = [], [], 0
        for b in s.blocks:
            d, at = np.unique(b[5], return_inverse=True)
            docs.append(_pack(d))
            sums.append(np.bincount(at, weights=p[x : x + len(at)]).astype("<f4").tobytes())
            x += len(at)
        return pa.table({"chunk": group.column("chunk"), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary()), **{c: group.column(c) for c in ("ids", "figures", "base")}})

    def add(key, group):
        ids, figures, base = (next(x for x in group.column(c) if x.is_valid) for c in ("ids", "figures", "base"))
        ids, (n, known), base = ids.as_py(), _unpack(figures.as_py()), np.frombuffer(base.as_buffer(), dtype=np.float64)
        train, p = _training(ids), np.zeros(len(n))
        for d, s in zip(group.column("docs"), group.column("sums"), strict=True):
            p[_unpack(d.as_py())[0]] += np.frombuffer(s.as_buffer(), dtype="<f4")
        score = np.empty(len(n))
        score[np.argsort(~train, kind="stable")] = p
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": ~train, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), total, dtype=np.int64), "base_score": base - n * np.log10(mass), "score": score})

    tokens = chunks.where("bucket is null").select("chunk", "packed", "ids")
    named = words.where("chunk is not null").select("chunk", "bucket", "packed")
    blocks = tokens.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(spread, "shard long, chunk long, learn int, packed binary, ids array<long>, figures binary, base binary")
    totals = pair_totals(blocks, shards, heavy)
    parts = blocks.groupBy("shard").cogroup(totals.groupBy("shard")).applyInArrow(score, "chunk long, docs binary, sums binary, ids array<long>, figures binary, base binary")
    return parts.groupBy("chunk").applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(lake.table(spark, sf_dir, "documents"))
