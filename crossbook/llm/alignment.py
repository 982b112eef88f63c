"""Alignment of two tokenizers' tokens, each distinct text once.

1. Rows are grouped by their whole text; copies are counted before the shuffle. Each distinct text is tokenised by both vocabularies and
   aligned once: byte offsets where a token of both ends cut it into groups, and link the two tokens that end there.
2. Counts of linked id pairs are sums over the distinct texts, weighted by how many rows have the text.
3. Measures of a text need the counts of its pairs. Of N links in all, at most FREQUENT pairs have N / FREQUENT links or more; these are
   broadcast, whatever the corpus. The links of the rarer pairs are joined by shuffle, where no pair has more than N / FREQUENT of them.
4. Measures go back to the rows by the text's SHA-256.

Neither vocabulary has a token with a space after another character, so texts are cut before single spaces that stand between other
characters; the segments' tokens and groups are remembered by a worker. If a segment doesn't come back byte by byte, the whole text is
tokenised and compared.

Null and empty texts have no tokens, nor have those whose tokens' bytes aren't a space and the text: zeros and an empty `groups`. Rows
are measured one by one, also with equal or null ids. Very long texts are handled whole. An empty table gives an empty result; columns
besides id and text are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake

#: Pairs that are broadcast at most, at 17 bytes each.
FREQUENT = 1 << 20
#: Segments a worker remembers (none over SEGMENT_BYTES); the memory is emptied when it is full.
SEGMENTS, SEGMENT_BYTES = 250_000, 200
#: Bytes of texts aligned at once.
LOT_BYTES = 1 << 20
ALIGNED = "text_key string, times long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACES = re.compile(rb"[\t-\r\x80-\xaf] [\t-\r\xc2\xe1\xe2\xe3]|  |\xe2\x96\x81")  # what the quick cut isn't made for
#: A segment that no token joins with what stands before it.
_SAFE = re.compile(rb" (?:[\x21-\x7e]|[\xc3-\xdf\xe4-\xf4])")
_aligners: dict[tuple[str, str], "_Aligner"] = {}


def byte_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Aligner:
    """Tokens, groups and links of segments, in columns: a segment is known by its number."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_of_characters()
        self.bytes_a = {i: bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = len(pieces)
        # Links are numbers a * size_b + b.
        self.kind = np.dtype("<u4") if (max(self.bytes_a) + 1) * self.size_b <= 1 << 32 else np.dtype("<u8")
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.links: list[bytes] = []
        self.figures = np.zeros((SEGMENTS, 4), dtype=np.int64)  # tokens of A, of B, groups, whether bytes come back

    def align(self, raw: bytes, a: list[int], b: list[int]) -> tuple[str, tuple[int, int, int, bool], bytes]:
        """raw with its leading space; its ids of A and B."""
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return "", (0, 0, 0, False), b""
        out, links = [], []
        i = j = at_a = at_b = from_a = from_b = 0
        while i < len(a) or j < len(b):
            if j == len(b) or (i < len(a) and at_a <= at_b):
                at_a += len(parts_a[i])
                i += 1
            else:
                at_b += len(parts_b[j])
                j += 1
            if at_a == at_b and i > from_a and j > from_b:
                out.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                links.append(a[i - 1] * self.size_b + b[j - 1])
                from_a, from_b = i, j
        return ";".join(out), (len(a), len(b), len(out), True), np.array(links, dtype=self.kind).tobytes()

    def encode(self, segments: list[bytes]) -> Iterator[tuple[str, tuple[int, int, int, bool], bytes]]:
        texts = [s.decode("utf-8", "replace") for s in segments]
        ids_a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return (self.align(raw, e.ids, b) for raw, e, b in zip(segments, ids_a, ids_b, strict=True))

    def remember(self, lot: list[bytes], groups: list[str], links: list[bytes], figures: np.ndarray) -> None:
        at = len(self.groups)
        self.number.update(zip(lot, range(at, at + len(lot)), strict=True))
        self.groups += groups
        self.links += links
        while len(self.figures) < at + len(lot):
            self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
        self.figures[at : at + len(lot)] = figures

    def learn(self, new: list[bytes]) -> None:
        """Segments that tokens can't join with their neighbours are tokenised together, the others one by one."""
        apart = [s for s in new if not _SAFE.match(s) or s[-1] == 0x20]
        safe = list(set(new).difference(apart))
        for at in range(0, len(safe), 2000):
            if not self.learn_lot(safe[at : at + 2000]):
                apart += safe[at : at + 2000]
        if apart:
            groups, figures, links = zip(*self.encode(apart), strict=True)
            self.remember(apart, list(groups), list(links), np.array(figures, dtype=np.int64))

    def learn_lot(self, lot: list[bytes]) -> bool:
        """As align, for many segments at once; False where the bytes don't come back."""
        whole = b"".join(lot)
        text = whole.decode("utf-8", "replace")
        ids_a, ids_b = np.array(self.a.encode(text, add_special_tokens=False).ids), np.array(self.b.encode(text[1:]))
        list_a, list_b = ids_a.tolist(), ids_b.tolist()
        parts_a, parts_b = [self.bytes_a[i] for i in list_a], [self.bytes_b[i] for i in list_b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return False
        end_a, end_b = (np.cumsum(np.fromiter(map(len, x), dtype=np.int64, count=len(x))) for x in (parts_a, parts_b))
        stop = np.cumsum(np.fromiter(map(len, lot), dtype=np.int64, count=len(lot)))
        both = np.intersect1d(end_a, end_b)
        if not np.isin(stop, both).all():
            return False
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        of = np.searchsorted(stop, both)  # the segment of each group
        links = ids_a[np.searchsorted(end_a, both)] * self.size_b + ids_b[np.searchsorted(end_b, both)]
        turn = np.concatenate([2 * group_a, 2 * group_b + 1])  # a group's tokens of A, then of B
        order = np.argsort(turn, kind="stable")
        turn = turn[order]
        after = np.append(turn[1:], -1)
        kind = np.where(after == turn, 0, np.where(turn & 1 == 0, 1, 2))
        last = np.flatnonzero(kind == 2)
        kind[last[np.append(of[1:] != of[:-1], True)]] = 3
        names = [*map(str, list_a), *map(str, list_b)]
        marks = (",", "|", ";", "\n")
        written = "".join([names[i] + marks[k] for i, k in zip(order.tolist(), kind.tolist(), strict=True)])
        n = len(lot)
        figures = np.stack([np.bincount(of[group_a], minlength=n), np.bincount(of[group_b], minlength=n), np.bincount(of, minlength=n), np.ones(n, dtype=np.int64)], axis=1)
        raw = links.astype(self.kind).tobytes()
        cuts = (np.concatenate(([0], np.cumsum(figures[:, 2]))) * self.kind.itemsize).tolist()
        self.remember(lot, written.split("\n")[:n], [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], figures)
        return True

    def texts(self, lot: list[bytes]) -> list[tuple[int, int, int, str, bytes]]:
        """n_a, n_b, n_groups, groups and links of each text; texts come without the leading space."""
        cut = [segments(t) for t in lot]
        if len(self.number) > SEGMENTS:
            self.clear()
        long = {s for parts in cut if max(map(len, parts), default=0) > SEGMENT_BYTES for s in parts if len(s) > SEGMENT_BYTES}
        self.learn(list(set().union(*cut).difference(long, self.number)))
        number, groups, links, figures = self.number, self.groups, self.links, self.figures
        out = []
        for text, parts in zip(lot, cut, strict=True):
            if long and not long.isdisjoint(parts):
                found = [next(iter(self.encode([s]))) if s in long else (groups[number[s]], figures[number[s]].tolist(), links[number[s]]) for s in parts]
                spelled, sums, pairs = ";".join([f[0] for f in found]), np.array([f[1] for f in found]).sum(axis=0), b"".join([f[2] for f in found])
            else:
                at = [number[s] for s in parts]
                spelled, sums, pairs = ";".join([groups[i] for i in at]), figures[at].sum(axis=0), b"".join([links[i] for i in at])
            if text and sums[3] != len(parts):
                spelled, sums, pairs = next(iter(self.encode([b" " + text])))
            out.append((int(sums[0]), int(sums[1]), int(sums[2]), spelled, pairs) if text and sums[3] else (0, 0, 0, "", b""))
        return out


def segments(text: bytes) -> list[bytes]:
    """A space and the text, cut before single spaces between other characters, but not inside white space."""
    if not text:
        return []
    if text[0] != 0x20 and text[-1] != 0x20 and not _SPACES.search(text):
        return [b" " + w for w in text.split(b" ")]
    if b"\xe2\x96\x81" in text:
        return [b" " + text]
    try:
        return [s.encode() for s in _CUT.split(" " + text.decode())]
    except UnicodeDecodeError:
        return [b" " + text]


def _aligner(path_a: str, path_b: str) -> _Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = _Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row of ALIGNED for each distinct text that isn't null or empty: its SHA-256, how many rows have it, its token numbers, its
    groups of ids as `a1,a2|b1;a3|b2,b3` and its links as packed numbers a * (size of B's vocabulary) + b."""
    distinct = docs.where("text != ''").groupBy("text").agg(F.count("*").alias("times"))
    distinct = distinct.select(F.sha2("text", 256).alias("text_key"), "times", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            at = 0
            while at < len(batch):
                lot, size, lo = [], 0, at
                while at < len(batch) and size < LOT_BYTES:
                    lot.append(batch.column(2)[at].as_py())
                    size += len(lot[-1])
                    at += 1
                n_a, n_b, n_groups, groups, links = zip(*aligner.texts(lot), strict=True)
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, [len(x) // aligner.kind.itemsize for x in links])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:at], batch.column(1)[lo:at], *numbers, pa.array(groups, pa.string()), pa.array(links, pa.binary())],
                    names=["text_key", "times", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )

    return lake.map_arrow(distinct, run, ALIGNED)


def pair_counts(texts: DataFrame, kind: np.dtype) -> DataFrame:
    """Rows (pair, n): links of each id pair over all rows of the corpus. Lots of texts are summed up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, n = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=kind), batch.column(2).to_numpy()
            pair, at = np.unique(links, return_inverse=True)
            # Whole numbers: sums of weights stay exact in 64-bit floats up to 2**53.
            total = np.bincount(at, weights=np.repeat(batch.column(0).to_numpy(), n), minlength=len(pair))
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(total.astype(np.int64))], names=["pair", "n"])

    return lake.map_arrow(texts.select("times", "links", "n_links"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def measured(texts: DataFrame, counts: DataFrame, kind: np.dtype, size_b: int, frequent: int = FREQUENT) -> DataFrame:
    """Rows (text_key, n_best, count_sum) of the written tables of aligned texts and of pair counts."""
    spark = texts.sparkSession
    top = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))  # at most a row for each id of B
    counts = lake.written(counts.join(top.hint("broadcast"), F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * frequent >= total).toPandas().sort_values("pair")  # at most `frequent` rows
    known = spark.sparkContext.broadcast(tuple(often[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            links, lengths = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=kind).astype(np.int64), batch.column(2).to_numpy()
            of = np.repeat(np.arange(len(batch)), lengths)
            at = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
            hit = pairs[at] == links if len(pairs) else np.zeros(len(links), dtype=bool)
            at, doc = at[hit], of[hit]
            n_best = np.bincount(doc[best[at]], minlength=len(batch))
            sums = np.zeros(len(batch) + 1, dtype=np.int64)
            sums[1:] = np.cumsum(np.bincount(doc, minlength=len(batch)))
            running = np.concatenate(([0], np.cumsum(n[at])))
            count_sum = running[sums[1:]] - running[sums[:-1]]
            rare = ~hit
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of[rare], minlength=len(batch)))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(links[rare]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best.astype(np.int64)), pa.array(count_sum), lists], names=["text_key", "n_best", "count_sum", "rare"])

    parts = lake.written(lake.map_arrow(texts.select("text_key", "links", "n_links"), run, "text_key string, n_best long, count_sum long, rare array<long>"), "measures")
    rare = parts.select("text_key", F.explode("rare").alias("pair")).groupBy("text_key", "pair").agg(F.count("*").alias("links"))
    rare = lake.written(rare, "rare").join(counts.where(F.col("n") * frequent < total).hint("merge"), "pair")
    rare = rare.select("text_key", F.when(F.col("best"), F.col("links")).otherwise(F.lit(0)).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    return parts.drop("rare").unionByName(rare).groupBy("text_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _figures(path_a: str, path_b: str) -> tuple[np.dtype, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    largest = max(Tokenizer.from_file(path_a).get_vocab().values())
    return np.dtype("<u4") if (largest + 1) * size_b <= 1 << 32 else np.dtype("<u8"), size_b


def alignment_measures(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    kind, size_b = _figures(path_a, path_b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    texts = lake.written(aligned(docs, path_a, path_b).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = lake.written(pair_counts(texts, kind), "counts")
    found = texts.drop("times", "links").join(measured(texts, counts, kind, size_b, frequent).hint("merge"), "text_key")
    found = lake.written(found, "texts")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("text_key")).join(found.hint("merge"), "text_key", "left")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return rows.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_measures(lake.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
