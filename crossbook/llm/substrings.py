"""Removal of word windows that an earlier document already holds, behind a count-min prefilter.

1. Every partition sketches its windows; partition sketches are merged by cell block. A window is counted in the cell of
   its minimizer (the smallest hash of the word 16-grams inside it), once for each document that has that minimizer. Equal
   windows have equal minimizers, so the merged counts overestimate the number of documents with a window and never miss a
   repeat; neighbouring windows share cells, which keeps the sketch an order of magnitude emptier. Counts saturate at 2.
2. A second pass emits only windows estimated to be in two documents or more, as 96-bit hashes. Grouping these exactly
   gives the smallest document of each; windows of later documents are marked and their words removed.

The sketch has a fixed width whatever the corpus (two rows of 2**27 cells; its "twice" bits are 32 MB), so broadcasting it
is bounded. Where it fills up, more windows go through the exact pass; none is lost.

Null and empty texts have no words. Rows with the same doc_id are one document as regards who came first, so none removes the
other's words, but each row gets its own result; a null doc_id comes after all others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake, textkit

WINDOW = 50
GRAM = 16
#: log2 of the cells in each of the sketch's two rows, and of the cells in a block.
CELL_BITS, BLOCK_BITS = 27, 18
#: Bytes of marked spans that may be broadcast to the text pass (each row counted as ROW_BYTES and its spans); beyond, they are joined by shuffle.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
_LAST = (1 << 63) - 1


def _minimizers(words: textkit.Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the minimizer of each."""
    starts = words.runs(window)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    gram = min(gram, window)
    grams = textkit.sequence_hashes(hashes, np.arange(len(hashes) - gram + 1), gram)
    need, have, low = window - gram + 1, 1, grams
    while have * 2 <= need:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < need:
        low = np.minimum(low[: len(low) - (need - have)], low[need - have :])
    return starts, low[starts]


def _cells(minimizers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (minimizers & mask).astype(np.int64), ((minimizers >> np.uint64(bits)) & mask).astype(np.int64)


def sketch(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = CELL_BITS) -> DataFrame:
    """Rows (line, block, twice): for each block of cells that has any, the packed bits of those counted twice or more."""
    block_bits = min(BLOCK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[], []]
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for line, cells in enumerate(seen):
                if not cells:
                    continue
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                cut = np.flatnonzero(np.diff(cell >> block_bits)) + 1
                firsts = cell[np.concatenate(([0], cut))] >> block_bits
                low = (cell & ((1 << block_bits) - 1)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(firsts), line, dtype=np.int32)),
                        pa.array(firsts.astype(np.int32)),
                        pa.array([x.tobytes() for x in np.split(low, cut)], pa.binary()),
                        pa.array([np.packbits(x > 1).tobytes() for x in np.split(n, cut)], pa.binary()),
                    ],
                    names=["line", "block", "cells", "more"],
                )
            seen[0], seen[1] = [], []

        for batch in batches:
            for _, _, data, offsets in textkit.chunks(batch, "text"):
                words = textkit.scan(data, offsets, textkit.PLAIN)
                starts, low = _minimizers(words, words.hashes(), window, gram)
                if not len(starts):
                    continue
                doc = words.doc[starts]
                new = np.ones(len(low), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                once = np.unique(np.stack([doc[new].astype(np.uint64), low[new]]), axis=1)[1]  # once a document
                for line, cells in enumerate(_cells(once, bits)):
                    seen[line].append(cells)
                held += len(once)
            if held > 2_000_000:
                yield from flush()
                held = 0
        yield from flush()

    def merge(key, frames):
        n = np.zeros(1 << block_bits, dtype=np.uint8)
        for cells, more in zip(frames.column("cells").to_pylist(), frames.column("more").to_pylist(), strict=True):
            at = np.frombuffer(cells, dtype="<u4")
            n[at] = np.minimum(n[at] + 1 + np.unpackbits(np.frombuffer(more, dtype=np.uint8), count=len(at)), 2)
        return pa.table({"line": [key[0].as_py()], "block": [key[1].as_py()], "twice": [np.packbits(n > 1).tobytes()]}, schema=pa.schema([("line", pa.int32()), ("block", pa.int32()), ("twice", pa.binary())]))

    rows = lake.map_arrow(lake.text_bytes(docs), count, "line int, block int, cells binary, more binary")
    return rows.groupBy("line", "block").applyInArrow(merge, "line int, block int, twice binary")


def repeated_windows(docs: DataFrame, twice: np.ndarray, window: int = WINDOW, gram: int = GRAM, bits: int = CELL_BITS) -> DataFrame:
    """Rows (h1, h2, id, tag, at) of the windows that the sketch counts twice or more; at: the first word's index in the text."""
    plane = docs.sparkSession.sparkContext.broadcast(twice)  # 2 * 2**bits bits

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = plane.value
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, _, data, offsets in textkit.chunks(batch, "text"):
                words = textkit.scan(data, offsets, textkit.PLAIN)
                hashes = words.hashes()
                starts, low = _minimizers(words, hashes, window, gram)
                if not len(starts):
                    continue
                hit = np.ones(len(low), dtype=bool)
                for line, cells in enumerate(_cells(low, bits)):
                    hit &= (bits_of[line][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                starts = starts[hit]
                if not len(starts):
                    continue
                h1 = textkit.sequence_hashes(hashes, starts, window)
                h2 = textkit.sequence_hashes(textkit.mix(hashes + np.uint64(77)), starts, window) >> np.uint64(32)
                doc = words.doc[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(ids[row + doc]), pa.array(tags[row + doc]), pa.array((starts - words.first[doc]).astype(np.int32))],
                    names=["h1", "h2", "id", "tag", "at"],
                )

    return lake.map_arrow(lake.text_bytes(docs, *_identity()), emit, "h1 long, h2 int, id long, tag long, at int")


def _identity() -> tuple[F.Column, F.Column]:
    """A row's id (null: after all others) and a tag that tells apart texts under one id."""
    return F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("tag")


def _marked(windows: DataFrame, window: int) -> DataFrame:
    """Rows (id, tag, spans): word intervals [from, to) to remove, as packed 32-bit pairs."""
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("first_doc"), F.max("id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
    first = lake.written(first, "repeats")  # read anew, both sides of the join are dealt for it alone, so a common window can be split
    later = windows.join(first.hint("merge"), ["h1", "h2"]).where("id > first_doc").select("id", "tag", "at")

    def spans(pdf: pd.Series) -> bytes:
        at = np.unique(pdf.to_numpy())
        cut = np.flatnonzero(np.diff(at) > window) + 1
        lo = at[np.concatenate(([0], cut))]
        hi = at[np.concatenate((cut - 1, [len(at) - 1]))] + window
        return np.stack([lo, hi], axis=1).astype("<i4").tobytes()

    # Positions of a text, at most as many as it has words.
    return later.groupBy("id", "tag").agg(F.pandas_udf(spans, "binary")("at").alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = CELL_BITS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined by one space, as binary)."""
    blocks = sketch(docs, window, gram, bits).collect()  # merged sketch: at most 2 * 2**bits bits
    twice = np.zeros((2, (1 << bits) // 8), dtype=np.uint8)
    size = (1 << min(BLOCK_BITS, bits)) // 8
    for r in blocks:
        twice[r.line, r.block * size : (r.block + 1) * size] = np.frombuffer(r.twice, dtype=np.uint8)
    windows = repeated_windows(docs, twice, window, gram, bits)
    marks = lake.written(_marked(windows, window), "spans")
    small = marks.agg(F.coalesce(F.sum(F.octet_length("spans") + ROW_BYTES), F.lit(0))).first()[0] <= BROADCAST_BYTES
    joined = lake.text_bytes(docs, "doc_id", *_identity()).join(marks.hint("broadcast" if small else "merge"), ["id", "tag"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().split()
                n = len(words)
                if spans:
                    for lo, hi in np.frombuffer(spans, dtype="<i4").reshape(-1, 2)[::-1].tolist():
                        del words[lo:hi]
                total.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return lake.map_arrow(joined.select("doc_id", "text", "spans"), cut, "doc_id long, n_words long, n_removed long, kept binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(lake.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
