"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised and cut into pieces of at most `capacity` tokens in one Arrow pass. Only the histogram of
piece lengths (at most `capacity` rows, whatever the corpus) reaches the driver. There minimum bin slack builds
*patterns*: the longest length left is fixed, a bitset subset-sum over the lengths left finds the fullest feasible
combination, and that combination is removed as often as the histogram allows. A pattern used t times stands for t
sequences, so the plan's size depends on the capacity and not on the number of documents. Pieces find their place from
their rank among pieces of the same length; ranks are counted in salted groups, so that one common length is never one task.

Nulls, empty texts: the document is its end token alone. Rows with equal ids are separate pieces.
An empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a worker remembers; the memory is emptied when it is full.
WORD_CACHE = 600_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_encoders: dict[str, object] = {}


def _word_encoder(tokenizer_path: str):
    """bytes of a text -> little-endian unsigned 32-bit ids of its words; one encoder for each worker.

    This vocabulary's pre-tokens never hold white space and its normaliser maps white space to one space and lower-cases, so
    words between ASCII white space are encoded apart, lower-cased, and remembered. A text that may hold a special token's
    name is encoded as it is."""
    if tokenizer_path in _encoders:
        return _encoders[tokenizer_path]
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(tokenizer_path)
    ends = np.zeros(tok.get_vocab_size(), dtype=bool)
    ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
    known: dict[bytes, bytes] = {}

    def learn(words: list[bytes]) -> None:
        """Letters alone (of Latin-1, which normalisation leaves whole) are one pre-token, which ends with the id of a word end;
        many are encoded at once."""
        plain, odd, tails = [], [], []
        for w in words:
            t = w.decode("utf-8", "replace")
            if t.isalpha() and max(t) < "\u0100":
                plain.append(w)
            elif w[-1:] in b".," and t[:-1].isalpha() and max(t) < "\u0100":
                tails.append(w)
                plain += [w[:-1]] * (w[:-1] not in known)
            else:
                odd.append(w)
        plain = list(dict.fromkeys(plain))
        if tails:
            odd += [x for x in (b".", b",") if x not in known]
        lots = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for lot, e in zip(lots, tok.encode_batch_fast([b" ".join(x).decode() for x in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cut = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            known.update(zip(lot, [raw[a:b] for a, b in zip([0, *cut], cut)], strict=True))
        for w, e in zip(odd, tok.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w in tails:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def encode(text: bytes) -> bytes:
        if b"<|" in text:
            return np.array(tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.lower().split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join(_fresh(words))

    def _fresh(words: list[bytes]) -> list[bytes]:
        if len(known) > WORD_CACHE:
            known.clear()
        learn([w for w in dict.fromkeys(words) if w not in known])
        return [known[w] for w in words]

    def prepare(texts: list[bytes]) -> None:
        """Learns the words of several texts at once."""
        new: set[bytes] = set()
        for t in texts:
            new.update(t.lower().split())
        new.difference_update(known)
        if len(known) + len(new) > WORD_CACHE:
            known.clear()
            return
        learn(list(new))

    _encoders[tokenizer_path] = encode, prepare
    return encode, prepare


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of PIECES: every document's ids and the end id, cut into pieces of at most capacity ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, prepare = _word_encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts, fresh = batch.column(1), 0
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                if i == fresh:  # words of the next texts, about a megabyte
                    lot, size = [], 0
                    while fresh < len(texts) and size < 1 << 20:
                        lot.append(texts[fresh].as_py())
                        size += len(lot[-1])
                        fresh += 1
                    prepare([x for x in lot if b"<|" not in x])
                    at = i
                ids = encode(lot[i - at]) + end
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, v in zip(out, (doc_id, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return lake.map_arrow(lake.text_bytes(docs, "doc_id"), run, PIECES)


def fill_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a histogram of lengths: [(length -> how often in a bin, number of such bins)]."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        room = capacity - lengths[0]
        full = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for n in lengths:
            if n > room:
                continue
            for _ in range(min(left[n] - (n == lengths[0]), room // n)):
                grown = (reach | (reach << n)) & full
                if grown == reach:
                    break
                steps.append((n, reach))
                reach = grown
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        pattern = {lengths[0]: 1}
        for n, before in reversed(steps):
            if not before >> at & 1:
                pattern[n] = pattern.get(n, 0) + 1
                at -= n
        times = min(left[n] // k for n, k in pattern.items())
        out.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _plan(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """keys: length << 40 | first rank, sorted; rows: (times a bin, first sequence, offset in the bin, first rank)."""
    taken: dict[int, int] = {}
    keys, rows, sequence = [], [], 0
    for pattern, times in patterns:
        offset = 0
        for n, k in pattern.items():
            lo = taken.get(n, 0)
            keys.append(n << 40 | lo)
            rows.append((k, sequence, offset, lo))
            taken[n] = lo + k * times
            offset += n * k
        sequence += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return np.array(keys, dtype=np.int64)[order], np.array(rows, dtype=np.int64).reshape(-1, 4)[order]


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with columns doc_id, piece and length (1 to capacity)."""
    spark = table.sparkSession
    table = lake.written(table, "pieces")
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    keys, rows = _plan(fill_patterns(histogram, capacity))
    plan = spark.sparkContext.broadcast((keys, rows))  # bounded by the capacity: a few rows for each length and pattern
    # Equal documents must not share a salt, so it comes from the whole row's identity.
    salts = max(64, max(histogram.values(), default=0) // 100_000)
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = lake.written(salted.groupBy("length", "salt").count(), "lengths")
    from pyspark.sql import Window

    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before.hint("shuffle_hash"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    columns = [c for c in table.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = plan.value
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k, sequence, offset, lo = rows[np.searchsorted(keys, n.astype(np.int64) << 40 | rank, side="right") - 1].T
            i = rank - lo
            made = [pa.array(sequence + i // k), pa.array(offset + (i % k) * n)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + made, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", sequence_id long, offset long"
    return lake.map_arrow(ranked, place, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(lake.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
