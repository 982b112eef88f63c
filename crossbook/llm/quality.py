"""Quality rules on texts and on lines that recur across documents of a host.

Lines are normalised (lower-cased words of letters and digits), hashed, and counted once a document for each host; counts
are combined in each chunk before they are shuffled. A line in more than MIN_DOCS documents of its host, however large that
is, is boilerplate: it is removed from every document but the first that has it, so a text that many documents repeat
survives once. The first is the one of the smallest doc_id, null coming last, and of documents with one id that of the smallest hash of
its text; rows that repeat it with id and text are the same document, though each counts. (Callers may ask for a share of the host's documents besides.) A document is rejected if the base rules fail, or if removal
leaves it depleted: fewer than MIN_WORDS words, or less than MIN_LEFT of its words.

Null and empty texts have no words and fail the base rules. A null host and '' are one host. Rows with the same doc_id are
judged separately. An empty table gives an empty result. Other columns are carried through by `filtered`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake, textkit

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 25
MIN_LEFT = 0.3
#: Stands for a null doc_id, above all ids in use.
NO_ID = (1 << 63) - 1
#: Boilerplate lines that may be broadcast (16 bytes each); beyond, only the tenth of so many that most documents have is
#: broadcast, and the others, each in few documents then, are joined to the lines of the documents.
BROADCAST_LINES = 1_000_000
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = 1
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _norm_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, textkit.Words]:
    """For each line with a normalised word: its text, its hash, and the bytes it spans (without the line end)."""
    words = textkit.scan(data, offsets, textkit.ALNUM)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.starts) + words.doc  # differs between lines and between texts
    new = np.flatnonzero(np.diff(line, prepend=-1))
    counts = np.diff(np.append(new, len(line)))
    doc = words.doc[new]
    at = np.searchsorted(breaks, words.starts[new])
    ends = np.minimum(np.append(breaks, len(data))[at], offsets[doc + 1])
    begins = np.maximum(np.concatenate(([0], breaks + 1))[at], offsets[doc])
    return doc, textkit.sequence_hashes(words.hashes(), new, counts), begins, ends, words


def line_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Rows (host, line, docs, first_doc, first_tag): documents of each host's normalised lines, and the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            hosts = batch.column(1).dictionary_encode()
            code = hosts.indices.to_numpy(zero_copy_only=False)
            for row, _, data, offsets in textkit.chunks(batch, "text"):
                doc, line, _, _, _ = _norm_lines(data, offsets)
                if not len(doc):
                    continue
                key = textkit.mix(line ^ textkit.mix(doc.astype(np.uint64) + np.uint64(1)))
                once = np.unique(key, return_index=True)[1]
                doc, line = doc[once], line[once]
                c, d, g = code[row + doc], ids[row + doc], tags[row + doc]
                order = np.lexsort((g, d, line, c))
                c, d, g, line = c[order], d[order], g[order], line[order]
                cut = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (c[1:] != c[:-1]))))
                n = np.diff(np.append(cut, len(line)))
                yield pa.RecordBatch.from_arrays([hosts.dictionary.take(pa.array(c[cut])), pa.array(line[cut].view(np.int64)), pa.array(n), pa.array(d[cut]), pa.array(g[cut])], names=["host", "line", "docs", "first_doc", "first_tag"])

    texts = lake.text_bytes(docs, _name()[0], F.coalesce(F.col(host), F.lit("")).alias("host"), _name()[1])
    rows = lake.map_arrow(texts, run, "host string, line long, docs long, first_doc long, first_tag long")
    return rows.groupBy("host", "line").agg(F.sum("docs").alias("docs"), F.min(F.struct("first_doc", "first_tag")).alias("f")).select("host", "line", "docs", "f.*")


def _name() -> tuple:
    """A document's id (null: NO_ID) and a hash of its text."""
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("_id"), F.xxhash64(F.col("text")).alias("_tag")


def boilerplate(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float | None = None) -> DataFrame:
    """Rows (host, line, docs, first_doc, first_tag) of lines above the limit of their host."""
    often = line_counts(docs, host).where(F.col("docs") > min_docs)
    if share is None:
        return often
    hosts = docs.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(F.count("*").alias("all_docs"))
    return often.join(hosts.hint("shuffle_hash"), "host").where(F.col("docs") > share * F.col("all_docs")).drop("all_docs")


def _text_key(docs: DataFrame, host: str) -> list:
    """Two hashes of a row's id, host and text: rows that share them lose the same lines."""
    parts = (F.coalesce(F.col("doc_id"), F.lit(NO_ID)), F.coalesce(F.col(host), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(1), *parts).alias("_k2")]


def _lines_of(docs: DataFrame, host: str, lines: DataFrame) -> DataFrame:
    """Rows (_k1, _k2, _often): of lines (host, line, first_doc, first_tag), those that go from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in textkit.chunks(batch, "text"):
                doc, line, _, _, _ = _norm_lines(data, offsets)
                key = textkit.mix(line ^ textkit.mix(doc.astype(np.uint64) + np.uint64(1)))
                once = np.unique(key, return_index=True)[1]
                at = pa.array(row + doc[once])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(5)), pa.array(line[once].view(np.int64))], names=["_k1", "_k2", "_id", "_tag", "host", "line"])

    texts = lake.text_bytes(docs, *_text_key(docs, host), *_name(), F.coalesce(F.col(host), F.lit("")).alias("host"))
    rows = lake.map_arrow(texts, run, "_k1 long, _k2 long, _id long, _tag long, host string, line long")
    hit = rows.join(lines.hint("merge"), ["host", "line"]).where("_id <> first_doc or _tag <> first_tag")
    return hit.groupBy("_k1", "_k2").agg(F.collect_set("line").alias("_often"))


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures of each text of a chunk."""
    words = textkit.scan(data, offsets, textkit.PLAIN)
    n = len(offsets) - 1
    hashes = words.hashes()

    def total(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    spaces = np.isin(data, np.frombuffer(textkit.SPACES, dtype=np.uint8))
    out = {"n_words": words.counts.astype(np.int64), "word_chars": total(~spaces & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data])}
    # Lines with a word, equal to an earlier one of the text
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.starts) + words.doc
    new = np.flatnonzero(np.diff(line, prepend=-1))
    doc, at = words.doc[new], np.searchsorted(breaks, words.starts[new])
    ends = np.minimum(np.append(breaks, len(data))[at], offsets[doc + 1])
    begins = np.maximum(np.concatenate(([0], breaks + 1))[at], offsets[doc])
    raw = textkit.sequence_hashes(textkit._BYTES[data], begins, ends - begins)
    key = np.unique(textkit.mix(raw ^ textkit.mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[key], minlength=n)
    # Words in three-word windows that the text has twice or more
    starts = words.runs(3)
    key = textkit.mix(textkit.sequence_hashes(hashes, starts, 3) ^ textkit.mix(words.doc[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(key) else np.zeros(0, dtype=bool)
    hit = starts[order[again]]
    cover = np.zeros(len(words.doc) + 3, dtype=bool)
    for k in range(3):
        cover[hit + k] = True
    out["n_repeat_words"] = np.bincount(words.doc, weights=cover[: len(words.doc)], minlength=n).astype(np.int64)
    return out


def judged(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float | None = None, keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, the base figures, base_failed, n_boilerplate_words, kept; keep_text adds docs' `row` and
    `clean`, the text without boilerplate lines."""
    spark = docs.sparkSession
    often = lake.written(boilerplate(docs, host, min_docs, share), "lines")
    small = often.count() <= BROADCAST_LINES
    named = F.coalesce(F.col(host), F.lit("")).alias("_host")
    keys = [] if small else _text_key(docs, host)
    columns = (named, *_name(), *keys)
    df = lake.packed(docs, "doc_id", *columns) if keep_text else lake.text_bytes(docs, "doc_id", *columns).withColumnRenamed("text", "_raw")
    carry = ["doc_id", "row"] if keep_text else ["doc_id"]
    hot = often
    if not small:
        hot = lake.written(often.orderBy(F.desc("docs"), "line", "host").limit(max(BROADCAST_LINES // 10, 0)), "hot")
        rest = lake.written(_lines_of(docs, host, often.drop("docs").join(hot.select("host", "line").hint("merge"), ["host", "line"], "left_anti")), "often")
        df = df.join(rest.hint("merge"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    lines: dict[str, dict[int, tuple[int, int]]] = {}
    for r in hot.toLocalIterator():
        lines.setdefault(r.host, {})[r.line] = r.first_doc, r.first_tag
    table = spark.sparkContext.broadcast({h: _sorted(x) for h, x in lines.items()})  # at most BROADCAST_LINES lines
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            ids, tags = (col[c].to_numpy(zero_copy_only=False) for c in ("_id", "_tag"))
            out = {c: np.zeros(batch.num_rows, dtype=np.int64) for c in made}
            clean: list = [None] * batch.num_rows
            hosts = col["_host"].dictionary_encode()
            code = hosts.indices.to_numpy(zero_copy_only=False)
            by_host = [table.value.get(h) for h in hosts.dictionary.to_pylist()]
            for row, end, data, offsets in textkit.chunks(batch, "_raw"):
                for c, v in text_stats(data, offsets).items():
                    out[c][row:end] = v
                doc, line, begins, ends, words = _norm_lines(data, offsets)
                gone = np.zeros(len(doc), dtype=bool)
                for k in np.unique(code[row:end]):
                    if by_host[k] is not None:
                        at = np.flatnonzero(code[row + doc] == k)
                        gone[at] = _is_often(by_host[k], line[at], ids[row + doc[at]], tags[row + doc[at]])
                if not small:
                    ends_at = np.searchsorted(doc, np.arange(end - row + 1))
                    for r in range(row, end):
                        if (mine := col["_often"][r].as_py()) is not None:
                            at = slice(ends_at[r - row], ends_at[r - row + 1])
                            gone[at] |= np.isin(line[at].view(np.int64), mine)
                if gone.any():
                    plain = textkit.scan(data, offsets, textkit.PLAIN)
                    # PLAIN words inside the lines that go
                    a, b = np.searchsorted(plain.starts, begins[gone]), np.searchsorted(plain.starts, ends[gone])
                    out["n_boilerplate_words"][row:end] = np.bincount(doc[gone], weights=b - a, minlength=end - row).astype(np.int64)
                    if keep_text:
                        for r in np.unique(doc[gone]):
                            clean[row + r] = _without(data, offsets[r], offsets[r + 1], [(x, y) for x, y in zip(begins[gone & (doc == r)], ends[gone & (doc == r)], strict=True)])
            arrays = [col[c] for c in carry] + [pa.array(out[c]) for c in made] + ([pa.array(clean, pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *made, *(["clean"] if keep_text else [])])

    schema = lake.schema(df, carry, ", ".join([f"{c} long" for c in made] + ["clean string"] * keep_text))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_boilerplate_words") > 0) & ((left < MIN_WORDS) | (left < MIN_LEFT * F.col("n_words")))
    return lake.map_arrow(df, run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def _sorted(lines: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    keys = sorted(lines)
    return np.array(keys, dtype=np.int64), np.array([lines[k] for k in keys], dtype=np.int64).T


def _is_often(table: tuple[np.ndarray, np.ndarray], line: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    keys, (first, tag) = table
    at = np.minimum(np.searchsorted(keys, line.view(np.int64)), len(keys) - 1)
    return (keys[at] == line.view(np.int64)) & ((ids != first[at]) | (tags != tag[at]))


def _without(data: np.ndarray, lo: int, hi: int, spans: list[tuple[int, int]]) -> str:
    keep, at = [], lo
    for a, b in spans:
        keep.append(data[at:a].tobytes())
        at = min(b + 1, hi)  # with its line end
    return b"".join([*keep, data[at:hi].tobytes()]).decode("utf-8", "replace")


def filtered(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float | None = None) -> DataFrame:
    """Documents that are kept, without their boilerplate lines; the columns of docs."""
    out = judged(docs, host, min_docs, share, keep_text=True).where("kept")
    return lake.unpacked(out, docs, F.coalesce("clean", "row.text"), F.col("clean").isNotNull())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(lake.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", *_STATS, "base_failed", "kept", "n_boilerplate_words")
