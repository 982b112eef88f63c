"""Token counts of a unigram segmentation, with scores shared along a trie of pre-tokens.

The distinct pre-tokens of a chunk are walked in sorted order, which is the depth-first order of their trie: the forward score
(best log probability of the prefix) and its token count are kept for every node on the path, so a shared prefix is computed
once. Counts at the terminals are remembered, and a document's count is the sum over its words.

The vocabulary is a public one of 32,000 pieces. It gives ranks and not probabilities, so piece r gets log(1 / (r + RANK_SHIFT)).
A character in no piece costs one token for each of its UTF-8 bytes. Between equal scores the segmentation of fewer tokens counts.

Null and empty texts have no words and no tokens. Rows are counted separately, also where they repeat a doc_id. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import lake

RANK_SHIFT = 10.0
#: Pre-tokens whose counts a worker remembers; the memory is emptied when it is full.
WORD_CACHE = 800_000
_counters: dict[str, object] = {}


def pieces(model_path: str) -> dict[str, float]:
    """Scores of the vocabulary's pieces, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return {sp.id_to_piece(i): -math.log(r + RANK_SHIFT) for r, i in enumerate(usable)}


def trie_counts(words: list[str], scores: dict[str, float]) -> list[int]:
    """Tokens of each word; words are sorted and distinct."""
    longest = max(map(len, scores), default=1)
    worst = min(scores.values(), default=0.0) - 10.0
    best, count = [0.0], [0]  # of the nodes on the path from the root
    out, path = [], ""
    get = scores.get
    for word in words:
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            n_bytes = len(word[end - 1].encode("utf-8", "surrogateescape"))
            top, least = best[end - 1] + worst * n_bytes, count[end - 1] + n_bytes
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    s += best[start]
                    n = count[start] + 1
                    if s > top or (s == top and n < least):
                        top, least = s, n
            best.append(top)
            count.append(least)
        path = word
        out.append(count[-1])
    return out


def _counter(model_path: str) -> tuple[dict[bytes, int], dict[str, float]]:
    if model_path not in _counters:
        _counters[model_path] = {}, pieces(model_path)
    return _counters[model_path]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = _counter(model_path)
        for batch in batches:
            texts = batch.column(1)
            n_words, n_tokens, at = [], [], 0
            while at < len(texts):
                lot, size = [], 0
                while at < len(texts) and size < 4 << 20:
                    raw = texts[at].as_py()
                    lot.append(raw)
                    size += len(raw)
                    at += 1
                split = [x.split() for x in lot]
                new = set().union(*split).difference(known)
                if len(known) + len(new) > WORD_CACHE:
                    known.clear()
                    new = set().union(*split)
                by_text = sorted({"▁" + w.decode("utf-8", "surrogateescape"): w for w in new}.items())
                known.update(zip([w for _, w in by_text], trie_counts([t for t, _ in by_text], scores), strict=True))
                for words in split:
                    n_words.append(len(words))
                    n_tokens.append(sum([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return lake.map_arrow(lake.text_bytes(docs, "doc_id"), run, "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(lake.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
