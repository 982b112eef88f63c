import hashlib
import json
from collections import Counter

import pytest

from crossbook.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, vocabularies):
    """Whole texts through both libraries, ends as sets of byte offsets."""
    a, b = vocabularies
    of = alignment.byte_of_characters()
    done = {}
    for _, t in rows:
        if not t or t in done:
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        parts_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        whole = (" " + t).encode()
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            continue
        ends = []
        for parts in (parts_a, parts_b):
            at, e = 0, {}
            for k, p in enumerate(parts):
                at += len(p)
                e[at] = k
            ends.append(e)
        both = sorted(ends[0].keys() & ends[1].keys())
        links, groups, i, j = [], [], 0, 0
        for x in both:
            p, q = ends[0][x], ends[1][x]
            links.append((ids_a[p], ids_b[q]))
            groups.append(",".join(map(str, ids_a[i : p + 1])) + "|" + ",".join(map(str, ids_b[j : q + 1])))
            i, j = p + 1, q + 1
        done[t] = len(ids_a), len(ids_b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
    counts = Counter(x for _, t in rows if t in done for x in done[t][3])
    most = Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    out = []
    for d, t in rows:
        if t not in done:
            out.append((str(d), 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, sha = done[t]
        out.append((str(d), n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out)


ODD = [
    " leading", "trailing ", "  two  spaces  ", " ", "   ", "\n", "a\n b", "a\n  b", "a \n b", "a \n\n  b \t c", "tab\t x", "nbsp  x", "x  y", "é   z", "a　 b 　c", "▁ under ▁score", "low ▁",
    "<|endoftext|> and <|endoftext|>x", "<unk> <s> </s>", "it's we'll I'd", "emoji 😀 👩‍👩‍👧 end", "é combining", "nul \x00 byte", "\x1c \x1d x", "日本語 の テキスト", "мир и война", "1234567 89", "a" * 500 + " " + "b" * 300,
    "x " * 50 + " ", "\r\n \r\n", "a\u0085 b", "a\x0b \x0cb", "ß ä    ö", "C2 Â â à ’quote’ à “x”",
]


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_against_whole_texts(make, corpus, vocabularies, frequent):
    """Also with most pairs joined by shuffle; ids repeat and are null, texts repeat."""
    rows = [*corpus, *[(1000 + k, t) for k, t in enumerate(ODD)], (None, corpus[3][1]), (5, corpus[3][1]), (5, "it's"), (None, None)]
    got = alignment.alignment_measures(make(rows), A, B, frequent).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == brute(rows, vocabularies)


def test_segments_of_the_test_table(vocabularies):
    """Segments' tokens are those of the whole text, over real documents of all four languages."""
    pq = pytest.importorskip("pyarrow.parquet")
    a, b = vocabularies
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    aligner = alignment._Aligner(A, B)
    for t, (n_a, n_b, _, groups, _) in zip(texts, aligner.texts([t.encode() for t in texts]), strict=True):
        if not groups:
            continue
        sides = [g.split("|") for g in groups.split(";")]
        assert [int(i) for g in sides for i in g[0].split(",")] == a.encode(" " + t, add_special_tokens=False).ids and len(a.encode(" " + t, add_special_tokens=False).ids) == n_a
        assert [int(i) for g in sides for i in g[1].split(",")] == b.encode(t) and len(b.encode(t)) == n_b


def test_memory_is_emptied(monkeypatch, vocabularies):
    aligner = alignment._Aligner(A, B)
    texts = [f"word{k} again" for k in range(50)]
    want = aligner.texts([t.encode() for t in texts])
    monkeypatch.setattr(alignment, "SEGMENTS", 5)
    aligner.clear()
    assert [aligner.texts([t.encode()])[0] for t in texts] == want


def test_byte_characters():
    """As in the vocabulary file: every character of its tokens is known."""
    of = alignment.byte_of_characters()
    assert sorted(of.values()) == list(range(256))
    assert all(c in of for t in json.load(open(A))["model"]["vocab"] for c in t if t != "<|endoftext|>")


def test_empty(make):
    assert alignment.alignment_measures(make([]), A, B).count() == 0
