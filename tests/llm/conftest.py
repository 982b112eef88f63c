import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words long, kept string, id string, tag string, clean string, spans string, length string, piece string, component_id string, _text string"
#: Columns besides those of documents, with names that the operators use themselves.
EXTRA = ("r", 1, "k", "i", "t", "c", "s", "l", "p", "m", "x")


def frame(spark, rows):
    """documents with extra columns from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, repeats, personal data, empty and very long texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "\t"]) for w in rng.choices(words, k=n))
    passage = text(60)
    texts = [text(rng.choice([1, 3, 5, 20, 60, 120, 300])) for _ in range(60)]
    texts += [passage + text(30), text(20) + " " + passage, passage, text(80) + "\n" + passage.upper()]
    base = text(150)
    for k in range(12):  # near copies of one text: up to k words changed
        w = base.split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3]] * 3 + [texts[5]] * 2
    texts += ["same line here\n" * 30, "word " * 200, "", "   \n\t ", None, "x", text(20_000)]
    rows = list(enumerate(texts, start=1))
    rng.shuffle(rows)
    return rows
