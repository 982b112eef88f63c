"""Personal data: exact patterns, and boosted trees over candidate spans.

Four kinds have exact base patterns (email, ip, card, phone); their matches are always spans. High-recall generators propose
further, overlapping spans: spelled-out addresses ("name at host dot tld"), separated digit groups, and groups of digits and
dots. Boosted trees score each proposal from its format (digits, groups, separators) and its context (what stands around it,
what kind of word comes before it). They learn from a bounded sample of documents (SAMPLE_DOCS, the smallest by hash).
Positive are proposals that lie in a base span, and base spans rewritten in their context into the forms of a generator:
addresses spelled out, phones without plus or country code. Negative are the proposals that a base check refuses (cards, ips),
and of phones and addresses those without a word of contact before them and in no form that a positive has; ordinary words in
the form of an address stand beside each rewritten one. Other proposals may be real and have no label. Features leave out
what the base checks decide on (the leading plus, the Luhn sum), so look-alikes score as their kind does. Half of the sample
sets each kind's threshold at PRECISION. Accepted proposals that overlap no base span are added, best score first.

Null and empty texts have no spans. Rows are judged separately, also where they repeat a doc_id. Without both labels in the
sample only base spans are found. An empty table gives an empty result. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, lake, textkit

KINDS = ("email", "ip", "card", "phone")
#: Documents whose proposals the trees learn from, and proposals at most.
SAMPLE_DOCS, SAMPLE_SPANS = 4000, 20_000
#: At least so many positive proposals of a kind are needed to learn it.
LEAST_POSITIVE = 20
PRECISION = 0.98
_DIGITS = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}(?:(?: ?(?:\(dot\)|\[dot\]| dot ) ?|\.)[A-Za-z0-9-]{1,64})+| at [A-Za-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,64})+)",
    re.ASCII | re.IGNORECASE,
)
_AT = re.compile(r" at |\(at\)|\[at\]", re.IGNORECASE)
#: How addresses are spelled out: the signs for '@' and '.'.
SPELLINGS = ((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" [at] ", "."))
_TLDS = frozenset("com org net edu gov mil int info biz io dev app co ai me tv eu us uk de fr nl it es pt pl ru ua cz ch at be se no dk fi ie nz au ca mx br ar jp cn kr in za test example invalid local".split())
#: Words before a span that may be personal data.
_CONTACT = re.compile(r"(?i)(tel|phone|call|fax|mobile|cell|dial|ring|reach|contact|sms|text|whatsapp|mail|write|send|address)")
_GROUPS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
_DOTTED = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,4}(?:\.[0-9]{1,4}){2,4}(?![0-9A-Za-z])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans of each kind: leftmost, not overlapping within a kind, matches that fail their check dropped."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """High-recall candidates; they may overlap each other and base spans."""
    out = []
    if _AT.search(text):
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGITS.search(text):
        for m in _GROUPS.finditer(text):
            digits = sum("0" <= c <= "9" for c in m.group())
            if 7 <= digits <= 15:
                out.append(("phone", *m.span()))
            if 13 <= digits <= 19:
                out.append(("card", *m.span()))
        out += [("ip", *m.span()) for m in _DOTTED.finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span, without what the base checks decide on."""
    span, before, after = text[start:end], text[max(0, start - 24) : start].removesuffix("+"), text[end : end + 8]
    shape = "" if kind == "email" else span  # names are as long as they are
    groups = re.findall(r"[0-9]+", shape)
    sizes = [len(g) for g in groups] or [0]
    word = re.findall(r"[^\W\d_]+", before)
    prev, nxt = before.rstrip(" ")[-1:], after[:1]
    return [
        float(KINDS.index(kind)), float(len(shape)), float(sum(sizes)), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[0]), float(sizes[-1]),
        float("(" in shape), float(shape.count("-")), float(shape.count(".")), float(shape.count(" ")), float(max((int(g) for g in groups if len(g) <= 6), default=0)),
        float(len(word[-1]) if word else 0), float(prev.isalnum()), float(prev in ".,;:"), float(nxt.isalnum()), float(nxt in ".,;:"), float(before.endswith(" ")), float(bool(re.search(r"(?i)(tel|phone|call|fax|mobile|card|ip|mail|version|no\.|nr|id)\W*$", before))),
        *(_address(span) if kind == "email" else (0.0,) * 4),
    ]


def _address(span: str) -> tuple[float, ...]:
    """Features of a spelled-out address: its last label, its local part, brackets."""
    last, local = re.split(r"[^A-Za-z0-9-]+", span)[-1], re.match(r"[A-Za-z0-9._%+-]*", span).group()
    return float(last.lower() in _TLDS), float(len(last)), float(not local.isalpha()), float("(" in span or "[" in span)


def _form(span: str, kind: str) -> str:
    """What spans of a kind that may be real share: the last label, or where digits and separators stand (plain digits tell nothing)."""
    if kind == "email":
        return re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
    return re.sub("[0-9]", "0", span) if kind == "phone" and not span.isdigit() else ""


def rewritten(text: str, kind: str, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """(text around, start, end, label) of a base span in forms that only a generator proposes: label 1; for addresses also
    ordinary words of the text in such a form: label 0."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 16]
    forms: list[tuple[str, int]] = []
    if kind == "email":
        local, domain = span.split("@", 1)
        signs = [SPELLINGS[0], SPELLINGS[1 + zlib.crc32(span.encode()) % (len(SPELLINGS) - 1)]]
        forms = [(local + at + domain.replace(".", dot), 1) for at, dot in signs]
        if (name := re.match("[A-Za-z]*", local).group()) != local:  # a plain word, as in prose
            forms.append((name + " at " + domain.replace(".", " dot "), 1))
        words = re.findall(r"[A-Za-z]+", text[max(0, start - 80) : start].partition(" ")[2] + " " + text[end : end + 80].rpartition(" ")[0])
        forms += [(f"{x} at {y} dot {z}", 0) for x, y, z in list(zip(words[::3], words[1::3], words[2::3], strict=False))[:2]]
        forms = [(f, label) for f, label in forms if _SPELLED.fullmatch(f)]
    elif kind == "phone":
        rest = re.sub(r"^\+[0-9]{1,3}[\x20.-]+", "", span)
        if rest != span and _GROUPS.fullmatch(rest) and 7 <= sum(c.isdigit() for c in rest) <= 15:
            forms = [(rest, 1)]
    return [(before + f + after, len(before), len(before) + len(f), label) for f, label in forms]


class _Cover:
    """Disjoint spans in order; overlaps are found by halving, so a long text costs n log n."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def _covers(spans: list[tuple[str, int, int]]) -> dict[str, _Cover]:
    """A cover for each kind, whose spans are disjoint."""
    return {kind: _Cover(sorted((a, b) for k, a, b in spans if k == kind)) for kind in dict.fromkeys(k for k, _, _ in spans)}


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, x, y, form); a negative counts only if no positive has its form."""
    for batch in batches:
        out: list[tuple[str, list[float], int, str]] = []
        for raw in batch.column(0):
            text = raw.as_py().decode("utf-8", "replace")
            base = base_spans(text)
            covers = _covers(base)
            for kind, a, b in proposals(text):
                inside = [k for k, c in covers.items() if c.overlaps(a, b)]
                if inside and kind not in inside:
                    continue  # another kind's base span: no evidence either way
                if not inside and kind in ("email", "phone") and (_CONTACT.search(text, max(0, a - 24), a) or kind == "email" and ("(" in text[a:b] or "[" in text[a:b])):
                    continue  # may be real
                out.append((kind, features(text, kind, a, b), int(bool(inside)), _form(text[a:b], kind)))
            for kind, a, b in base:
                out += [(kind, features(t, kind, x, y), label, _form(t[x:y], kind)) for t, x, y, label in rewritten(text, kind, a, b)]
        columns = [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.float64()), pa.int32(), pa.string()), strict=True)], names=["kind", "x", "y", "form"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, tuple[boosting.BoostedTrees, float]]:
    """The trees and the threshold of each kind that the sample can teach."""
    picked = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = lake.text_bytes(docs, "doc_id").join(F.broadcast(picked.distinct()), "doc_id", "left_semi").select("text")  # at most sample_docs ids
    rows = lake.map_arrow(texts, _labelled, "kind string, x array<double>, y int, form string").orderBy(F.xxhash64("kind", "x", "y", "form"), "kind", "y", "form").limit(SAMPLE_SPANS).collect()  # of smallest hash, whichever task ends first
    rows.sort(key=lambda r: (r.kind, r.x, r.y))
    out = {}
    for kind in KINDS:
        mine = [r for r in rows if r.kind == kind]
        real = {r.form for r in mine if r.y} - {""}
        mine = [r for r in mine if r.y or r.form not in real]
        x, y = np.array([r.x for r in mine]), np.array([r.y for r in mine])
        if len(mine) < 4 or y.sum() < LEAST_POSITIVE or y.all():
            continue
        half = np.arange(len(y)) % 2 == 0
        if not 0 < y[half].sum() < half.sum():
            continue
        trees = boosting.BoostedTrees().fit(x[half], y[half].astype(float))
        p = trees.predict(x[~half])
        limit = boosting.calibrated(p, y[~half], PRECISION)
        if limit <= 1:
            if kind == "email":  # between the lowest score taken and the next, where addresses unlike the sample's lie
                limit = (limit + max(p[p < limit], default=limit)) / 2
            out[kind] = (trees, max(limit, 0.5))
    return out


def find_spans(text: str, model: dict[str, tuple[boosting.BoostedTrees, float]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) in order of start, then kind."""
    base = base_spans(text)
    added: list[tuple[str, int, int]] = []
    if model:
        scored, covers, taken = [], _covers(base), _Cover()
        open_ones = [c for c in proposals(text) if c[0] in model and not any(x.overlaps(*c[1:]) for x in covers.values())]
        for kind in dict.fromkeys(c[0] for c in open_ones):
            mine = [c for c in open_ones if c[0] == kind]
            trees, limit = model[kind]
            scored += [(-p, c) for p, c in zip(trees.predict(np.array([features(text, *c) for c in mine])).tolist(), mine, strict=True) if p >= limit]
        for _, c in sorted(scored):
            if not taken.overlaps(*c[1:]):
                taken.add(*c[1:])
                added.append(c)
    order = lambda s: (s[1], KINDS.index(s[0]))
    return sorted(base, key=order), sorted(base + added, key=order)


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span (overlapping ones joined) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def found(docs: DataFrame, carry: list[str], redact: bool = False, model: dict | None = None) -> DataFrame:
    """carry columns of docs, with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all of them), and with
    redact `clean`: the text without them (null where there are none); docs are then rows as packed by lake."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs) if model is None else model)  # a few trees
    counts = [f"n_{k}" for k in KINDS]
    schema = lake.schema(docs, carry, ", ".join([f"{c} long" for c in counts] + ["base_sha256 string", "spans string"] + ["clean string"] * redact))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            out: list[list] = [[] for _ in range(7)]
            for raw in textkit.texts(batch, "_raw"):
                text = raw.as_py() or ""
                base, every = find_spans(text, trees)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                row = [*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), redacted_text(text, every) if redact and every else None]
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            arrays = [pa.array(c, k) for c, k in zip(out, [pa.int64()] * 4 + [pa.string()] * 3, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + arrays[: 6 + redact], names=[*carry, *counts, "base_sha256", "spans", *(["clean"] if redact else [])])

    if not redact:
        docs = docs.select(*carry, F.col("text").alias("_raw"))
    return lake.map_arrow(docs, run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced by their kinds; the columns of docs."""
    out = found(lake.packed(docs), ["row"], redact=True, model=train(docs))
    return lake.unpacked(out, docs, F.coalesce("clean", "row.text"), F.col("clean").isNotNull())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(lake.table(spark, sf_dir, "documents"), ["doc_id"])
