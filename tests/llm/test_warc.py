import hashlib
from collections import defaultdict

from crossbook.llm import lake, warc

PAGES = "page_id long, url string, html string, payload_digest string, original long"


def resolved(spark, rows):
    df = warc.resolved(warc.headers(spark.createDataFrame([(*r, "x", 9) for r in rows], PAGES)))
    return warc.read(spark, warc.write(df, lake.new_path(spark, "warc")))


def test_round_trip_and_revisits(spark):
    long, other = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100, "y" * 1000
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other[:-1]), (None, "u", other), (10, "u", "z" * 17_000_000), (11, "u", "\r\n\r\n")]
    got = {r.page_id: r for r in resolved(spark, rows).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    for p, _, h in rows:
        raw, r = (h or "").encode(), got[p]
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(raw) >= 1000 and p != top
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None)
        assert r.payload == (None if revisit else raw)
    assert got[1].url == "http://a/%0D%0AX: y" and got[2].url is None


def test_repeated_rows_and_empty(spark):
    rows = [(1, "u", "a" * 2000), (1, "u", "a" * 2000), (0, "u", "a" * 2000)]
    assert sorted((r.page_id, r.record_type) for r in resolved(spark, rows).collect()) == [(0, "revisit"), (1, "response"), (1, "response")]
    assert resolved(spark, []).count() == 0


def test_archives_are_members_of_one_record(spark, monkeypatch):
    """Every record is a gzip member; many rows of members make an archive; revisits name what they refer to."""
    import glob
    import gzip
    from datetime import datetime

    monkeypatch.setattr(warc, "CHUNK_BYTES", 2000)
    rows = [(i, f"http://h/{i}", ("same" * 300 if i % 3 else f"{i}-" * 400), datetime(2025, 1, 1 + i % 9)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, fetched_at timestamp").coalesce(1)
    path = warc.write(warc.resolved(warc.headers(pages)), lake.new_path(spark, "warc"))
    files = [open(x, "rb").read() for x in glob.glob(f"{path}/part-*")]
    assert len(files) > 1
    members = [m for f in files for m in warc._members(memoryview(f))]
    assert len(members) == 60 and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and m.count(b"WARC-Type") == 1 for m in members)
    assert sorted(b"".join(map(gzip.decompress, files)).split(b"WARC/1.1\r\n")[1:]) == sorted(m[10:] for m in members)
    field = lambda m: dict(x.split(b": ", 1) for x in m.split(b"\r\n\r\n")[0].split(b"\r\n")[1:])
    heads = [field(m) for m in members]
    top = next(h for h in heads if h[b"WARC-Page-ID"] == b"59")
    assert top[b"WARC-Date"] == b"2025-01-06T00:00:00Z"
    revisits = [h for h in heads if h[b"WARC-Type"] == b"revisit"]
    assert len(revisits) == 39
    assert {(h[b"WARC-Refers-To"], h[b"WARC-Refers-To-Target-URI"], h[b"WARC-Refers-To-Date"]) for h in revisits} == {(top[b"WARC-Record-ID"], b"http://h/59", top[b"WARC-Date"])}
    assert len({h[b"WARC-Record-ID"] for h in heads}) == 60
