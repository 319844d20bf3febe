import gzip
import hashlib
import io
import json

from roomgraph.llm import warc

SCHEMA = "page_id long, url string, html string, sha1 string, n long"


def test_round_trip_is_exact(spark):
    long = "<p>\r\n\r\nWARC/1.1 é</p>" * 40000
    rows = [(3, "http://a\r\nb/é", "same"), (1, None, "same"), (2, "u", ""), (5, "u", None), (9, "u", long), (8, "v", long),
            (None, "w", "same"), (None, "w", "alone"), (7, "x", "twice"), (7, "x", "twice"), (6, "y", "sa")]
    got = warc.round_trip(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    firsts = {}
    for key, _, html in rows:
        p = (html or "").encode()
        firsts[p] = min([k for k in (firsts.get(p), key) if k is not None], default=None)
    want = []
    for key, url, html in rows:
        p = (html or "").encode()
        again = firsts[p] is not None and firsts[p] != key
        want.append((key, url or "", "revisit" if again else "response", firsts[p] if again else None, len(p), None if again else p))
    order = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in got), key=order) == sorted(want, key=order)


def test_small_payloads_are_all_stored(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = warc.round_trip(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), least_bytes=3).collect()
    assert sorted((r.page_id, r.refers_to) for r in got) == [(1, None), (2, None), (3, None), (4, 3)]


def test_monolithic_stream_becomes_members(spark, tmp_path):
    recs = [warc._record(i, "u", b"x" * i * 1000, None) for i in range(5)]
    raw = tmp_path / "in.warc.gz"
    raw.write_bytes(gzip.compress(b"".join(recs[:3])) + gzip.compress(b"".join(recs[3:])))
    tidy = str(tmp_path / "tidy")
    kept = warc.normalise(spark.createDataFrame([(str(raw), 5)], warc.ARCHIVES), tidy).collect()
    assert [r.n_records for r in kept] == [5]
    data = open(kept[0].archive, "rb").read()
    assert gzip.decompress(data) == b"".join(recs)
    for line, rec in zip(open(kept[0]["index"]), recs, strict=True):
        at = json.loads(line)
        assert gzip.GzipFile(fileobj=io.BytesIO(data[at["offset"]:at["offset"] + at["length"]])).read() == rec
    assert hashlib.sha1(b"").hexdigest()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
