"""WARC archives: round trip, revisits against a brute-force walk, odd rows."""

import glob
import gzip
import hashlib
import re

import duckdb
import pytest

from waymark.llm import queries, warc

SF = "/root/testdata/sf0.001"
LONG = "<p>" + "x" * 2_000_000 + "\r\n\r\nWARC/1.1\r\n</p>"
SAME = "<p>" + "the same payload in many records " * 5 + "</p>"
PAGES = [(5, "http://a/5", SAME), (3, "http://a/3", SAME), (9, None, SAME), (None, "http://a/\r\nx: y", SAME), (3, "http://a/3", SAME), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", LONG), (8, "é", LONG), (None, None, None), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "y" * 99), (13, "u", "y" * 99)]


def walked(rows):
    """What is asked for, by one walk over the rows in order of id."""
    first, out = {}, []
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        if len(payload) >= 100 and payload in first:
            out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit", first[payload]))
        else:
            first[payload] = i
            out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "response", None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_file", [2, 1000])
def test_archives_round_trip_with_revisits(spark, tmp_path, per_file):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS archive", "'x' AS Payload_Digest", "2 AS n")
    raw, clean = f"file://{tmp_path}/raw", f"file://{tmp_path}/clean"
    warc.write_archives(pages, raw, records_per_file=per_file)
    first = warc.read_archives(spark, raw, payloads=True).collect()
    assert sorted((r["page_id"] or "", bytes(r["payload"])) for r in first) == sorted((str(p[0]) if p[0] is not None else "", (p[2] or "").encode()) for p in PAGES)
    assert {r["url"] for r in first} == {"" if u is None else u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in PAGES}
    assert len({r["record_id"] for r in first}) == len(PAGES)
    warc.deduplicate(spark, raw, clean, records_per_file=per_file)
    got = warc.resolve(warc.read_archives(spark, clean)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == walked(PAGES) and all(r["intact"] for r in got)
    stored = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{tmp_path}/clean/*.gz")))
    assert stored.count(SAME.encode()) == 1 and stored.count(LONG.encode()) == 1  # payloads of revisits are gone
    for head in re.findall(rb"WARC-Type: revisit.*?\r\n\r\n", stored, re.S):
        assert all(f in head for f in (b"WARC-Profile: http", b"WARC-Refers-To: <urn:uuid:", b"WARC-Refers-To-Date: ", b"WARC-Payload-Digest: sha256:", b"WARC-Block-Digest: sha256:"))


def test_revisit_without_original_is_not_intact(spark):
    rows = [("a", 0, "revisit", "<1>", "7", "u", "d", None, "ff", "<9>"), ("a", 1, "response", "<2>", "8", "u", "d", 3, "aa", None), ("a", 2, "revisit", "<3>", "9", "u", "d", None, "bb", "<2>")]
    got = {r["page_id"]: tuple(r)[1:] for r in warc.resolve(spark.createDataFrame(rows, warc.HEADER_SCHEMA)).collect()}
    assert got == {7: (None, "ff", "revisit", None, False), 8: (3, "aa", "response", None, True), 9: (3, "bb", "revisit", 8, False)}


def test_damaged_archives_are_refused(tmp_path):
    import io

    for raw in (b"junk", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(gzip.compress(raw))))


def test_empty_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/raw")
    warc.deduplicate(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/clean")
    assert warc.resolve(warc.read_archives(spark, f"file://{tmp_path}/clean")).collect() == []


def test_query_matches_oracle(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = queries.op12_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(queries.ORACLES["op12_warc"]).fetchall())
