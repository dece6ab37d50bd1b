"""WARC archives: exact round trips, revisits, oversized payloads in chunks."""

import gzip
import hashlib

from folioforge.llm import warc

SCHEMA = "page_id long, url string, html string, size int, key string"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], SCHEMA)


def test_round_trip_matches_brute_force(spark):
    big = "é" * 400_000 + "\r\n\r\nWARC/1.1\r\n" + "x" * 300_000
    rows = [(9, "http://a/ b", "p" * 100), (3, None, "p" * 100), (4, "u", "p" * 99), (5, "u", "p" * 99), (6, "u", None), (7, "u", ""), (8, "u", big), (2, "u", big), (1, "u", "\x00\r\n\r\n" * 40)]
    got = {r.page_id: r for r in warc.round_trip(_pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, u, h in rows:
        data = (h or "").encode()
        first = min(k for k, _, x in rows if (x or "") == (h or ""))
        revisit = len(data) >= 100 and first != i
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
        assert got[i].record_type == ("revisit" if revisit else "response") and got[i].refers_to == (first if revisit else None)


def test_chunks_hold_the_payload_in_order(spark, tmp_path):
    big = "".join(chr(97 + i % 26) for i in range(warc.CHUNK * 2 + 17))
    folder = f"file://{tmp_path}/arc"
    manifest = warc.write_archives(warc.records(_pages(spark, [(1, "u", big), (2, "u", "small")])), folder)
    chunks = warc.read_archives(manifest).collect()
    assert max(len(c.data) for c in chunks) <= warc.CHUNK
    mine = sorted((c for c in chunks if c.key == 1), key=lambda c: c.chunk_no)
    assert len(mine) > 2 and b"".join(c.data for c in mine).decode() == big
    for i, c in enumerate(mine):
        sofar = b"".join(x.data for x in mine[: i + 1])
        assert c.size_so_far == len(sofar) and c.sha256_so_far == hashlib.sha256(sofar).hexdigest() and c.is_last == (i == len(mine) - 1)
    data = b"".join(gzip.open(r.archive.removeprefix("file://")).read() for r in manifest.collect())
    assert data.count(b"WARC/1.1\r\n") == 2 and sum(r.records for r in manifest.collect()) == 2


def test_empty_repeated_and_null_rows(spark):
    assert warc.round_trip(_pages(spark, [])).count() == 0
    text = "same " * 50
    got = warc.round_trip(_pages(spark, [(1, "u", text), (1, "u", text), (None, None, text), (3, "u", text)])).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("1", "response", None), ("1", "response", None), ("3", "revisit", 1), ("None", "response", None)]


def test_one_key_with_several_payloads(spark):
    a, b = "a" * 200, "b" * 200
    rows = [(0, "u", a), (1, "u", a), (1, "u", b), (1, "u", a), (2, "u", b), (2, "u", a), (2, "u", b), (None, "u", b), (None, "u", "c" * 200)]
    records = warc.round_trip(_pages(spark, rows).repartition(3)).collect()
    digest = {hashlib.sha256(x.encode()).hexdigest(): x[0] for x in (a, b, "c" * 200)}
    got = sorted((str(r.page_id), digest[r.payload_digest], r.record_type, r.refers_to) for r in records)
    want = [("0", "a", "response", None), ("1", "a", "revisit", 0), ("1", "a", "revisit", 0), ("1", "b", "response", None), ("2", "a", "revisit", 0)]
    want += [("2", "b", "revisit", 1), ("2", "b", "revisit", 1), ("None", "b", "response", None), ("None", "c", "response", None)]
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], str(x[3]))) and len({r.record_id for r in records}) == len(rows)
