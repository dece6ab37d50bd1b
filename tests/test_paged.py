"""The paged source: whole sources pass, sources that are short, over-full, repeated or changed fail; retries; streams."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from folioforge.sources import paged


def _item(i, **more):
    return {"key": f"K{i}", "version": 1, "data": {"key": f"K{i}", "itemType": "note" if i % 5 == 4 else "book", "dateModified": "2020", "title": f"é {i}"} | more}


def _capture(folder, pages, size=10):
    for n, page in enumerate(pages):
        os.makedirs(f"{folder}/start={n * size}")
        with open(f"{folder}/start={n * size}/page.txt", "w", encoding="utf-8") as f:
            json.dump(page, f)
    return f"file://{folder}"


def _pages(n, size=10, total=None, version=1):
    return [{"total": n if total is None else total, "version": version, "items": [_item(i) for i in range(s, min(n, s + size))]} for s in range(0, n, size)]


def test_a_whole_source(spark, tmp_path):
    address = _capture(f"{tmp_path}/a", _pages(25))
    rows = paged.exact_read(spark, address, 10).orderBy("place").collect()
    assert [r.key for r in rows] == [f"K{i}" for i in range(25)] and rows[3].start == 0 and rows[24].start == 20
    assert json.loads(rows[7].data)["title"] == "é 7" and rows[4].item_type == "note"
    assert paged.registered(spark).read.format("paged").option("address", address).option("pageSize", 10).load().rdd.getNumPartitions() == 3
    assert [r.key for r in paged.top_level(paged.exact_read(spark, address, 10), 9).orderBy("place").collect()] == [f"K{i}" for i in range(11) if i % 5 != 4]
    assert paged.exact_read(spark, _capture(f"{tmp_path}/none", [{"total": 0, "items": []}]), 10).count() == 0


def _broken():
    short, over, repeated, changed, keyless, two = (_pages(25) for _ in range(6))
    short[1]["items"].pop()
    over[2]["items"].append(_item(99))
    repeated[2]["items"][0] = _item(3)
    changed[1]["total"] = 26
    del keyless[1]["items"][2]["key"], keyless[1]["items"][2]["data"]["key"]
    two[1]["items"][2]["key"] = "other"
    versions = _pages(25)
    versions[2]["version"] = 2
    return {"has 9 rows, not 10": short, "has 6 rows, not 5": over, "1 keys are repeated": repeated, "changed while it was read": changed, "has no key": keyless, "has two keys": two, "version 2": versions, "is not a list": [{"total": 5, "items": "x"}], "declares no total": [{"total": True, "items": []}], "declares None rows": _pages(25)[:2]}


@pytest.mark.parametrize("why", list(_broken()))
def test_broken_sources_fail(spark, tmp_path, why):
    address = _capture(f"{tmp_path}/b", _broken()[why])
    with pytest.raises(Exception, match=why):
        paged.exact_read(spark, address, 10).collect()


def test_retries_over_http(spark):
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            start = int(parse_qs(urlparse(self.path).query)["start"][0])
            seen[start] = seen.get(start, 0) + 1
            if seen[start] == 1 and start:
                self.send_response(503)
                self.end_headers()
                return
            self.send_response(404 if start == 20 and fail else 200)
            self.end_headers()
            self.wfile.write(json.dumps(_pages(25)[start // 10]).encode())

        def log_message(self, *a):
            return

    server, fail = HTTPServer(("127.0.0.1", 0), Handler), False
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}/items?format=json"
        assert paged.exact_read(spark, address, 10).count() == 25 and seen[10] == 2 and seen[20] == 2
        fail = True
        with pytest.raises(Exception, match="404"):
            paged.exact_read(spark, address, 10).collect()
    finally:
        server.shutdown()


def test_a_stream_reads_what_is_appended(spark, tmp_path):
    folder = f"{tmp_path}/s"
    address = _capture(folder, _pages(12))
    stream = lambda: paged.registered(spark).readStream.format("paged").option("address", address).option("pageSize", 10).load()
    run = lambda: stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    run()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 12
    for n, page in enumerate(_pages(25)):
        os.makedirs(f"{folder}/start={n * 10}", exist_ok=True)
        with open(f"{folder}/start={n * 10}/page.txt", "w", encoding="utf-8") as f:
            json.dump(page, f)
    run()
    got = [r.key for r in spark.read.parquet(f"file://{tmp_path}/out").orderBy("place").collect()]
    assert got == [f"K{i}" for i in range(25)]
