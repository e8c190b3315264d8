"""Polls by tasks: failover, back-off, and batches that give the same rows when they run again."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from newsloom.sources import web


@pytest.fixture
def site():
    """Pages that count how often they were asked; /down never answers, /late not before its third time."""
    asked = {}

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            n = asked[self.path] = asked.get(self.path, 0) + 1
            ok = self.path != "/down" and (self.path != "/late" or n >= 3)
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(f"{self.path} {n}".encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def rows_of(reader, start, end):
    return sorted(row for p in reader.partitions(start, end) for row in reader.read(p))


def test_failover_backoff_and_replay(site, tmp_path):
    base, asked = site
    options = {"urls": f"{base}/a {base}/down|junk|{base}/b {base}/late {base}/down", "log": str(tmp_path / "log"), "timeout": "5"}
    reader = web.WebStream(options)
    seen, at = [], reader.initialOffset()
    for _ in range(6):
        end = reader.latestOffset()
        assert end["poll"] > at["poll"] and len(reader.partitions(at, end)) == len(end["ask"])
        first = rows_of(reader, at, end)
        assert first == rows_of(web.WebStream(options), at, end)  # another reader after a restart
        seen.append((end, [(u.removeprefix(base), b) for u, b in first]))
        reader.commit(end)
        at = end
    assert seen[0] == ({"poll": 1, "ask": [0, 1, 2, 3]}, [("/a", "/a 1"), ("/b", "/b 1")])
    assert [e["ask"] for e, _ in seen] == [[0, 1, 2, 3], [0, 1], [0, 1, 2, 3], [0, 1], [0, 1], [0, 1]]
    assert seen[2][1] == [("/a", "/a 3"), ("/b", "/b 3")] and asked["/a"] == 6 and asked["/late"] == 2
    assert reader.latestOffset()["ask"] == [0, 1, 2, 3]  # four polls after the second failure
    assert max(len(reader._polls(n)) for n in range(4)) <= 2


def test_addresses_that_all_fail_are_asked_when_the_first_is_due(site, tmp_path):
    base, asked = site
    reader = web.WebStream({"urls": f"{base}/down junk", "log": f"file://{tmp_path}/log", "timeout": "5"})
    at, polls = reader.initialOffset(), []
    for _ in range(4):
        end = reader.latestOffset()
        assert rows_of(reader, at, end) == []
        polls.append(end["poll"])
        at = end
    assert polls == [1, 3, 7, 15] and asked["/down"] == 4
    assert web.WebStream({"urls": "", "log": str(tmp_path / "none")}).partitions({"poll": 0, "ask": []}, {"poll": 1, "ask": []}) == []


def test_stream_fetches_in_tasks(spark, site, tmp_path):
    base, asked = site
    web.register(spark)
    stream = spark.readStream.format("newsloom_web").option("urls", f"{base}/a {base}/down|{base}/b").option("log", str(tmp_path / "log")).load()
    sizes = []

    def write(batch, n):
        sizes.append(batch.rdd.getNumPartitions())
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))

    for _ in range(2):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.url.removeprefix(base), r.body, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [r[:1] + r[2:] for r in got] == [("/a", 0), ("/a", 1), ("/b", 0), ("/b", 1)] and set(sizes) == {2}
    assert len({r[1] for r in got}) == 4 and asked["/a"] == 2
    # mirrors in a batch read
    assert [r.url for r in spark.read.format("newsloom_web").option("urls", f"{base}/down|{base}/b").load().collect()] == [f"{base}/b"]
