import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from newsloom.operators import feeds, fetch
from newsloom.sources import collector

RSS = b"<rss version='2.0'><channel><title>F</title><link>https://e.org/</link><item><title>One</title><guid>g</guid><link>/1</link></item></channel></rss>"


class Site(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        self.seen.append((self.path, self.headers.get("User-Agent")))
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/feed")
            self.end_headers()
            return
        tries = sum(p == self.path for p, _ in self.seen)
        status = 404 if self.path == "/gone" else 503 if self.path == "/busy" and tries < 3 else 200
        self.send_response(status)
        self.send_header("Content-Type", "application/rss+xml; charset=utf-8")
        self.end_headers()
        self.wfile.write(RSS)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_feeds_are_fetched_by_tasks(spark, site, tmp_path):
    spark.dataSource.register(collector.CollectorSource)
    urls = [f"{site}{p}" for p in ("/feed", "/moved", "/gone", "/busy")] + ["http://127.0.0.1:9/none"]
    df = spark.read.format("collector").options(urls=json.dumps(urls), agents='["a1", "a2"]', attempts="3", backoff="0.01", timeout="5").load()
    rows = {r.requested_url.rpartition("/")[2]: r for r in df.collect()}
    assert (rows["feed"].status, bytes(rows["feed"].content), rows["feed"].headers["content-type"]) == (200, RSS, "application/rss+xml; charset=utf-8")
    assert rows["moved"].final_url == f"{site}/feed" and rows["moved"].redirect_chain == [f"{site}/feed"]
    assert (rows["gone"].status, rows["gone"].error, rows["gone"].attempts) == (404, "http status 404", 1)
    assert (rows["busy"].status, rows["busy"].attempts, rows["busy"].error) == (200, 3, None)
    assert rows["none"].status is None and rows["none"].error and rows["none"].attempts == 3
    assert {a for _, a in Site.seen} == {"a1", "a2"}
    (tmp_path / "urls").write_text(f"{site}/feed\n\n")
    one = spark.read.format("collector").option("path", f"file://{tmp_path}/urls").load()
    assert fetch.normalize_fetches(one).first().content_type == "application/rss+xml"
    made = feeds.collect(one.selectExpr("'s' as source_id", "final_url as url", "content"))
    assert [r.guid for r in made.collect()] == ["g"]


def test_hosts_stay_together():
    urls = [f"https://h{k % 5}.org/{k}" for k in range(40)]
    parts = collector.CollectorReader({"urls": json.dumps(urls), "partitions": "3"}).partitions()
    hosts = [{u.split("/")[2] for u in p.urls} for p in parts]
    assert sum(map(len, hosts)) == 5 and sum(len(p.urls) for p in parts) == 40
    assert collector.CollectorReader({"urls": "[]"}).partitions()[0].urls == []
