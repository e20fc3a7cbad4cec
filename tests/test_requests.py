"""Requests against a server of the test, and the ledger of what was asked."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from panelkit.sources import requests
from panelkit.streaming import ledger


@pytest.fixture
def server():
    """Counts what it is asked. district 1 answers, 2 is empty, 3 fails once and then answers, 4 always fails, 5 is unknown."""
    asked = Counter()
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            with lock:
                asked[q["d"], q["y"]] += 1
                n = asked[q["d"], q["y"]]
            status = 503 if q["d"] == "4" or (q["d"] == "3" and n == 1) else 404 if q["d"] == "5" else 200
            data = [] if q["d"] == "2" else [{"district": q["d"], "year": q["y"], "price": 10.5}] * 2
            body = json.dumps({"output": {"type": "ok", "message": "", "data": data}}).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_every_combination_is_asked(spark, server):
    base, asked = server
    df = requests.ask(spark, base + "/p?d={district}&y={year}", {"district": "1,2,3,4,5,a b&c", "year": "2006..2008"}, requestsPerTask="4", pauses="0", timeout="10")
    rows = df.collect()
    got = {(r.request["district"], int(r.request["year"])): (r.status, r.tries, r.error) for r in rows}
    assert len(rows) == 18 and set(got) == {(d, y) for d in ("1", "2", "3", "4", "5", "a b&c") for y in (2006, 2007, 2008)}
    for y in (2006, 2007, 2008):
        assert got["1", y] == (200, 1, None) and got["3", y] == (200, 2, None) and got["4", y] == (503, 3, "HTTP 503") and got["5", y] == (404, 1, "HTTP 404") and got["a b&c", y][0] == 200
        assert asked["4", str(y)] == 3 and asked["5", str(y)] == 1 and asked["a b&c", str(y)] == 1
    assert df.rdd.getNumPartitions() == 5
    schema = "output struct<data: array<struct<district: string, year: int, price: double>>>"
    answered = spark.createDataFrame(rows, df.schema).select(F.inline(F.from_json("body", schema)["output"]["data"]))
    assert answered.count() == 3 * 3 * 2


def test_no_server_is_a_row(spark):
    r = requests.ask(spark, "http://127.0.0.1:9/{x}", {"x": "1"}, tries="2", pauses="0", timeout="2").first()
    assert r.status is None and r.tries == 2 and r.body is None and r.error
    assert requests.ask(spark, "http://127.0.0.1:9/{x}", {"x": ""}).count() == 0
    with pytest.raises(Exception, match="no values for y"):
        requests.ask(spark, "http://127.0.0.1:9/{x}{y}", {"x": "1"}).count()


def test_restarted_run_asks_nothing_twice(spark, server, tmp_path):
    base, asked = server
    landed, table, checkpoint = (str(tmp_path / n) for n in ("landed", "ledger", "checkpoint"))
    wanted = spark.createDataFrame([(d, y) for d in "12345" for y in ("2006", "2007")], "unit string, part string")
    count = F.size(F.from_json("body", "output struct<data: array<string>>")["output"]["data"])

    def run(units):
        """Ask what is outstanding, land the answers, and let the ledger follow."""
        known = ledger.read(spark, table) if (tmp_path / "ledger").exists() else spark.createDataFrame([], ledger.LEDGER)
        left = ledger.to_ask(wanted.where(F.col("unit").isin(*units)), known)
        answers = requests.ask_each(left.select(F.col("unit").alias("district"), F.col("part").alias("year")), base + "/?d={district}&y={year}", 2, pauses="0", tries="2")
        answers.select(F.col("request")["district"].alias("unit"), F.col("request")["year"].alias("part"), F.when(F.col("error").isNull(), count).alias("n")).write.mode("append").parquet(landed)
        stream = spark.readStream.schema("unit string, part string, n int").parquet(landed)
        ledger.follow(stream, table, checkpoint).awaitTermination()

    run("12")  # stopped after two of the units
    assert sum(asked.values()) == 4
    run("12345")
    first = dict(asked)
    assert all(asked[d, y] == 1 for d in "12" for y in ("2006", "2007"))
    state = {(r.unit, r.part): (r.state, r.asked, r.rows) for r in ledger.read(spark, table).collect()}
    assert {k: v[0] for k, v in state.items()} == {(d, y): {"1": "done", "2": "empty", "3": "done", "4": "failed", "5": "failed"}[d] for d in "12345" for y in ("2006", "2007")}
    run("12345")  # what is done or known to be empty is left alone; failures are asked again
    again = Counter(asked)
    again.subtract(first)
    assert {k for k, n in again.items() if n} == {(d, y) for d in "45" for y in ("2006", "2007")}
    state = {(r.unit, r.part): r.asked for r in ledger.read(spark, table).collect()}
    assert state["1", "2006"] == 1 and state["4", "2006"] == 2
    ledger.follow(spark.readStream.schema("unit string, part string, n int").parquet(landed), table, checkpoint).awaitTermination()
    assert {(r.unit, r.part): r.asked for r in ledger.read(spark, table).collect()} == state
