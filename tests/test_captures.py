"""Keyed capture state as a stream against the batch fold and a plain one."""

import random
from datetime import datetime, timedelta

import pytest

from folioscope.streaming import captures

START = datetime(2024, 1, 1)
OF = "url string, number long, at timestamp, sha256 string, outcome string"


@pytest.fixture(scope="module")
def log():
    """Captures and failures of some URLs, some late; the last row of ``z`` moves the watermark past everything."""
    rng, rows = random.Random(21), []
    for n in range(300):
        at = START + timedelta(minutes=10 * n - rng.choice([0, 0, 0, 500]))
        failed = rng.random() < 0.3
        rows.append((f"u{rng.randrange(6)}", n, at, None if failed else rng.choice("ab"), rng.choice(["http_404", "http_410", "http_429", "timeout"]) if failed else None))
    return rows


def plain(rows):
    """The state after each row: (url, observed, sha256, unchanged, outcome, count)."""
    state, out = {}, []
    for url, _, at, sha, outcome in rows:
        seen, kept, unchanged, hold, count = state.get(url, (None, None, 0, None, None))
        if sha is None:
            if outcome in ("http_404", "http_410"):
                hold, count = outcome, count + 1 if hold == outcome else 1
        else:
            late = seen is not None and at < seen
            unchanged = 0 if late or kept != sha else unchanged + 1
            kept, seen, hold, count = kept if late and kept else sha, max(at, seen or at), None, None
        state[url] = (seen, kept, unchanged, hold, count)
        out.append((url, *state[url]))
    return out


def test_batch_fold_equals_a_plain_one(spark, log):
    got = {r.url: (r.observed, r.sha256, r.unchanged) for r in captures.folded(spark.createDataFrame(log, OF)).collect()}
    assert got == {row[0]: row[1:4] for row in plain(log)}


def test_stream_equals_the_fold_and_tells_what_is_overdue(spark, log, tmp_path):
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rocks)
    try:
        last = [*log, ("z", 300, START + timedelta(days=30), "a", None)]
        cuts = [last[:90], last[90:200], last[200:300], last[300:]]
        for part in cuts:
            spark.createDataFrame(part, OF).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(OF).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("at", "12 hours")
        initial = spark.createDataFrame([("only", START - timedelta(days=3), "q", 4)], "url string, observed timestamp, sha256 string, unchanged long")
        states = captures.capture_states(stream, timedelta(hours=36), initial)
        query = states.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
        query.awaitTermination(300)
        rows = spark.table("states").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(((r.url, r.observed, r.sha256, r.unchanged, r.hold_outcome, r.hold_count) for r in rows if not r.overdue), key=repr)
    assert got == sorted(plain(last), key=repr)
    overdue = [r.url for r in rows if r.overdue]
    assert set(overdue) >= {f"u{k}" for k in range(6)} and "z" not in overdue
    assert sum(not r.in_order for r in rows) > 0
