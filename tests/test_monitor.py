import pytest

from cuelake.streaming import monitor

BAD, OPEN = ("UNCLOSED_BREAK", "error"), ("BREAK_IN_PROGRESS", "info")


def run(name, at, ok=True, verdict="pass", errors=0, breaks=1, findings=(), fill=None, missed=None, passed=None):
    return (name, at, ok, verdict if ok else None, errors if ok else None, 0 if ok else None, breaks if ok else None, [{"code": c, "severity": s} for c, s in findings], fill, missed, passed)


ROWS = [
    run("down", 1), run("down", 2, ok=False), run("down", 3, ok=False), run("down", 4, ok=False), run("down", 5), run("down", 6, ok=False), run("down", 7),
    run("new", 1, findings=[OPEN]), run("new", 2, verdict="fail", errors=2, findings=[BAD, BAD, OPEN]), run("new", 3, verdict="fail", errors=1, findings=[BAD]), run("new", 4),
    run("gone", 1, breaks=3), run("gone", 2, breaks=0), run("gone", 3, breaks=2), run("fill", 1, fill=1.0), run("fill", 2, fill=0.5, missed=2), run("fill", 3, fill=0.55, passed=1, missed=0), run("fill", 4, fill=0.9),
    run("first", 1, verdict="fail", errors=1, findings=[BAD]),
]
WANT = {
    ("down", 3, "STREAM_UNREACHABLE"), ("down", 5, "STREAM_RECOVERED"), ("new", 2, "NEW_UNCLOSED_BREAK"), ("new", 2, "VERDICT_DEGRADED"), ("new", 4, "ERRORS_CLEARED"),
    ("gone", 2, "SIGNALLING_STOPPED"), ("gone", 3, "SIGNALLING_RESUMED"), ("fill", 2, "FILL_RATE_DROPPED"), ("fill", 2, "AVAILS_NOT_STITCHED"), ("fill", 3, "AVAILS_PASSED_THROUGH"), ("fill", 4, "FILL_RATE_RECOVERED"),
}


def test_batch_alerts(spark):
    found = monitor.alerts(spark.createDataFrame(ROWS, monitor.RUNS)).collect()
    assert {(x["monitor_id"], x["at"], x["code"]) for x in found} == WANT and len(found) == len(WANT)


def test_stream_gives_the_same_alerts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "runs")
    for k in range(1, 8):
        rows = [r for r in ROWS if r[1] == k]
        spark.createDataFrame(rows, monitor.RUNS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(monitor.RUNS).option("maxFilesPerTrigger", 100).parquet(source)
    query = monitor.alert_stream(stream).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(x["monitor_id"], x["at"], x["code"]) for x in spark.table("alerts").collect()} == WANT


def test_stuck_breaks_are_told_once(spark):
    known = spark.createDataFrame([("m", "event:1", 0, 0, 30.0, 0, 0), ("m", "event:9", 0, 0, None, 0, 1)], "monitor_id string, break_key string, first_seen long, last_seen long, signalled double, closed int, alerted int")
    seen = spark.createDataFrame([("m", "event:1", 1000, None, 0, 95.0, False), ("m", "event:2", 1000, None, 0, 100.0, False), ("m", "event:9", 1000, 10.0, 0, 500.0, False)], "monitor_id string, break_key string, at long, signalled double, closed int, edge_distance double, overrun boolean")
    store, told = monitor.stuck(known, seen, 1000)
    assert [x["break_key"] for x in told.collect()] == ["event:1"]
    rows = {x["break_key"]: x for x in store.collect()}
    assert rows["event:1"]["alerted"] == 1 and rows["event:1"]["signalled"] == 30.0 and rows["event:1"]["last_seen"] == 1000
    assert rows["event:9"]["signalled"] == 10.0 and rows["event:2"]["alerted"] == 0
    later, _ = monitor.stuck(known, seen, 1000 + monitor.BREAK_TTL_MS + 1)
    assert later.count() == 0


@pytest.mark.parametrize(("times", "polls", "ratio", "gap"), [(range(0, 3600, 60), 60, 1.0, 60), ([1800, 1860], 2, 2 / 60, 1740), ([0], 1, 1 / 60, 3600)])
def test_coverage(spark, times, polls, ratio, gap):
    runs = spark.createDataFrame([("m", t * 1000) for t in times], "monitor_id string, at long")
    row = monitor.poll_coverage(runs, 60.0, 3600.0, 3600.0).first()
    assert (row["polls"], row["expected"], row["longest_gap"]) == (polls, 60, gap) and abs(row["ratio"] - ratio) < 1e-9


def test_due_and_pruned(spark):
    monitors = spark.createDataFrame([("a", 1, 60, None), ("b", 1, 60, 50_000), ("c", 1, 60, 1), ("d", 0, 60, None)], "monitor_id string, enabled int, interval_seconds int, last_run_at long")
    assert sorted(x["monitor_id"] for x in monitor.due(monitors, 60_001).collect()) == ["a", "c"]
    runs = spark.createDataFrame([("m", k) for k in range(30)], "monitor_id string, at long")
    assert sorted(x["at"] for x in monitor.pruned(runs, 3).collect()) == [27, 28, 29]
