"""The store on disk, a poll as a whole over a stream, and the life of breaks."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.streaming import lifecycle, monitor, poll
from cuelake.streaming.buckets import Buckets

HOUR = 3600 * 1000


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = Buckets(spark, f"file://{tmp_path}/t", "name string, at long, value double", ("name", "at"), 8)
    assert table.read().count() == 0
    rows = spark.createDataFrame([(f"m{k}", 1, float(k)) for k in range(40)], "name string, at long, value double")
    table.upsert(rows)
    before = files(tmp_path / "t")
    change = spark.createDataFrame([("m3", 1, -1.0), ("m3", 2, 7.0)], "name string, at long, value double")
    table.upsert(change)
    after = files(tmp_path / "t")
    kept = {p.parent for p in before} - {p.parent for p in before if p not in after}
    assert len(kept) == 7 and all(before[p] == after[p] for p in before if p.parent in kept)
    want = {(f"m{k}", 1, -1.0 if k == 3 else float(k)) for k in range(40)} | {("m3", 2, 7.0)}
    assert set(map(tuple, table.read().collect())) == want
    table.add(spark.createDataFrame([("m3", 2, 99.0), (None, 5, 1.0)], "name string, at long, value double"))
    table.add(spark.createDataFrame([("m3", 2, 99.0)], "name string, at long, value double"))
    assert set(map(tuple, table.read().collect())) == want | {(None, 5, 1.0)}
    table.delete(rows.select("name"))
    assert list(map(tuple, table.read().collect())) == [(None, 5, 1.0)]


def test_a_change_that_was_cut_off(spark, tmp_path):
    """One that was written whole is applied by whoever opens the table next; another one never was."""
    open_ = lambda: Buckets(spark, f"file://{tmp_path}/t", "name string, value int", ("name",), 4)
    first = open_()
    first.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "name string, value int"))
    first._settle = lambda: None
    first.upsert(spark.createDataFrame([("a", 2)], "name string, value int"))
    assert dict(first.read().collect())["a"] == 1
    assert dict(open_().read().collect()) == {"a": 2, "b": 1}
    first.upsert(spark.createDataFrame([("a", 3)], "name string, value int"))
    (tmp_path / "t.change" / "_SUCCESS").unlink()
    assert dict(open_().read().collect()) == {"a": 2, "b": 1} and not (tmp_path / "t.change").exists()


def test_a_change_is_moved_and_goes_on_where_it_was_cut_off(spark, tmp_path):
    """Rows are written once: the files of a change become those of the table, bucket by bucket; an empty table costs no job."""
    schema = "name string, value int"
    table = Buckets(spark, f"file://{tmp_path}/t", schema, ("name",), 4)
    assert "LocalRelation <empty>" in table.read()._jdf.queryExecution().optimizedPlan().toString()
    old = spark.createDataFrame([(f"m{k}", 1) for k in range(20)], schema)
    table.upsert(old)
    table._settle = lambda: None
    table.upsert(old.withColumn("value", F.lit(2)))
    made = {p.relative_to(tmp_path / "t.change") for p in (tmp_path / "t.change").rglob("*.parquet")}
    first = sorted(p.parent.name for p in made)[0]
    for p in (tmp_path / "t" / first).iterdir():
        p.unlink()
    (tmp_path / "t" / first).rmdir()
    (tmp_path / "t.change" / first).rename(tmp_path / "t" / first)  # the driver was lost here
    again = Buckets(spark, f"file://{tmp_path}/t", schema, ("name",), 4)
    assert {p.relative_to(tmp_path / "t") for p in (tmp_path / "t").rglob("*.parquet")} == made and not (tmp_path / "t.change").exists()
    assert {(x["name"], x["value"]) for x in again.read().collect()} == {(f"m{k}", 2) for k in range(20)}


def polled(name, at, ok=True, verdict="pass", errors=0, findings=(), breaks=(), output=None, missed=None, fill=None):
    return (
        name, at, ok, None if ok else "timed out", verdict if ok else None, errors, 0, 0, len(breaks), "hls", [{"code": c, "severity": s} for c, s in findings],
        [dict(zip(("break_key", "signalled", "closed", "edge_distance"), b, strict=True)) for b in breaks], output, None if output in (True, None) else "404", fill, None, None, missed, None,
    )


BAD = ("UNCLOSED_BREAK", "error")
BATCHES = [
    [polled("a", 1), polled("b", 1, fill=1.0, output=True), polled("c", 1, ok=False), polled("d", 1, breaks=[("event:1", 30.0, 0, 80.0)])],
    [polled("a", 2, verdict="fail", errors=1, findings=[BAD, BAD]), polled("b", 2, output=False), polled("c", 2, ok=False), polled("d", 2, breaks=[("event:1", None, 0, 95.0)])],
    [polled("a", 3), polled("a", 3), polled("b", 3, output=True, fill=0.5, missed=2), polled("c", 3), polled("d", 3, breaks=[("event:1", 30.0, 0, 200.0)]), polled("d", 4, breaks=[("event:1", 30.0, 1, 210.0)])],
    [polled("c", 2, ok=True), polled("d", 5, breaks=[("event:2", None, 0, 121.0), ("event:3", None, 0, None)])],
]
WANT = {
    ("a", 2, "NEW_UNCLOSED_BREAK"), ("a", 2, "VERDICT_DEGRADED"), ("a", 3, "ERRORS_CLEARED"), ("b", 2, "PIPELINE_OUTPUT_UNREACHABLE"), ("b", 3, "AVAILS_NOT_STITCHED"), ("c", 2, "STREAM_UNREACHABLE"),
    ("c", 3, "STREAM_RECOVERED"), ("d", 2, "BREAK_STUCK_OPEN"), ("d", 5, "BREAK_STUCK_OPEN"),
}


def stored(store):
    return {(x["monitor_id"], x["at"], x["code"]) for x in store.alerts.read().collect()}


def test_polls_of_a_stream_are_done_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    store = poll.Store(spark, f"{base}/store", 4)
    names = [(x, f"http://h/{x}", f"the {x}", 60, 1, "http://hook" if x == "d" else None, None, 0) for x in "abcd"]
    store.create(spark.createDataFrame(names, "monitor_id string, url string, label string, interval_seconds int, enabled int, webhook_url string, stitched_url string, created_at long"))
    schema = poll.POLLS.replace(": ", ":")
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/polls")
        stream = spark.readStream.schema(schema).parquet(f"{base}/polls")
        poll.watch(stream, store, f"{base}/checkpoint").awaitTermination()
        if k == 1:  # a driver that was lost before the batch was noted does it again
            before = sorted(map(str, store.alerts.read().collect())), sorted(map(str, store.runs.read().collect())), sorted(map(str, store.breaks.read().collect()))
            poll.poll_batch(store, spark.createDataFrame(rows, schema), "again")
            assert before == (sorted(map(str, store.alerts.read().collect())), sorted(map(str, store.runs.read().collect())), sorted(map(str, store.breaks.read().collect())))
            assert poll.poll_batch(store, spark.createDataFrame(rows, schema), "polls-0") is None
    assert stored(store) == WANT
    assert store.runs.read().count() == 4 + 4 + 5 + 1
    lost = store.alerts.read().where("code = 'PIPELINE_OUTPUT_UNREACHABLE'").first()
    assert (lost["severity"], lost["detail"]) == ("warning", "404")
    assert store.alerts.read().where("at = 2 and code = 'BREAK_STUCK_OPEN'").first()["detail"] == "Break event:1"
    marks = {x["monitor_id"]: (x["last_run_at"], x["consecutive_failures"]) for x in store.monitors.read().collect()}
    assert marks == {"a": (3, 0), "b": (3, 0), "c": (3, 0), "d": (5, 0)}
    told = poll.messages(store.alerts.read(), store.monitors.read()).orderBy("at").collect()
    assert [x["at"] for x in told if "BREAK_STUCK_OPEN" in x["payload"]] == [2, 5] and all(x["monitor_id"] == "d" for x in told)
    assert '"text":"ERROR: the d\\nhttp://h/d\\n\\n- error BREAK_STUCK_OPEN: Break event:1"' in told[0]["payload"]
    store.acknowledge(store.alerts.read().where("monitor_id = 'a'"))
    assert {x["monitor_id"] for x in store.alerts.read().where("acknowledged = 1").collect()} == {"a"}
    store.patch(spark.createDataFrame([("a", "new name", 30), ("zz", "nobody", 1)], "monitor_id string, label string, interval_seconds int"))
    rows = {x["monitor_id"]: x for x in store.monitors.read().collect()}
    assert (rows["a"]["label"], rows["a"]["interval_seconds"], rows["a"]["url"], rows["b"]["interval_seconds"]) == ("new name", 30, "http://h/a", 60) and len(rows) == 4
    store.delete(spark.createDataFrame([("a",), ("d",)], "monitor_id string"))
    for table in (store.monitors, store.runs, store.alerts, store.breaks):
        assert {x["monitor_id"] for x in table.read().collect()} <= {"b", "c"}


def random_polls(seed):
    r = random.Random(seed)
    rows, at = [], dict.fromkeys("xyz", 0)
    for _ in range(150):
        name = r.choice("xyz")
        at[name] += r.choice((60_000, HOUR, 5 * HOUR, 7 * HOUR))
        seen = r.sample(range(6), r.randrange(0, 4))
        breaks = [(f"event:{k}", r.choice((None, 30.0, 100.0)), int(r.random() < 0.2), r.choice((None, 50.0, 95.0, 170.0))) for k in seen]
        rows.append((name, at[name], r.random() < 0.1, [dict(zip(("break_key", "signalled", "closed", "edge_distance"), b, strict=True)) for b in breaks]))
    return rows


SEEN = "monitor_id string, at long, overrun boolean, breaks array<struct<break_key:string,signalled:double,closed:int,edge_distance:double>>"


@pytest.mark.parametrize("seed", [1, 2])
def test_lives_of_breaks_are_those_of_one_poll_after_another(spark, seed):
    """``monitor.stuck`` on each poll in turn, against the streamed batch; in two halves it is the same."""
    rows = random_polls(seed)
    table, told = {}, set()  # the rules of ``stuck``, in plain terms
    for name, at, overrun, breaks in sorted(rows, key=lambda x: (x[0], x[1])):
        for b in breaks:
            old = table.get((name, b["break_key"]), [at, at, None, 0, 0])
            table[name, b["break_key"]] = [old[0], at, old[2] if b["signalled"] is None else b["signalled"], max(old[3], b["closed"]), old[4]]
        for b in breaks:
            state = table[name, b["break_key"]]
            if not overrun and not b["closed"] and not state[3] and not state[4] and b["edge_distance"] is not None and b["edge_distance"] > (60.0 if state[2] is None else state[2]) + 60.0:
                state[4] = 1
                told.add((name, at, b["break_key"]))
        table = {k: v for k, v in table.items() if k[0] != name or v[1] >= at - monitor.BREAK_TTL_MS}
    frame = spark.createDataFrame(rows, SEEN).repartition(3)
    known = spark.createDataFrame([], lifecycle.STORED)
    store, late = lifecycle.replayed(frame, known)
    assert {(x["monitor_id"], x["at"], x["break_key"]) for x in late.collect()} == told and told
    assert {(x[0], x[1]): list(x)[2:] for x in map(tuple, store.collect())} == table
    half = 40 * HOUR
    store, early = lifecycle.replayed(frame.where(F.col("at") < half), known)
    store, late = lifecycle.replayed(frame.where(F.col("at") >= half), store)
    assert {(x["monitor_id"], x["at"], x["break_key"]) for x in early.union(late).collect()} == told
    assert {(x[0], x[1]): list(x)[2:] for x in map(tuple, store.collect())} == table
    assert lifecycle.replayed(frame.limit(0), known)[1].count() == 0


def test_lives_of_breaks_on_a_stream(spark, tmp_path):
    """The same over a stream that is stopped and started again, with repeated polls; silence frees what is known."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [x for x in random_polls(3) if x[1] < 60 * HOUR]
    known = spark.createDataFrame([], lifecycle.STORED)
    want = {(x["monitor_id"], x["at"], x["break_key"]) for x in lifecycle.replayed(spark.createDataFrame(rows, SEEN), known)[1].collect()}
    base = f"file://{tmp_path}"

    def go(part):
        spark.createDataFrame(part, SEEN).coalesce(1).write.mode("append").parquet(f"{base}/polls")
        stream = lifecycle.stuck_stream(spark.readStream.schema(SEEN).parquet(f"{base}/polls"), "60 hours")
        out = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
        out.awaitTermination()
        return {(x["monitor_id"], x["at"], x["break_key"]) for x in spark.read.parquet(f"{base}/out").collect()}

    cut = 30 * HOUR
    go([x for x in rows if x[1] < cut])
    assert go([x for x in rows if x[1] >= cut] + rows[:5]) == want and want
    open_ = [{"break_key": "event:77", "signalled": None, "closed": 0, "edge_distance": 500.0}]
    week = lifecycle.SILENT_MS
    go([("s", 61 * HOUR, False, open_)])
    go([("other", 61 * HOUR + 2 * week, False, [])])  # the watermark moves on
    go([("other", 61 * HOUR + 2 * week + 1, False, [])])
    found = go([("s", 61 * HOUR + 2 * week + 2, False, open_)])
    assert {x[1] for x in found if x[0] == "s"} == {61 * HOUR, 61 * HOUR + 2 * week + 2}


@pytest.mark.parametrize("streamed", [False, True])
def test_coverage_of_sliding_windows(spark, tmp_path, streamed):
    minutes = {"m": [0, 1, 2, 3, 15, 16, 41, 59, 60, 61], "n": [30]}
    rows = [(k, t * 60_000) for k, x in minutes.items() for t in x]
    runs = spark.createDataFrame(rows, "monitor_id string, at long")
    if streamed:
        base = f"file://{tmp_path}"
        far = spark.createDataFrame([("late", 10**9)], runs.schema)
        for k, part in enumerate((runs.where("at < 1000000"), runs.where("at >= 1000000"), far)):
            part.coalesce(1).write.mode("append").parquet(f"{base}/runs")
            stream = monitor.sliding_coverage(spark.readStream.schema(runs.schema).parquet(f"{base}/runs"), 60, 1800, 600, "1 hour")
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(f"{base}/out").where("monitor_id <> 'late'")
    else:
        found = monitor.sliding_coverage(runs, 60, 1800, 600)
    want = set()
    for name, x in minutes.items():
        for end in range(600, 6000, 600):
            own = [t * 60 for t in x if end - 1800 <= t * 60 < end]
            if own:
                gaps = [b - a for a, b in zip([end - 1800 + 60, *own], [*own, end], strict=True)]
                want.add((name, end * 1000, len(own), 30, round(min(1.0, len(own) / 30), 9), max(0, max(gaps))))
    assert {(x["monitor_id"], x["until"], x["polls"], x["expected"], round(x["ratio"], 9), x["longest_gap"]) for x in found.collect()} == want
