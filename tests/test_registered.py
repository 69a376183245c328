"""Registered queries that SQL doesn't check, and the contract of the entry module."""

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_greedy_matches_are_those_of_a_loop(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        by.setdefault(r["user_id"], []).append(r)
    want = set()
    for user, events in by.items():
        free = [r for r in events if r["event_type"] == "purchase"]
        for s in (r for r in events if r["event_type"] == "signup"):
            near = sorted((abs((p["ts"] - s["ts"]).total_seconds()), p["event_id"]) for p in free)
            if near and near[0][0] <= 21600:
                want.add((user, s["event_id"], near[0][1]))
                free = [p for p in free if p["event_id"] != near[0][1]]
    found = __spark_entry__.queries()["pipeline_greedy"](spark, SF)
    assert {(x["user_id"], x["left_id"], x["right_id"]) for x in found.collect()} == want and want
