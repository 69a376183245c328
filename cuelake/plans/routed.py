"""Whole analyses over tables and documents that Spark renders from the order and event tables, with SQL that says what each must find."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import splice
from cuelake.functions.text import resolve_uri
from cuelake.operators.findings import grouped
from cuelake.operators.pairing import paired
from cuelake.plans import dash, hls, policy, remote, stitching, vast
from cuelake.plans.onepath import OnePath
from cuelake.plans.rendered import _SEGMENTS, playlists
from cuelake.plans.rendered import ORACLE_SQL as _RENDERED
from cuelake.runtime import dropped, settled, shared_folder, written
from cuelake.sources import scte104, segments
from cuelake.streaming import lifecycle, monitor, poll, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_code(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"))


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


# Stitched output: a customer's orders are the avails of a feed, ten minutes apart; what was stitched for an order with
# line items comes (items modulo 9) seconds late and is as long as they cost.

_STITCH = """
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
li AS (SELECT l_orderkey, count(*) AS n, CAST(round(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0) AS BIGINT) AS got FROM lineitem GROUP BY l_orderkey),
a AS (SELECT o.o_custkey, o.i, o.o_orderstatus, CAST(round(o.o_totalprice) AS BIGINT) AS want, li.got, li.n % 9 AS late, li.n % 9 <= 6 AS met FROM o LEFT JOIN li ON l_orderkey = o_orderkey),
s AS (SELECT *, CASE WHEN NOT coalesce(met, false) THEN 'not-stitched' WHEN o_orderstatus = 'P' THEN 'passthrough' WHEN abs(got - want) <= 0.5 THEN 'filled' WHEN got < want THEN 'under-filled' ELSE 'over-filled' END AS status FROM a)"""


def _stitched(spark: SparkSession, sf_dir: str) -> stitching.Comparison:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.round(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("got")
    )
    place = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("i")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", place)
    rows = written(orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left"))  # both sides are made of it
    none = lambda kind: F.lit(None).cast(kind)
    at = F.col("i") * 600_000.0

    def side(rows: DataFrame, name: str, pdt, signalled, actual, marked, uris) -> DataFrame:
        return rows.select(
            F.concat(F.lit(name), F.col("o_custkey").cast("string")).alias("doc_id"), F.col("i").alias("index"), (pdt / 1000).alias("start_time"), pdt.alias("pdt"),
            none("long").alias("event_id"), none("int").alias("segmentation_type"), signalled.alias("signalled_duration"), actual.alias("actual_duration"),
            F.lit(False).alias("window_clipped"), marked.alias("discontinuity_at_start"), uris.alias("media_uris"), none("struct<ok:boolean>").alias("signal"),
        )

    uri = F.when(F.col("o_orderstatus") == "P", F.lit("http://o/show/seg1.ts")).otherwise(F.lit("http://o/ads/ad1.ts"))
    feed = side(rows, "s", at, F.round("o_totalprice"), F.round("o_totalprice"), F.lit(True), F.array(F.lit("http://s/show/seg1.ts")))
    output = side(rows.where("n is not null"), "o", at + (F.col("n") % 9) * 1000.0, none("double"), F.col("got"), F.col("o_orderstatus") == "F", F.array(uri))
    pairs = rows.select(F.col("o_custkey").alias("pair_id")).distinct()
    pairs = pairs.select("pair_id", *[F.concat(F.lit(x), F.col("pair_id").cast("string")).alias(n) for x, n in (("s", "source_id"), ("o", "output_id"))])
    docs = pairs.select(F.explode(F.array("source_id", "output_id")).alias("doc_id"))
    stats = docs.select("doc_id", F.lit(0.0).alias("window_start_pdt"), F.lit(1e15).alias("window_end_pdt"))
    media = pairs.select(F.col("output_id").alias("doc_id"), F.lit("http://o/show/seg7.ts").alias("uri"))
    found = stitching.compare(pairs, feed.unionByName(output), stats, media)
    return replace(found, release=lambda: (found.release(), dropped(rows)))


@query(f"WITH {_STITCH[1:]} SELECT status, count(*) AS n, CAST(sum(want) AS BIGINT) AS signalled, CAST(coalesce(sum(CASE WHEN met THEN got END), 0) AS BIGINT) AS stitched FROM s GROUP BY status")
def stitched_avails(spark, sf_dir):
    """Avails of all feeds by what became of them; output without an avail is left to ``stitching_findings``."""
    own = _stitched(spark, sf_dir)
    rows = own.avails.where("status <> 'unsignalled'").groupBy("status")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).cast("long").alias(c)
    return settled(rows.agg(F.count("*").alias("n"), total("signalled"), total("stitched")), own.release)


@query(
    f"""WITH {_STITCH[1:]}, f AS (
SELECT 'AVAIL_NOT_STITCHED' AS code, 'error' AS severity FROM s WHERE status = 'not-stitched' UNION ALL
SELECT 'STITCH_MISALIGNED', 'error' FROM s WHERE met AND late >= 1 UNION ALL
SELECT 'AVAIL_PASSED_THROUGH', 'error' FROM s WHERE met AND o_orderstatus = 'P' UNION ALL
SELECT 'AVAIL_UNDER_FILLED', 'warning' FROM s WHERE status = 'under-filled' UNION ALL
SELECT 'AVAIL_OVER_FILLED', 'warning' FROM s WHERE status = 'over-filled' UNION ALL
SELECT 'STITCH_NOT_MARKED', 'warning' FROM s WHERE met AND o_orderstatus <> 'F' UNION ALL
SELECT 'UNSIGNALLED_AVAIL_IN_OUTPUT', 'warning' FROM s WHERE NOT met)
SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2"""
)
def stitching_findings(spark, sf_dir):
    own = _stitched(spark, sf_dir)
    return settled(_by_code(own.findings), own.release)


@query(
    f"""WITH {_STITCH[1:]} SELECT o_custkey AS pair_id, count(*) AS signalled, count(*) FILTER (WHERE status = 'not-stitched') AS not_stitched, count(*) FILTER (WHERE status = 'passthrough') AS passthrough,
count(*) FILTER (WHERE NOT met) AS unsignalled, CASE WHEN sum(want) > 0 THEN round(coalesce(sum(CASE WHEN met AND o_orderstatus <> 'P' THEN got END), 0) / sum(want), 6) ELSE 0.0 END AS fill_rate FROM s GROUP BY o_custkey"""
)
def stitching_summary(spark, sf_dir):
    own = _stitched(spark, sf_dir)
    found = own.summary.select("pair_id", "signalled", "not_stitched", "passthrough", "unsignalled", F.round("fill_rate", 6).alias("fill_rate"))
    return settled(found, own.release)


# Renditions: ten users' rendered playlists are those of one stream, that of the smallest user is the reference.

_RENDITIONS = f"""WITH {_SEGMENTS[1:]},
u AS (SELECT DISTINCT user_id FROM e),
r AS (SELECT user_id, user_id // 10 AS stream_id, row_number() OVER (PARTITION BY user_id // 10 ORDER BY user_id) - 1 AS ordinal FROM u),
many AS (SELECT stream_id FROM r GROUP BY stream_id HAVING count(*) > 1),
k AS (SELECT b.user_id, b.i AS index, coalesce(s.start_ms, 0) AS start_ms, coalesce(f.start_ms - s.start_ms, 0) AS length FROM b
 LEFT JOIN t s ON s.user_id = b.user_id AND s.seg = b.seg LEFT JOIN t f ON f.user_id = b.user_id AND f.seg = b.ns WHERE b.closed),
own AS (SELECT r.stream_id, r.ordinal, k.* FROM k JOIN r USING (user_id) WHERE r.stream_id IN (SELECT stream_id FROM many)),
per AS (SELECT r.stream_id, r.ordinal, count(own.index) AS n FROM r LEFT JOIN own ON own.stream_id = r.stream_id AND own.ordinal = r.ordinal WHERE r.stream_id IN (SELECT stream_id FROM many) GROUP BY 1, 2),
w AS (SELECT a.stream_id, a.index, a.length, r.ordinal AS other, a.start_ms FROM own a JOIN r ON r.stream_id = a.stream_id AND r.ordinal > 0 WHERE a.ordinal = 0),
m AS (SELECT w.stream_id, w.index, w.other, w.length, c.length AS their, abs(c.start_ms - w.start_ms) AS gap, row_number() OVER (PARTITION BY w.stream_id, w.other, w.index ORDER BY abs(c.start_ms - w.start_ms), c.index) AS n
 FROM w LEFT JOIN own c ON c.stream_id = w.stream_id AND c.ordinal = w.other AND abs(c.start_ms - w.start_ms) <= 3000),
st AS (SELECT r.stream_id, r.user_id, coalesce(string_agg(DISTINCT e.event_type, '+' ORDER BY e.event_type), '') AS style FROM r LEFT JOIN e ON e.user_id = r.user_id AND e.event_type IN ('signup', 'purchase') GROUP BY 1, 2),
f AS (SELECT 'VARIANT_SIGNALLING_STYLE_MISMATCH' AS code, 'warning' AS severity FROM st WHERE stream_id IN (SELECT stream_id FROM many) GROUP BY stream_id HAVING count(DISTINCT style) > 1 UNION ALL
 SELECT 'VARIANT_BREAK_COUNT_MISMATCH', 'error' FROM per GROUP BY stream_id HAVING count(DISTINCT n) > 1 UNION ALL
 SELECT 'VARIANT_MISSING_BREAK', 'error' FROM m WHERE gap IS NULL UNION ALL
 SELECT 'VARIANT_BREAK_MISALIGNED', 'error' FROM m WHERE n = 1 AND gap > 500 UNION ALL
 SELECT 'VARIANT_DURATION_MISMATCH', 'warning' FROM m WHERE n = 1 AND abs(length - their) > 500)
SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2"""


@query(_RENDITIONS)
def rendition_findings(spark, sf_dir):
    own = hls.analyse(playlists(table(spark, sf_dir, "events")))
    stream = F.expr("doc_id div 10")
    place = F.row_number().over(Window.partitionBy(stream).orderBy("doc_id")) - 1
    renditions = own.headers.select("doc_id").distinct().select("doc_id", stream.alias("stream_id"), place.alias("ordinal"))
    return settled(_by_code(hls.compare_renditions(renditions, own.breaks, own.stats)), own.release)


# Polls: every event is a poll; an error event is a failing analysis, a purchase a warning one.

_GRADE = "CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END"


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    severity, code = F.when(rank == 2, "error").otherwise("warning"), F.when(rank == 2, "E").otherwise("W")
    held = F.when(rank > 0, F.array(F.struct(code.alias("code"), severity.alias("severity")))).otherwise(F.array().cast("array<struct<code:string,severity:string>>"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("monitor_id"), _micros("ts").alias("at"), F.lit(True).alias("ok"), F.element_at(F.array(*map(F.lit, ("pass", "warn", "fail"))), rank + 1).alias("verdict"),
        (rank == 2).cast("int").alias("errors"), (rank == 1).cast("int").alias("warnings"), F.lit(1).alias("break_count"), held.alias("findings"), F.round(F.col("value") / 100, 4).alias("fill_rate"),
        F.when(F.col("value") > 95, 1).otherwise(0).alias("not_stitched"), F.when(F.col("value") < 5, 1).otherwise(0).alias("passthrough"),
    )


@query(
    f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS monitor_id, epoch_us(ts) AS t, {_GRADE} AS now, round(value / 100, 4) AS fill, value FROM events),
l AS (SELECT *, lag(now) OVER w AS old, lag(fill) OVER w AS before FROM p WINDOW w AS (PARTITION BY monitor_id ORDER BY t)),
f AS (SELECT monitor_id, t, 'VERDICT_DEGRADED' AS code, CASE now WHEN 2 THEN 'error' ELSE 'warning' END AS severity FROM l WHERE now > old UNION ALL
SELECT monitor_id, t, 'ERRORS_CLEARED', 'info' FROM l WHERE old = 2 AND now < 2 UNION ALL SELECT monitor_id, t, 'NEW_E', 'error' FROM l WHERE old < 2 AND now = 2 UNION ALL
SELECT monitor_id, t, 'NEW_W', 'warning' FROM l WHERE old <> 1 AND now = 1 UNION ALL SELECT monitor_id, t, 'AVAILS_NOT_STITCHED', 'error' FROM l WHERE value > 95 UNION ALL
SELECT monitor_id, t, 'AVAILS_PASSED_THROUGH', 'error' FROM l WHERE value < 5 UNION ALL SELECT monitor_id, t, 'FILL_RATE_DROPPED', 'error' FROM l WHERE before - fill >= 0.1 UNION ALL
SELECT monitor_id, t, 'FILL_RATE_RECOVERED', 'info' FROM l WHERE fill - before >= 0.1)
SELECT monitor_id, CAST(t AS BIGINT) AS "at", severity, code FROM f"""
)
def poll_alerts(spark, sf_dir):
    return monitor.alerts(_polls(spark, sf_dir))


@query(ORACLE_SQL["poll_alerts"])
def poll_store_alerts(spark, sf_dir):
    """The same polls as a stream into the store on disk: half of January is landed and done, then the other half by a stream
    that is started again. Returns the alerts that are stored."""
    rows = _polls(spark, sf_dir).select("*", F.when(F.col("at") < 1_705_276_800_000_000, 0).otherwise(1).alias("half"))
    schema = spark.createDataFrame([], poll.POLLS).schema
    rows = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], "half")
    folder = shared_folder(spark)
    kept = poll.Store(spark, f"{folder}/store", 16)
    for half in (0, 1):
        rows.where(F.col("half") == half).drop("half").write.mode("append").parquet(f"{folder}/polls")
        poll.watch(spark.readStream.schema(schema).parquet(f"{folder}/polls"), kept, f"{folder}/checkpoint").awaitTermination()
    return settled(kept.alerts.read().select("monitor_id", "at", "severity", "code"), lambda: kept.alerts._delete(folder))


@query(
    """WITH e AS (SELECT user_id, event_id % 40 AS k, epoch_us(ts) // 1000 AS t, CASE WHEN value > 50 THEN value END AS signalled, event_type = 'purchase' AS closed, value * 3 AS distance FROM events),
p AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS poll_before, lag(t) OVER (PARTITION BY user_id, k ORDER BY t) AS seen_before FROM e),
s AS (SELECT *, sum(CASE WHEN seen_before IS NULL OR poll_before - seen_before > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY t) AS life FROM p),
c AS (SELECT *, bool_or(closed) OVER w AS shut, last_value(signalled IGNORE NULLS) OVER w AS length FROM s WINDOW w AS (PARTITION BY user_id, k, life ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, k, life ORDER BY t) AS n FROM c WHERE NOT shut AND distance > coalesce(length, 60) + 60)
SELECT CAST(user_id AS VARCHAR) AS monitor_id, CAST(k AS VARCHAR) AS break_key, CAST(t AS BIGINT) AS "at", 'BREAK_STUCK_OPEN' AS code FROM o WHERE n = 1"""
)
def break_lives(spark, sf_dir):
    """Every event as a poll of its user that shows one break: those that stay open, over the life of each break."""
    seen = F.struct(
        (F.col("event_id") % 40).cast("string").alias("break_key"), F.when(F.col("value") > 50, F.col("value")).alias("signalled"), (F.col("event_type") == "purchase").cast("int").alias("closed"), (F.col("value") * 3).alias("edge_distance")
    )
    polls = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("monitor_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at"), F.lit(False).alias("overrun"), F.array(seen).alias("breaks"))
    return lifecycle.replayed(polls, spark.createDataFrame([], lifecycle.STORED))[1].select("monitor_id", "break_key", "at", "code")


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS monitor_id, epoch_us(ts) // 1000 AS t FROM events),
w AS (SELECT monitor_id, t, (t // 43200000 - k) * 43200000 AS s FROM e, (VALUES (0), (1), (2), (3)) v(k)),
g AS (SELECT *, t - coalesce(lag(t) OVER (PARTITION BY monitor_id, s ORDER BY t), s + 21600000) AS gap FROM w)
SELECT monitor_id, CAST(s + 172800000 AS BIGINT) AS until, count(*) AS polls, CAST(8 AS BIGINT) AS expected, round(least(1.0, count(*) / 8.0), 6) AS ratio,
CAST(greatest(0, round(greatest(max(gap), s + 172800000 - max(t)) / 1000.0)) AS BIGINT) AS longest_gap FROM g GROUP BY monitor_id, s"""
)
def sliding_poll_coverage(spark, sf_dir):
    """Windows of two days, every twelve hours, of users as monitors with a poll every six hours."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("monitor_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at"))
    return monitor.sliding_coverage(runs, 21_600, 172_800, 43_200).withColumn("ratio", F.round("ratio", 6))


def _departures(events: DataFrame) -> DataFrame:
    side = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 0)
    return paired(events.withColumn("polarity", side).where("polarity is not null"), ["user_id"], ["ts", "event_id"]).where("polarity = 1")


@query(
    """WITH s AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS p FROM events WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT *, lead(p) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM s), z AS (SELECT user_id, max(epoch_us(ts)) AS edge FROM events GROUP BY user_id)
SELECT l.user_id, CAST(l.event_id AS VARCHAR) AS break_key, 'BREAK_STUCK_OPEN' AS code FROM l JOIN z USING (user_id)
WHERE l.p = 1 AND coalesce(l.nx, 1) = 1 AND (z.edge - epoch_us(l.ts)) / 1000000.0 > coalesce(CASE WHEN l.value >= 10 THEN l.value END, 60) + 60"""
)
def stuck_open_breaks(spark, sf_dir):
    """Departures that no return follows, further behind their channel's last event than they should last. Those of under
    ten seconds state no length."""
    events = table(spark, sf_dir, "events").withColumn("us", _micros("ts"))
    edge = events.groupBy("user_id").agg(F.max("us").alias("edge"))
    seen = _departures(events).join(edge, "user_id").select(
        F.col("user_id").alias("monitor_id"), F.col("event_id").cast("string").alias("break_key"), F.lit(0).cast("long").alias("at"), F.when(F.col("value") >= 10, F.col("value")).alias("signalled"),
        F.col("closed").cast("int").alias("closed"), ((F.col("edge") - F.col("us")) / 1e6).alias("edge_distance"), F.lit(False).alias("overrun"),
    )
    known = seen.limit(0).selectExpr("monitor_id", "break_key", "at first_seen", "at last_seen", "signalled", "closed", "0 alerted")
    _, late = monitor.stuck(known, seen, 0)
    return late.select(F.col("monitor_id").alias("user_id"), "break_key", "code")


@query(
    """WITH e AS (SELECT user_id, event_id % 40 AS break_key, epoch_us(ts) AS t, CASE WHEN value > 50 THEN value END AS signalled, CAST(event_type = 'purchase' AS INTEGER) AS closed, ts < TIMESTAMP '2024-01-15' AS old FROM events),
k AS (SELECT user_id, break_key, min(t) AS a, max(t) AS b, max(signalled) AS s, max(closed) AS c FROM e WHERE old GROUP BY 1, 2),
n AS (SELECT user_id, break_key, min(t) AS a, max(t) AS b, arg_max(signalled, t) FILTER (WHERE signalled IS NOT NULL) AS s, max(closed) AS c FROM e WHERE NOT old GROUP BY 1, 2)
SELECT coalesce(k.user_id, n.user_id) AS user_id, coalesce(k.break_key, n.break_key) AS break_key, coalesce(k.a, n.a) AS first_seen, coalesce(n.b, k.b) AS last_seen, coalesce(n.s, k.s) AS signalled,
CAST(greatest(coalesce(k.c, 0), coalesce(n.c, 0)) AS INTEGER) AS closed FROM k FULL JOIN n ON k.user_id = n.user_id AND k.break_key = n.break_key"""
)
def break_store(spark, sf_dir):
    """The store of breaks of January's first half, brought up to date by those of the second."""
    signalled = F.when(F.col("value") > 50, F.col("value")).alias("signalled")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("monitor_id"), (F.col("event_id") % 40).alias("break_key"), _micros("ts").alias("at"), signalled, (F.col("event_type") == "purchase").cast("int").alias("closed"), (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("old")
    )
    known = rows.where("old").groupBy("monitor_id", "break_key").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max("signalled").alias("signalled"), F.max("closed").alias("closed"), F.lit(0).alias("alerted")
    )
    found = monitor.upserted(known, rows.where("not old"))
    return found.select(F.col("monitor_id").alias("user_id"), "break_key", "first_seen", "last_seen", "signalled", "closed")


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS monitor_id, epoch_us(ts) // 1000 AS t, ts, event_id FROM events),
l AS (SELECT monitor_id, max(t) AS last_at, least(count(*), 60) AS history FROM e GROUP BY 1),
w AS (SELECT monitor_id, count(*) AS polls FROM e WHERE t BETWEEN 1704067200000 AND 1706659200000 GROUP BY 1)
SELECT l.monitor_id, CAST(l.last_at AS BIGINT) AS last_at, CAST(l.history AS INTEGER) AS history, w.polls, round(least(1.0, w.polls / 120.0), 6) AS ratio FROM l LEFT JOIN w USING (monitor_id)"""
)
def monitor_dashboard(spark, sf_dir):
    runs = _polls(spark, sf_dir).withColumn("at", F.expr("at div 1000"))
    monitors = runs.select("monitor_id").distinct()
    found = monitor.dashboard(monitors, runs, 21600.0, 2592000.0, 1706659200.0)
    return found.select("monitor_id", F.col("last_run.at").alias("last_at"), F.size("history").alias("history"), "polls", F.round("ratio", 6).alias("ratio"))


@query(
    """SELECT severity, event_type, n, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, first_id) AS INTEGER) AS place FROM (
SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2)"""
)
def finding_groups(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    found = table(spark, sf_dir, "events").select(
        F.lit("all").alias("doc_id"), severity.alias("severity"), F.col("event_type").alias("code"), F.col("event_type").alias("title"), F.col("event_id").alias("line_number")
    )
    many = grouped(found)  # a row an event type is left to be ordered
    return many.select("severity", F.col("code").alias("event_type"), "n", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "first_line")).alias("place"))


# Manifests: a customer's orders are the periods of a static manifest, their status the codec, every seventh without id.


@query(
    """WITH o AS (SELECT *, row_number() OVER w AS i, lead(o_orderstatus) OVER w AS nx, CAST(floor(o_totalprice) AS BIGINT) AS s, lead(o_orderkey) OVER w AS nk, count(*) OVER (PARTITION BY o_custkey) AS periods FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
f AS (SELECT 'PERIOD_MISSING_ID' AS code, 'warning' AS severity FROM o WHERE o_orderkey % 7 = 0 UNION ALL
SELECT 'REPRESENTATION_SET_CHANGED', 'error' FROM o WHERE nx <> o_orderstatus UNION ALL
SELECT 'PTO_MISMATCH', 'error' FROM o WHERE o_orderkey % 5 = 0 UNION ALL
SELECT 'PERIOD_MEDIA_STARTS_LATE', 'warning' FROM o WHERE o_orderkey % 5 = 0 UNION ALL
SELECT 'PERIOD_TIMELINE_OVERLAP', 'error' FROM o WHERE nk IS NOT NULL AND (o_orderkey % 5 = 0 OR o_orderkey % 11 = 0) UNION ALL
SELECT 'NO_ASSET_IDENTIFIER', 'info' FROM o WHERE periods > 1 AND i = 1 UNION ALL
SELECT DISTINCT ON (o_custkey) 'NO_PERIOD_CONTINUITY_SIGNAL', 'warning' FROM o WHERE nx = o_orderstatus)
SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2"""
)
def dash_findings(spark, sf_dir):
    seconds = F.floor("o_totalprice").cast("long")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "orders").withColumn("before", F.coalesce(F.sum(seconds).over(by), F.lit(0)))
    key = F.col("o_orderkey")
    text = F.format_string(
        '<Period%s duration="PT%dS"><AdaptationSet mimeType="video/mp4"><SegmentTemplate timescale="1" presentationTimeOffset="%d"><SegmentTimeline><S t="%d" d="%d"/></SegmentTimeline></SegmentTemplate><Representation id="v" codecs="%s"/></AdaptationSet></Period>',
        F.when(key % 7 == 0, "").otherwise(F.format_string(' id="o%d"', key)), seconds, F.col("before") + F.when(key % 5 == 0, 9).otherwise(0),
        F.col("before") + F.when(key % 5 == 0, 9).otherwise(0), seconds + F.when(key % 11 == 0, 2).otherwise(0), F.concat(F.lit("c"), "o_orderstatus"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("x")))), lambda x: x["x"]), "")
    docs = rows.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit('<MPD type="static">'), body, F.lit("</MPD>")).alias("body"))
    own = dash.analyse(docs)
    return settled(_by_code(own.coded), own.release)


# Remote periods: a customer's first orders are slots of a manifest, what each resolves to follows from the order.


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 8 AS k FROM orders), a AS (SELECT * FROM o WHERE i <= 6),
f AS (SELECT 'XLINK_RESOLVE_FAILED' AS code, 'error' AS severity FROM a WHERE k = 0 UNION ALL SELECT 'XLINK_RESOLVE_UNPARSEABLE', 'error' FROM a WHERE k = 1 UNION ALL
SELECT 'XLINK_RESOLVED_EMPTY', 'warning' FROM a WHERE k = 2 UNION ALL SELECT 'XLINK_RESOLVE_SLOW', 'warning' FROM a WHERE k = 3 UNION ALL
SELECT 'XLINK_NOT_RESOLVED', 'info' FROM o WHERE i = 7 UNION ALL SELECT 'XLINK_DURATION_MISMATCH', 'error' FROM a WHERE k IN (4, 5) UNION ALL SELECT 'XLINK_CODEC_MISMATCH', 'warning' FROM a WHERE k IN (5, 6))
SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2"""
)
def remote_periods(spark, sf_dir):
    kind = F.col("o_orderkey") % 8
    orders = table(spark, sf_dir, "orders").withColumn("href", F.format_string("http://ads/%d", "o_orderkey"))
    media = lambda codec, seconds: F.format_string('<Period duration="PT%dS"><AdaptationSet mimeType="video/mp4"><Representation codecs="%s"/></AdaptationSet></Period>', seconds, codec)
    slot = F.format_string('<Period duration="PT30S" xlink:href="%s"/>', "href")
    slots = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", slot.alias("x")))), lambda x: x["x"]), "")
    head = F.concat(F.lit('<MPD xmlns:xlink="urn:x" type="static">'), media(F.lit("avc1"), F.lit(30)))
    docs = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(head, slots, F.lit("</MPD>")).alias("body"))
    body = F.when(kind == 1, "sorry").when(kind == 2, "<x/>").otherwise(media(F.when(kind.isin(5, 6), "hvc1").otherwise("avc1"), F.when(kind.isin(4, 5), 40).otherwise(30)))
    fetched = orders.select("href", (kind != 0).alias("ok"), body.alias("body"), F.when(kind == 3, 3000.0).otherwise(10.0).alias("ms"))
    own = dash.analyse(docs)
    return settled(_by_code(remote.resolve(own.periods, own.sets, fetched)[1]), own.release)


# Wrapper chains: a customer's response wraps its nation's, that its region's; region 0 has an inline ad, 1 wraps itself,
# 2 wraps nation 0, 3 fails, 4 is no response.


@query(
    """WITH RECURSIVE link(url, nxt, ok, readable) AS (
SELECT 'n' || n_nationkey, 'r' || n_regionkey, true, true FROM nation UNION ALL
SELECT 'r' || r_regionkey, CASE r_regionkey WHEN 1 THEN 'r1' WHEN 2 THEN 'n0' END, r_regionkey <> 3, r_regionkey <> 4 FROM region),
c(doc, url, depth, seen) AS (SELECT c_custkey, 'n' || c_nationkey, 1, CAST([] AS VARCHAR[]) FROM customer UNION ALL
SELECT c.doc, l.nxt, c.depth + 1, list_append(c.seen, c.url) FROM c JOIN link l ON l.url = c.url WHERE l.ok AND l.readable AND l.nxt IS NOT NULL AND NOT list_contains(c.seen, c.url) AND c.depth < 9),
f AS (SELECT 'VAST_WRAPPER_LOOP' AS code FROM c WHERE depth <= 5 AND list_contains(seen, url) UNION ALL
SELECT 'VAST_WRAPPER_UNRESOLVED' FROM c JOIN link l USING (url) WHERE depth <= 5 AND NOT list_contains(seen, url) AND NOT l.ok UNION ALL
SELECT 'VAST_WRAPPER_UNPARSEABLE' FROM c JOIN link l USING (url) WHERE depth <= 5 AND NOT list_contains(seen, url) AND l.ok AND NOT l.readable UNION ALL
SELECT 'VAST_WRAPPER_TOO_DEEP' FROM c WHERE depth = 6)
SELECT code, 'error' AS severity, count(*) AS n FROM f GROUP BY 1"""
)
def wrapper_findings(spark, sf_dir):
    wrapper = lambda url: F.concat(F.lit('<VAST version="4.0"><Ad id="1"><Wrapper><VASTAdTagURI>'), url, F.lit("</VASTAdTagURI></Wrapper></Ad></VAST>"))
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), wrapper(name("n", "c_nationkey")).alias("body"))
    nations = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("url"), F.lit(True).alias("ok"), wrapper(name("r", "n_regionkey")).alias("body"), F.lit(1.0).alias("ms"))
    key = F.col("r_regionkey")
    inline = F.lit('<VAST version="4.0"><Ad id="1"><InLine><Impression>i</Impression></InLine></Ad></VAST>')
    body = F.when(key == 1, wrapper(F.lit("r1"))).when(key == 2, wrapper(F.lit("n0"))).when(key == 4, "sorry").otherwise(inline)
    regions = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("url"), (key != 3).alias("ok"), body.alias("body"), F.lit(1.0).alias("ms"))
    return _by_code(vast.wrapper_chains(docs, nations.unionByName(regions))[1])


# Policies: a customer's orders are the points of a policy document, one hour apart; every third has no break near it.


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey % 6 AS k FROM orders),
f AS (SELECT 'SCTE224_POINT_EXPIRED' AS code, 'info' AS severity FROM o WHERE k = 0 UNION ALL SELECT 'SCTE224_POINT_FUTURE', 'info' FROM o WHERE k = 1 UNION ALL
SELECT 'SCTE224_POINT_NO_POLICY', 'warning' FROM o WHERE k = 2 UNION ALL SELECT 'SCTE224_POINT_UNMATCHED', 'warning' FROM o WHERE k = 3 UNION ALL
SELECT 'SCTE224_MATCH_DRIFT', 'info' FROM o WHERE k = 4 UNION ALL SELECT 'SCTE224_DURATION_MISMATCH', 'warning' FROM o WHERE k = 5 UNION ALL
SELECT 'SCTE224_SIGNAL_NOT_GOVERNED', 'info' FROM o WHERE k IN (0, 1) GROUP BY o_custkey)
SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2"""
)
def policy_findings(spark, sf_dir):
    from cuelake.sources import scte224

    now = 1_767_225_600_000.0  # 2026-01-01
    kind = F.col("o_orderkey") % 6
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("k"), place.alias("i"))
    at = F.date_format(F.timestamp_millis(F.lit(int(now)) + F.col("i") * 3_600_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    limits = F.when(kind == 0, ' expires="2020-01-01T00:00:00Z"').when(kind == 1, ' effective="2031-01-01T00:00:00Z"').otherwise("")
    rows = rows.withColumns({"at": at, "limits": limits})
    applies = F.when(F.col("k") == 2, "").otherwise('<Apply policy="p"/>')
    point = F.format_string('<MediaPoint id="%d" matchTime="%s" expectedDuration="PT30S"%s>%s</MediaPoint>', "o_orderkey", "at", "limits", applies)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", point.alias("x")))), lambda x: x["x"]), "")
    docs = rows.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit('<Media xmlns="urn:scte:224" id="m">'), body, F.lit("</Media>")).alias("body"))
    length = F.when(F.col("k") == 5, 40.0).otherwise(30.0)
    breaks = rows.where("k <> 3").select(
        F.col("o_custkey").alias("doc_id"), F.col("i").alias("index"), F.lit(None).cast("string").alias("upid"), (F.lit(now) + F.col("i") * 3_600_000.0 + F.when(F.col("k") == 4, 3000.0).otherwise(0.0)).alias("pdt"),
        F.lit(None).cast("int").alias("segmentation_type"), length.alias("signalled_duration"),
    )
    own = policy.Governed(scte224.points(docs), breaks, now)
    return settled(_by_code(own.findings), own.release)


# Cues in segments against breaks: every event carries a cue; what its break says follows from the event.


@query(
    """WITH e AS (SELECT event_id % 7 AS k FROM events), f AS (SELECT 'INBAND_MANIFEST_TIME_MISMATCH' AS code, 'error' AS severity FROM e WHERE k = 1 UNION ALL
SELECT 'INBAND_MANIFEST_EVENT_ID_MISMATCH', 'warning' FROM e WHERE k = 2 UNION ALL SELECT 'INBAND_SIGNAL_NOT_IN_MANIFEST', 'error' FROM e WHERE k = 3 UNION ALL
SELECT 'INBAND_SCTE35_CRC_INVALID', 'warning' FROM e WHERE k = 4 UNION ALL SELECT 'INBAND_ONLY_SIGNALLING', 'info' FROM e WHERE k = 5 UNION ALL SELECT 'NO_INBAND_SCTE35', 'info' FROM e WHERE k = 6)
SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2"""
)
def inband_agreement(spark, sf_dir):
    """A document an event, at one minute to the id: its cue and its breaks agree (0), differ in time (1) or id (2); the cue is far
    from all breaks (3), has a wrong CRC (4), or no breaks beside it (5); a break has no cue (6)."""
    kind = F.col("event_id") % 7
    events = table(spark, sf_dir, "events").select("event_id", kind.alias("k"), F.col("event_id").cast("string").alias("uri"))

    def boxed(i: int, k: int) -> bytes:
        section = splice.write_section(i, 30.0, valid_crc=k != 4)
        body = b"\0\0\0\0urn:scte:scte35:2013:bin\0\0" + b"".join(x.to_bytes(4, "big") for x in (1000, 0, 0, i)) + section
        return (len(body) + 8).to_bytes(4, "big") + b"emsg" + body

    files = events.where("k <> 6").select("uri", F.udf(boxed, "binary", useArrow=True)("event_id", "k").alias("content"))
    clock = F.col("event_id") * 60_000.0
    at = events.select(F.col("event_id").alias("doc_id"), "uri", clock.alias("pdt"))
    found = segments.signals(segments.cues(files), at)
    # read once: the rules look at cues in five ways
    found = written(found.select("doc_id", "uri", F.struct("section.ok", "section.crc_valid").alias("section"), "event_id", "out_of_network", "pdt", "hex"))
    moved = F.when(F.col("k") == 1, 2000.0).when(F.col("k") == 3, 50_000.0).otherwise(0.0)
    breaks = events.where("k <> 5").select(
        F.col("event_id").alias("doc_id"), F.lit(0).alias("index"), F.lit(0.0).alias("start_time"), (clock + moved).alias("pdt"),
        (F.col("event_id") + F.when(F.col("k").isin(2, 3), 1_000_000).otherwise(0)).alias("event_id"), F.lit(False).alias("window_clipped"),
    )
    return settled(_by_code(segments.agreement(found, breaks, events.select(F.col("event_id").alias("doc_id")))), lambda: dropped(found))


@query(
    """WITH e AS (SELECT event_id % 5 AS k FROM events), f AS (SELECT 'S104_EVENT_ID_CHANGED' AS code, 'error' AS severity FROM e WHERE k = 1 UNION ALL
SELECT 'S104_DIRECTION_CHANGED', 'error' FROM e WHERE k = 2 UNION ALL SELECT 'S104_DURATION_CHANGED', 'error' FROM e WHERE k = 3 UNION ALL SELECT 'S104_NOTHING_TO_COMPARE', 'info' FROM e WHERE k = 4)
SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2"""
)
def requests_and_splices(spark, sf_dir):
    """A splice request for each event and the section made of it: alike (0), or with another id (1), direction (2) or length (3); or a
    request without a splice (4)."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("k"))
    hexed = F.lpad(F.hex(F.col("event_id")), 8, "0")
    splice_ = F.concat(F.lit("ffff001e"), F.lit("00000100000000"), F.lit("01"), F.lit("0101000e"), F.lit("01"), hexed, F.lit("0001"), F.lit("1f40"), F.lit("012c"), F.lit("000001"))
    other = F.lit("ffff0010" + "00000100000000" + "01" + "00030000")
    rows = scte104.decoded(events.select(F.col("event_id").alias("doc_id"), "event_id", "k", F.when(F.col("k") == 4, other).otherwise(splice_).alias("message")))
    write = F.udf(lambda i, k: splice.write_section(i + (k == 1), 31.0 if k == 3 else 30.0, k != 2), "binary", useArrow=True)
    return _by_code(scte104.compared(rows.withColumn("section", splice.decode_section(F.base64(write("event_id", "k"))))))


# Addresses and one path: a master playlist for ten users, whose variants are their rendered playlists.


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/seg' || page_id || '.ts?x=1' WHEN 1 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'v/p' || page_id || '.m3u8'
ELSE 'http://o/' || page_id END AS uri FROM pages"""
)
def resolved_addresses(spark, sf_dir):
    number = F.col("page_id").cast("string")
    ref = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/a/../seg"), number, F.lit(".ts?x=1"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("v/./p"), number, F.lit(".m3u8"))).otherwise(F.concat(F.lit("http://o/b/../"), number))
    return table(spark, sf_dir, "pages").select("page_id", resolve_uri(F.col("url"), ref).alias("uri"))


def _one_path(spark: SparkSession, sf_dir: str) -> OnePath:
    """Variants of every fourth user could not be fetched; no more than six of a master playlist are taken."""
    own = playlists(table(spark, sf_dir, "events"))
    stream = F.expr("doc_id div 10").alias("stream")
    entry = F.format_string("#EXT-X-STREAM-INF:BANDWIDTH=%d\nu%d.m3u8", F.col("doc_id") + 1000, F.col("doc_id"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("x")))), lambda x: x["x"]), "\n")
    masters = own.groupBy(stream).agg(F.concat(F.lit("#EXTM3U\n"), body).alias("body"))
    masters = masters.select(F.col("stream").alias("doc_id"), F.format_string("http://o/%d/master.m3u8", "stream").alias("uri"), "body")
    url = F.format_string("http://o/%d/u%d.m3u8", F.expr("doc_id div 10"), F.col("doc_id"))
    fetched = own.select(url.alias("url"), (F.col("doc_id") % 4 != 3).alias("ok"), "body", F.lit(None).cast("string").alias("error"))
    return OnePath(masters, fetched)


@query(
    """WITH u AS (SELECT user_id, user_id // 10 AS stream, row_number() OVER (PARTITION BY user_id // 10 ORDER BY user_id) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))),
a AS (SELECT * FROM u WHERE n <= 6) SELECT stream, count(*) AS picked, count(*) FILTER (WHERE user_id % 4 <> 3) AS readable, count(*) FILTER (WHERE user_id % 4 = 3) AS failed,
CAST((SELECT count(*) FROM u x WHERE x.stream = a.stream) > 6 AS INTEGER) AS cut FROM a GROUP BY stream"""
)
def one_path(spark, sf_dir):
    path = _one_path(spark, sf_dir)
    count = lambda code, name: F.count_if(F.col("code") == code).cast("int" if name == "cut" else "long").alias(name)
    codes = path.reading.groupBy("stream_id").agg(count("VARIANT_FETCH_FAILED", "failed"), count("VARIANTS_NOT_ANALYSED", "cut"))
    picked = path.variants.groupBy(F.col("doc_id").alias("stream_id")).agg(F.count("*").alias("picked"), F.count_if("readable").alias("readable"))
    full = picked.join(codes, "stream_id", "left")
    full = full.select(F.col("stream_id").alias("stream"), "picked", "readable", F.coalesce("failed", F.lit(0)).cast("long").alias("failed"), F.coalesce("cut", F.lit(0)).cast("int").alias("cut"))
    return settled(full, path.release)


_PICKED = """WITH pu AS (SELECT user_id, user_id // 10 AS stream, row_number() OVER (PARTITION BY user_id // 10 ORDER BY user_id) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))),
ev AS (SELECT events.* FROM events JOIN pu USING (user_id) WHERE n <= 6 AND user_id % 4 <> 3)"""
_OWN = f"""SELECT code, severity, n FROM ({_RENDERED["rendered_verdicts"].replace("FROM events", "FROM ev")}) UNION ALL
SELECT code, severity, n FROM ({_RENDITIONS.replace("FROM events", "FROM ev")}) UNION ALL
SELECT 'VARIANT_FETCH_FAILED', 'warning', count(*) FROM pu WHERE n <= 6 AND user_id % 4 = 3 UNION ALL
SELECT 'VARIANTS_NOT_ANALYSED', 'info', count(*) FROM pu WHERE n = 7 UNION ALL
SELECT 'NO_VARIANT_READABLE', 'error', count(*) FROM (SELECT stream FROM pu WHERE n <= 6 GROUP BY stream HAVING bool_and(user_id % 4 = 3))"""


@query(f"{_PICKED} SELECT code, severity, CAST(sum(n) AS BIGINT) AS n FROM ({_OWN}) WHERE n > 0 GROUP BY 1, 2")
def one_path_findings(spark, sf_dir):
    """All findings from master playlists on: those of each readable rendition, of renditions against each other, and of
    what could not be read."""
    path = _one_path(spark, sf_dir)
    return settled(_by_code(path.findings), path.release)


# Descriptors and labels.


@query(
    """SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 48 WHEN 1 THEN 52 ELSE 16 END AS INTEGER) AS type_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(round(value, 2) * 90000 + 0.5) AS BIGINT) END AS ticks,
CAST(event_id * 90000 AS BIGINT) AS pts_time, CASE event_id % 2 WHEN 0 THEN 'ID' || lpad(CAST(event_id AS VARCHAR), 9, '0') ELSE '0x' || lpad(lower(to_hex(event_id)), 16, '0') END AS upid, event_type <> 'error' AS crc_valid FROM events"""
)
def segmentation_roundtrip(spark, sf_dir):
    """A time_signal with a segmentation descriptor for each event, written and read again: type by the id, every fifth without a
    length, identifiers as Ad-ID or as 64 bits, times of 33 bits unwrapped by a clock of whole hours."""

    def write(i: int, seconds: float, good: bool) -> bytes:
        upid = (3, f"ID{i:09d}".encode()) if i % 2 == 0 else (8, i.to_bytes(8, "big"))
        return splice.write_section(i, None if i % 5 == 0 else seconds, pts=i * 90_000, type_id=(0x30, 0x34, 0x10)[i % 3], upid_type=upid[0], upid=upid[1], valid_crc=good)

    events = table(spark, sf_dir, "events")
    made = F.udf(write, "binary", useArrow=True)("event_id", F.round("value", 2), F.col("event_type") != "error")
    found = events.select("event_id", splice.decode_section(F.base64(made)).alias("s"))
    lead = splice.lead_descriptor(F.col("s"))
    hour = 3600 * splice.TICKS  # a section's time wraps after 26 hours, a clock of whole hours tells which of them is meant
    pts = splice.unwrapped(F.col("s.time_signal.pts_time"), F.floor(F.col("event_id") * splice.TICKS / hour) * hour)
    return found.select("event_id", lead["type_id"].alias("type_id"), lead["duration_ticks"].alias("ticks"), pts.alias("pts_time"), lead["upid_text"].alias("upid"), F.col("s.crc_valid").alias("crc_valid"))


@query(
    """SELECT page_id, CASE WHEN len(p) = 0 THEN h WHEN left(p[-1], 1) <> '.' THEN p[-1] ELSE coalesce(p[-2], h) END AS label FROM (
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '/.mpd', '/'), lambda x: x <> '') AS p FROM pages)"""
)
def address_labels(spark, sf_dir):
    """The label of the manifest .mpd below each page's address."""
    from cuelake.functions.text import address_label

    return table(spark, sf_dir, "pages").select("page_id", address_label(F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/.mpd"))).alias("label"))


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS monitor_id, epoch_us(ts) AS t, event_id, event_type, value FROM events),
r AS (SELECT monitor_id, least(count(*), 50) AS runs, max(t) AS newest FROM e GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY t DESC) AS n FROM e WHERE value > 80),
a AS (SELECT monitor_id, count(*) AS alerts, min(t) AS oldest FROM k WHERE n <= 10 GROUP BY 1),
b AS (SELECT monitor_id, count(*) AS open, min(CAST(event_id AS VARCHAR)) AS first FROM e WHERE event_type = 'signup' GROUP BY 1)
SELECT r.monitor_id, CAST(r.runs AS INTEGER) AS runs, CAST(r.newest AS BIGINT) AS newest_run, CAST(coalesce(a.alerts, 0) AS INTEGER) AS alerts, CAST(a.oldest AS BIGINT) AS oldest_alert,
CAST(coalesce(b.open, 0) AS INTEGER) AS open_breaks, b.first AS first_break FROM r LEFT JOIN a USING (monitor_id) LEFT JOIN b USING (monitor_id)"""
)
def monitor_details(spark, sf_dir):
    """Users as monitors: 50 runs, ten alerts of large values, and the signups as open breaks of each."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("monitor_id"), _micros("ts").alias("at"), "event_id", "event_type", "value")
    breaks = events.where("event_type in ('signup', 'purchase')").select("monitor_id", F.col("event_id").cast("string").alias("break_key"), (F.col("event_type") == "purchase").cast("int").alias("closed"))
    alerts = events.where("value > 80").select("monitor_id", "at", F.col("event_type").alias("code"))
    found = store.details(events.select("monitor_id").distinct(), events.select("monitor_id", "at", "event_id"), alerts, breaks, 50, 10)
    at = lambda c, n: F.try_element_at(F.col(c), F.lit(n))["at"]
    return found.select(
        "monitor_id", F.size("runs").alias("runs"), at("runs", 1).alias("newest_run"), F.size("alerts").alias("alerts"), at("alerts", -1).alias("oldest_alert"), F.size("open_breaks").alias("open_breaks"),
        F.try_element_at(F.col("open_breaks"), F.lit(1))["break_key"].alias("first_break"),
    )
