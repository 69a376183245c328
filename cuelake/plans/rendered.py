"""Playlists and splice sections rendered from the event table, and the whole path over them: text to breaks.

Every user's events become one playlist: a view or click is a segment of its value in seconds, a signup opens a break
and a purchase ends it. The SQL does the same on the events themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import splice
from cuelake.plans import hls
from cuelake.runtime import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def playlists(events: DataFrame) -> DataFrame:
    """(doc_id, body): a closed media playlist a user, tags and segments in the order of ts and event_id."""
    seconds = F.format_string("%.3f", F.round(F.col("value"), 3))
    text = (
        F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("#EXTINF:"), seconds, F.lit(",\nseg"), F.col("event_id").cast("string"), F.lit(".ts")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("#EXT-X-CUE-OUT:"), seconds))
        .when(F.col("event_type") == "purchase", F.lit("#EXT-X-CUE-IN"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", text.alias("text"))))
    body = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    head = "#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:100\n"
    found = events.where(text.isNotNull()).groupBy("user_id").agg(body.alias("body"))
    return found.select(F.col("user_id").alias("doc_id"), F.concat(F.lit(head), "body", F.lit("\n#EXT-X-ENDLIST\n")).alias("body"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


_SEGMENTS = """
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')),
x AS (SELECT *, CAST(round(value * 1000) AS BIGINT) AS ms, coalesce(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e),
g AS (SELECT user_id, seg, ms, sum(ms) OVER (PARTITION BY user_id ORDER BY seg) - ms AS start_ms FROM x WHERE event_type IN ('view', 'click')),
d AS (SELECT user_id, max(seg) + 1 AS seg, sum(ms) AS start_ms FROM g GROUP BY user_id),
t AS (SELECT user_id, seg, start_ms FROM g UNION ALL SELECT * FROM d),
q AS (SELECT user_id, seg, CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS p, min(ms) AS any_ms, arg_min(ms, o) AS signalled_ms FROM x WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2, 3),
l AS (SELECT *, lead(p) OVER w AS nx, lead(seg) OVER w AS ns FROM q WINDOW w AS (PARTITION BY user_id ORDER BY seg, p)),
b AS (SELECT user_id, seg, signalled_ms, coalesce(nx = 0, false) AS closed, ns, row_number() OVER (PARTITION BY user_id ORDER BY seg) - 1 AS i FROM l WHERE p = 1)"""


def rendered_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ad breaks of the rendered playlists, times in milliseconds."""
    own = hls.analyse(playlists(_events(spark, sf_dir)))
    found = own.extents
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    found = found.select(
        F.col("doc_id").alias("user_id"), F.col("index").cast("long").alias("break_index"), ms("start_time").alias("start_ms"),
        ms("actual_duration").alias("actual_ms"), ms("signalled_duration").alias("signalled_ms"), "closed",
    )
    return settled(found, own.release)


QUERIES["rendered_breaks"] = rendered_breaks
ORACLE_SQL["rendered_breaks"] = f"""WITH {_SEGMENTS[1:]}
SELECT b.user_id, CAST(b.i AS BIGINT) AS break_index, CAST(coalesce(s.start_ms, 0) AS BIGINT) AS start_ms, CAST(coalesce(f.start_ms - s.start_ms, 0) AS BIGINT) AS actual_ms,
CAST(b.signalled_ms AS BIGINT) AS signalled_ms, b.closed FROM b LEFT JOIN t s ON s.user_id = b.user_id AND s.seg = b.seg
LEFT JOIN d z ON z.user_id = b.user_id LEFT JOIN t f ON f.user_id = b.user_id AND f.seg = CASE WHEN b.closed THEN b.ns ELSE coalesce(z.seg, 0) END"""


def scte35_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A splice_insert for each event, encoded, put into base64 and decoded again."""
    encode = F.udf(lambda i, s, out: splice.write_section(i, s, out), "binary", useArrow=True)
    payload = F.base64(encode(F.col("event_id"), F.round("value", 2), F.col("event_type") == "signup"))
    found = _events(spark, sf_dir).select("event_id", splice.decode_section(payload).alias("s"))
    return found.select(
        "event_id", F.col("s.splice_insert.event_id").alias("splice_event_id"), F.col("s.splice_insert.break_ticks").alias("ticks"),
        F.col("s.splice_insert.out_of_network").alias("out_of_network"), F.col("s.crc_valid").alias("crc_valid"),
    )


QUERIES["scte35_roundtrip"] = scte35_roundtrip
ORACLE_SQL["scte35_roundtrip"] = """SELECT event_id, event_id AS splice_event_id, CAST(floor(round(value, 2) * 90000 + 0.5) AS BIGINT) AS ticks, event_type = 'signup' AS out_of_network, true AS crc_valid FROM events"""


def crc_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CRC residue of every event's section: 0, or not where one bit was changed."""
    encode = F.udf(lambda i, good: splice.write_section(i, 30.0, valid_crc=good), "binary", useArrow=True)
    good = F.col("event_type") != "error"
    return _events(spark, sf_dir).select("event_id", (splice.crc_residue(encode(F.col("event_id"), good)) == 0).alias("valid"))


QUERIES["crc_mpeg"] = crc_mpeg
ORACLE_SQL["crc_mpeg"] = "SELECT event_id, event_type <> 'error' AS valid FROM events"


def rendered_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the rendered playlists by code, over all users."""
    own = hls.analyse(playlists(_events(spark, sf_dir)))
    found = own.coded.groupBy("code", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("playlists"))
    return settled(found, own.release)


QUERIES["rendered_verdicts"] = rendered_verdicts
ORACLE_SQL["rendered_verdicts"] = f"""WITH {_SEGMENTS[1:]},
y AS (SELECT b.*, coalesce(f.start_ms - s.start_ms, 0) AS actual_ms FROM b LEFT JOIN t s ON s.user_id = b.user_id AND s.seg = b.seg LEFT JOIN t f ON f.user_id = b.user_id AND f.seg = b.ns),
v AS (SELECT user_id, seg, p, lag(p) OVER (PARTITION BY user_id ORDER BY seg, p) AS pv FROM q),
u AS (SELECT 'UNCLOSED_BREAK' AS code, 'error' AS severity, user_id FROM b WHERE NOT closed
UNION ALL SELECT DISTINCT 'NO_PROGRAM_DATE_TIME', 'warning', user_id FROM e UNION ALL SELECT DISTINCT 'SIGNALLING_ONLY_STREAM', 'info', user_id FROM b
UNION ALL SELECT 'BREAK_OVERRUN', 'warning', user_id FROM y WHERE closed AND actual_ms - signalled_ms > 50000 UNION ALL SELECT 'BREAK_UNDERRUN', 'warning', user_id FROM y WHERE closed AND actual_ms - signalled_ms < -50000
UNION ALL SELECT 'TARGETDURATION_EXCEEDED', 'error', user_id FROM g WHERE ms > 100001
UNION ALL SELECT 'ORPHAN_CUE_IN', 'error', user_id FROM v WHERE p = 0 AND coalesce(pv, 0) = 0 UNION ALL SELECT 'NESTED_CUE_OUT', 'error', user_id FROM v WHERE p = 1 AND pv = 1
UNION ALL SELECT DISTINCT 'DUAL_SIGNALLING', 'info', user_id FROM x WHERE event_type = 'signup' GROUP BY user_id, seg HAVING count(*) > 1)
SELECT code, severity, count(*) AS n, count(DISTINCT user_id) AS playlists FROM u GROUP BY 1, 2"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dash_period_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of each customer's orders, a period an order: its start is the whole price so far, its media a tenth
    shorter than the price in every third order. Returns gaps and overlaps that the analysis finds, by customer."""
    from cuelake.plans import dash

    seconds = F.floor("o_totalprice").cast("long")
    short = F.when(F.col("o_orderkey") % 3 == 0, F.floor(seconds / 10)).otherwise(0)
    period = F.format_string(
        '<Period id="o%d" duration="PT%dS"><AdaptationSet mimeType="video/mp4"><SegmentTemplate timescale="1" presentationTimeOffset="0"><SegmentTimeline><S t="%d" d="%d"/></SegmentTimeline></SegmentTemplate><Representation id="v" codecs="avc1"/></AdaptationSet></Period>',
        F.col("o_orderkey"), seconds, F.col("before"), (seconds - short).cast("long"),
    )
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = _table(spark, sf_dir, "orders").withColumn("before", F.coalesce(F.sum(seconds).over(by), F.lit(0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", period.alias("x")))), lambda x: x["x"]), "")
    docs = rows.groupBy("o_custkey").agg(F.concat(F.lit('<MPD type="static">'), body, F.lit("</MPD>")).alias("body")).withColumnRenamed("o_custkey", "doc_id")
    found = dash.analyse(docs)
    gap = F.col("next_start") - F.col("media_start") - F.col("media_duration")
    gaps = found.periods.where("next_start is not null").withColumn("gap", gap).where(F.abs("gap") > dash.GAP_WARN)
    gaps = gaps.groupBy(F.col("doc_id").alias("o_custkey")).agg(F.count("*").alias("gaps"), F.sum(F.round("gap").cast("long")).alias("gap_seconds"))
    return settled(gaps, found.release)


QUERIES["dash_period_gaps"] = dash_period_gaps
ORACLE_SQL["dash_period_gaps"] = """WITH o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s,
 lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders)
SELECT o_custkey, count(*) AS gaps, CAST(sum(s // 10) AS BIGINT) AS gap_seconds FROM o WHERE nx IS NOT NULL AND o_orderkey % 3 = 0 AND s // 10 > 0 GROUP BY o_custkey"""


def vast_pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A VAST response of each order, an inline ad a line item with its quantity as seconds; items returned are wrappers."""
    from cuelake.plans import vast

    quantity = F.col("l_quantity").cast("int")
    ad = F.when(
        F.col("l_returnflag") == "R", F.format_string('<Ad id="%d"><Wrapper><VASTAdTagURI>http://ads/%d</VASTAdTagURI></Wrapper></Ad>', "l_linenumber", "l_partkey")
    ).otherwise(
        F.format_string(
            '<Ad id="%d"><InLine><Impression>i</Impression><Creatives><Creative><Linear><Duration>00:00:%02d</Duration><MediaFiles><MediaFile type="video/mp4">u</MediaFile></MediaFiles></Linear></Creative></Creatives></InLine></Ad>',
            "l_linenumber", quantity,
        )
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", ad.alias("x")))), lambda x: x["x"]), "")
    docs = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit('<VAST version="4.0">'), body, F.lit("</VAST>")).alias("body"))
    return vast.totals(docs).select(F.col("doc_id").alias("l_orderkey"), "ads", "wrappers", F.col("seconds").cast("long").alias("seconds"))


QUERIES["vast_pods"] = vast_pods
ORACLE_SQL["vast_pods"] = """SELECT l_orderkey, count(*) AS ads, count(*) FILTER (WHERE l_returnflag = 'R') AS wrappers,
CAST(coalesce(sum(CAST(l_quantity AS INTEGER)) FILTER (WHERE l_returnflag <> 'R'), 0) AS BIGINT) AS seconds FROM lineitem GROUP BY l_orderkey"""


def inband_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event message box for each event, read as a segment, with the time that it means."""
    from cuelake.sources import segments

    def boxed(i: int, seconds: float, delay: int) -> bytes:
        body = b"\0\0\0\0urn:scte:scte35:2013:bin\0\0" + b"".join(x.to_bytes(4, "big") for x in (1000, delay, 0, i)) + splice.write_section(i, seconds)
        return (len(body) + 8).to_bytes(4, "big") + b"emsg" + body

    events = _events(spark, sf_dir)
    delay = F.floor(F.col("value") * 10).cast("int")
    files = events.select(F.col("event_id").cast("string").alias("uri"), F.udf(boxed, "binary", useArrow=True)("event_id", F.round("value", 2), delay).alias("content"))
    at = events.select(F.lit("all").alias("doc_id"), F.col("event_id").cast("string").alias("uri"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("pdt"))
    found = segments.signals(segments.cues(files), at)
    return found.select("event_id", F.round("pdt").cast("long").alias("at_ms"), F.round(F.col("duration") * 100).cast("long").alias("centiseconds"), F.col("section.crc_valid").alias("crc_valid"))


QUERIES["inband_cues"] = inband_cues
ORACLE_SQL["inband_cues"] = """SELECT event_id, CAST(round(epoch_us(ts) / 1000.0 + floor(value * 10)) AS BIGINT) AS at_ms, CAST(round(round(value, 2) * 100) AS BIGINT) AS centiseconds, true AS crc_valid FROM events"""


def scte104_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A splice request for each event, written as hex and read again; its findings by code."""
    from cuelake.sources import scte104

    width = {"kind": 2, "event": 8, "pre": 4, "tenths": 4}
    value = {"kind": F.when(F.col("event_type") == "signup", 1).otherwise(2), "event": F.col("event_id"), "pre": F.floor(F.col("value") * 100), "tenths": F.floor(F.col("value")) % 7}
    hexed = {k: F.lpad(F.hex(v.cast("long")), width[k], "0") for k, v in value.items()}
    text = F.concat(F.lit("ffff001e"), F.lit("00000100000000"), F.lit("01"), F.lit("0101000e"), hexed["kind"], hexed["event"], F.lit("0001"), hexed["pre"], hexed["tenths"], F.lit("000001"))
    rows = scte104.decoded(_events(spark, sf_dir).select(F.col("event_id").alias("doc_id"), text.alias("message")))
    return scte104.findings(rows).groupBy("code", "severity").agg(F.count("*").alias("n"))


QUERIES["scte104_requests"] = scte104_requests
ORACLE_SQL["scte104_requests"] = """SELECT code, 'warning' AS severity, count(*) AS n FROM (
SELECT 'S104_IMMEDIATE_SPLICE' AS code FROM events WHERE event_type <> 'signup' UNION ALL
SELECT 'S104_SHORT_PRE_ROLL' FROM events WHERE event_type = 'signup' AND floor(value * 100) < 4000 UNION ALL
SELECT 'S104_NO_BREAK_DURATION' FROM events WHERE CAST(floor(value) AS BIGINT) % 7 = 0) GROUP BY code"""


def monitor_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a poll of its user: failed if an error; the verdict by value; breaks by the id's remainder."""
    from cuelake.streaming import monitor

    verdict = F.when(F.col("value") > 90, "fail").when(F.col("value") > 70, "warn").otherwise("pass")
    ok = F.col("event_type") != "error"
    runs = _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("monitor_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), ok.alias("ok"), F.when(ok, verdict).alias("verdict"),
        F.when(ok & (F.col("value") > 90), 1).otherwise(0).alias("errors"), F.lit(0).alias("warnings"), F.when(ok, F.col("event_id") % 3).cast("int").alias("break_count"),
        F.array().cast("array<struct<code:string,severity:string>>").alias("findings"), *[F.lit(None).cast(t).alias(n) for n, t in (("fill_rate", "double"), ("not_stitched", "int"), ("passthrough", "int"))],
    )
    return monitor.alerts(runs).groupBy("monitor_id", "code").agg(F.count("*").alias("n"))


QUERIES["monitor_alerts"] = monitor_alerts
ORACLE_SQL["monitor_alerts"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS monitor_id, ts, event_type <> 'error' AS ok, event_id % 3 AS b,
 CASE WHEN value > 90 THEN 2 WHEN value > 70 THEN 1 ELSE 0 END AS v FROM events),
i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY monitor_id ORDER BY ts) AS g FROM e),
f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY monitor_id, g ORDER BY ts) AS failures FROM i),
p AS (SELECT *, lag(ok) OVER w AS pok, lag(v) OVER w AS pv, lag(b) OVER w AS pb, lag(failures) OVER w AS pf FROM f WINDOW w AS (PARTITION BY monitor_id ORDER BY ts)),
a AS (SELECT monitor_id, 'STREAM_RECOVERED' AS code FROM p WHERE ok AND NOT pok AND pf >= 2 UNION ALL SELECT monitor_id, 'VERDICT_DEGRADED' FROM p WHERE ok AND pok AND v > pv
 UNION ALL SELECT monitor_id, 'SIGNALLING_STOPPED' FROM p WHERE ok AND pok AND pb > 0 AND b = 0 UNION ALL SELECT monitor_id, 'SIGNALLING_RESUMED' FROM p WHERE ok AND pok AND pb = 0 AND b > 0
 UNION ALL SELECT monitor_id, 'STREAM_UNREACHABLE' FROM p WHERE NOT ok AND failures = 2)
SELECT monitor_id, code, count(*) AS n FROM a GROUP BY 1, 2"""


def pipeline_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures of a user take the nearest free return within six hours, in order; checked by a brute-force test."""
    from cuelake.operators.pairing import greedy_events

    events = _events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    side = lambda kind: events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "at")
    found = greedy_events(side("signup"), side("purchase"), ["user_id"], 21600.0)
    return found.select("user_id", "left_id", "right_id", F.round(F.col("distance") * 1e6).cast("long").alias("distance_us"))


QUERIES["pipeline_greedy"] = pipeline_greedy
