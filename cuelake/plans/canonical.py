"""The operators on a canonical projection of order and event tables, each with SQL that gives the same rows.

A channel is events.user_id in the order of ts and event_id; a signup is a departure, a purchase a return, views and
clicks are programme segments, an error is a failed poll, value is seconds. An order is a signalled avail, its line items
are what was stitched into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions.text import attribute, attributes, codec_family, fill_template, iso_duration, media_shape
from cuelake.operators.pairing import consecutive, contained, coverage, latest, nearest, paired
from cuelake.plans.hls import overlapping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Windows of fixed time for the containment query: (name, first day, day after the last).
WINDOWS = (("week1", "2024-01-01", "2024-01-08"), ("week2", "2024-01-08", "2024-01-15"), ("late", "2024-01-20", "2024-02-01"))
RADIUS = 6 * 3600


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a time without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _signals(events: DataFrame) -> DataFrame:
    polarity = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 0)
    return events.withColumn("polarity", polarity).where("polarity is not null")


_PAIR = """
s AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS p FROM events WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT *, lead(p) OVER w AS nx, lag(p) OVER w AS pv, lead(event_id) OVER w AS nid,
             max(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"WITH {_PAIR} SELECT user_id, event_id, coalesce(nx = 0, false) AS closed, coalesce(pv = 1, false) AS nested, CASE WHEN nx = 0 THEN nid END AS return_id FROM l WHERE p = 1")
def break_pairing(spark, sf_dir):
    found = paired(_signals(_events(spark, sf_dir)), ["user_id"], ["ts", "event_id"]).where("polarity = 1")
    return found.select("user_id", "event_id", "closed", "nested", F.when(F.col("closed"), F.col("next_event.event_id")).alias("return_id"))


@query(f"WITH {_PAIR} SELECT user_id, event_id, CASE WHEN seen = 1 THEN 'error' ELSE 'info' END AS severity FROM l WHERE p = 0 AND coalesce(pv <> 1, true)")
def orphan_returns(spark, sf_dir):
    found = paired(_signals(_events(spark, sf_dir)), ["user_id"], ["ts", "event_id"]).where("orphan")
    return found.select("user_id", "event_id", F.when(F.col("seen"), "error").otherwise("info").alias("severity"))


@query(
    f"""WITH {_PAIR},
c AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type IN ('view', 'click') THEN CAST(round(value * 1000) AS BIGINT) ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT l.user_id, l.event_id, CAST(b.run - a.run AS BIGINT) AS extent_ms FROM l JOIN c a ON a.event_id = l.event_id JOIN c b ON b.event_id = l.nid WHERE l.p = 1 AND l.nx = 0"""
)
def break_extent(spark, sf_dir):
    events = _events(spark, sf_dir)
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("event_type").isin("view", "click"), F.round(F.col("value") * 1000).cast("long")).otherwise(0)
    run = events.withColumn("run", F.sum(size).over(by))
    found = paired(_signals(run), ["user_id"], ["ts", "event_id", "run"]).where("polarity = 1 and closed")
    return found.select("user_id", "event_id", (F.col("next_event.run") - F.col("run")).alias("extent_ms"))


@query(
    """SELECT user_id, event_id, CAST(last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS anchor_id FROM events"""
)
def programme_interpolation(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return _events(spark, sf_dir).select("user_id", "event_id", F.last(view, ignorenulls=True).over(by).alias("anchor_id"))


@query(
    """SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS gap
FROM events) WHERE gap > 86400000000"""
)
def pdt_discontinuity(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).select("user_id", "event_id", gap.alias("gap")).where("gap > 86400000000")


_FILL = """
st AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY l_orderkey),
a AS (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS want, st.cents AS got,
             CASE WHEN st.cents IS NULL THEN 'not-stitched' WHEN abs(st.cents - CAST(round(o_totalprice * 100) AS BIGINT)) * 20 <= CAST(round(o_totalprice * 100) AS BIGINT) THEN 'filled'
                  WHEN st.cents < CAST(round(o_totalprice * 100) AS BIGINT) THEN 'under-filled' ELSE 'over-filled' END AS status
      FROM orders LEFT JOIN st ON l_orderkey = o_orderkey)"""


def _avails(spark, sf_dir) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    stitched = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("got"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", cents("o_totalprice").alias("want"))
    rows = rows.join(stitched, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    near = F.abs(F.col("got") - F.col("want")) * 20 <= F.col("want")
    status = F.when(F.col("got").isNull(), "not-stitched").when(near, "filled").when(F.col("got") < F.col("want"), "under-filled").otherwise("over-filled")
    return rows.withColumn("status", status)


@query(f"WITH {_FILL[1:]} SELECT status, count(*) AS n, CAST(sum(want) AS BIGINT) AS signalled, CAST(coalesce(sum(got), 0) AS BIGINT) AS stitched FROM a GROUP BY status")
def fill_status(spark, sf_dir):
    return _avails(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("want").alias("signalled"), F.coalesce(F.sum("got"), F.lit(0)).alias("stitched"))


@query(f"WITH {_FILL[1:]} SELECT o_orderpriority, round(sum(CASE WHEN got IS NOT NULL THEN got ELSE 0 END) / sum(want), 6) AS fill_rate, count(*) AS avails FROM a GROUP BY o_orderpriority")
def fill_rate(spark, sf_dir):
    rows = _avails(spark, sf_dir).groupBy("o_orderpriority")
    return rows.agg(F.round(F.sum(F.coalesce("got", F.lit(0))) / F.sum("want"), 6).alias("fill_rate"), F.count("*").alias("avails"))


@query(
    """SELECT l_orderkey, count(*) AS items FROM lineitem WHERE NOT EXISTS
(SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F') GROUP BY l_orderkey"""
)
def unsignalled_output(spark, sf_dir):
    signalled = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(signalled, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("items"))


_NEAR = f"""
a AS (SELECT user_id, event_id AS break_id, epoch_us(ts) AS t FROM events WHERE event_type = 'signup'),
b AS (SELECT user_id, event_id AS view_id, epoch_us(ts) AS u FROM events WHERE event_type = 'view'),
m AS (SELECT a.user_id, a.break_id, b.view_id, abs(b.u - a.t) AS gap,
             row_number() OVER (PARTITION BY a.break_id ORDER BY abs(b.u - a.t), b.view_id) AS n
      FROM a JOIN b ON a.user_id = b.user_id AND abs(b.u - a.t) <= {RADIUS}000000)"""


def _near(spark, sf_dir, how: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    breaks = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("break_id"), F.col("at").alias("t"))
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("u"))
    return nearest(breaks, views, ["user_id"], "t", "u", "break_id", "view_id", RADIUS * 1_000_000, how)


@query(f"WITH {_NEAR[1:]} SELECT user_id, break_id, view_id, CAST(gap AS BIGINT) AS gap FROM m WHERE n = 1")
def nearest_break(spark, sf_dir):
    return _near(spark, sf_dir, "inner").select("user_id", "break_id", "view_id", "gap")


@query(f"WITH {_NEAR[1:]} SELECT user_id, break_id FROM a WHERE break_id NOT IN (SELECT break_id FROM m)")
def missing_break(spark, sf_dir):
    return _near(spark, sf_dir, "left").where("view_id is null").select("user_id", "break_id")


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type),
r AS (SELECT event_type, n AS ref FROM c WHERE user_id = (SELECT min(user_id) FROM events))
SELECT c.user_id, c.event_type, c.n, coalesce(r.ref, 0) AS ref FROM c LEFT JOIN r ON c.event_type = r.event_type WHERE c.n <> coalesce(r.ref, 0)"""
)
def variant_count_mismatch(spark, sf_dir):
    counts = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    first = counts.agg(F.min("user_id").alias("first"))
    ref = counts.join(F.broadcast(first), F.col("user_id") == F.col("first")).select("event_type", F.col("n").alias("ref"))
    both = counts.join(F.broadcast(ref), "event_type", "left").withColumn("ref", F.coalesce("ref", F.lit(0)).cast("long"))
    return both.where("n <> ref").select("user_id", "event_type", "n", "ref")


@query(
    """SELECT style, count(*) AS users FROM (SELECT user_id, string_agg(event_type, '+' ORDER BY event_type) AS style
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id) GROUP BY style"""
)
def signalling_style(spark, sf_dir):
    style = F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("style")
    return _events(spark, sf_dir).groupBy("user_id").agg(style).groupBy("style").agg(F.count("*").alias("users"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))
    return found.where("n > 1")


_SEVERITY = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END"


def _graded(events: DataFrame) -> DataFrame:
    return events.withColumn("severity", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info"))


@query(
    f"""SELECT severity, event_type, n, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, first_id) AS INTEGER) AS place
FROM (SELECT {_SEVERITY} AS severity, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2)"""
)
def marker_groups_printed(spark, sf_dir):
    many = _graded(_events(spark, sf_dir)).groupBy("severity", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    # one row an event type is left to be ordered
    return many.select("severity", "event_type", "n", F.row_number().over(Window.orderBy(rank, "first_id")).alias("place"))


@query(
    """WITH i AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
r AS (SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i)
SELECT user_id, event_id, streak FROM r WHERE streak >= 2"""
)
def consecutive_failures(spark, sf_dir):
    found = consecutive(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")
    return found.where("streak >= 2").select("user_id", "event_id", "streak")


_RANK = "CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END"


@query(
    f"""WITH r AS (SELECT user_id, event_id, {_RANK} AS now, lag({_RANK}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT user_id, event_id, CASE WHEN now > old THEN 'VERDICT_DEGRADED' ELSE 'ERRORS_CLEARED' END AS code FROM r WHERE now > old OR (now = 0 AND old = 2)"""
)
def transition_alerts(spark, sf_dir):
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    old = F.lag("now").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _events(spark, sf_dir).withColumn("now", rank).withColumn("old", old)
    code = F.when(F.col("now") > F.col("old"), "VERDICT_DEGRADED").when((F.col("now") == 0) & (F.col("old") == 2), "ERRORS_CLEARED")
    return rows.select("user_id", "event_id", code.alias("code")).where("code is not null")


@query(
    f"""WITH {_PAIR}, z AS (SELECT user_id, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id)
SELECT l.user_id, l.event_id, CAST(z.last_us - epoch_us(l.ts) AS BIGINT) AS open_us FROM l JOIN z ON z.user_id = l.user_id
WHERE l.p = 1 AND l.nx IS NULL AND z.last_us - epoch_us(l.ts) > (l.value + 60) * 1000000"""
)
def stuck_breaks(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    last = events.groupBy("user_id").agg(F.max("us").alias("last_us"))
    open_ = paired(_signals(events), ["user_id"], ["ts", "event_id"]).where("polarity = 1 and next_event is null")
    late = open_.join(last, "user_id").withColumn("open_us", F.col("last_us") - F.col("us"))
    return late.where(F.col("open_us") > (F.col("value") + 60) * 1_000_000).select("user_id", "event_id", "open_us")


@query(
    """SELECT user_id, event_type, min(event_id) AS first_id, max(epoch_us(ts)) AS last_seen, CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS closed,
CAST(arg_max(event_id, event_id) FILTER (WHERE value > 50) AS BIGINT) AS last_large FROM events GROUP BY user_id, event_type"""
)
def open_break_upsert(spark, sf_dir):
    large = F.when(F.col("value") > 50, F.col("event_id"))
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(
        F.min("event_id").alias("first_id"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_seen"),
        F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("closed"), F.max(large).alias("last_large"),
    )


@query(
    """SELECT user_id, count(*) AS polls, CAST(max(gap) AS BIGINT) AS longest_us FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
FROM events) GROUP BY user_id"""
)
def coverage_gap(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = _events(spark, sf_dir).select("user_id", (at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap"))
    return gaps.groupBy("user_id").agg(F.count("*").alias("polls"), F.max("gap").alias("longest_us"))


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t FROM events WHERE epoch_us(ts) BETWEEN epoch_us(TIMESTAMP '2024-01-01') AND epoch_us(TIMESTAMP '2024-01-31')),
w AS (SELECT epoch_us(TIMESTAMP '2024-01-01') / 1000000.0 AS a, epoch_us(TIMESTAMP '2024-01-31') / 1000000.0 AS b),
g AS (SELECT user_id, t, t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t), a + 21600) AS gap, b FROM e, w)
SELECT user_id, count(*) AS polls, CAST(120 AS BIGINT) AS expected, round(least(1.0, count(*) / 120.0), 6) AS ratio,
CAST(greatest(0, floor(greatest(max(gap), max(b) - max(t)) + 0.5)) AS BIGINT) AS longest_gap FROM g GROUP BY user_id"""
)
def coverage_ratio(spark, sf_dir):
    start, end = (F.lit(x).cast("double") for x in (1704067200, 1706659200))
    polls = _events(spark, sf_dir).select("user_id", _seconds().alias("t"))
    return coverage(polls, "user_id", "t", 21600.0, start, end).withColumn("ratio", F.round("ratio", 6))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def keep_latest(spark, sf_dir):
    return latest(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_run(spark, sf_dir):
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return last.select("user_id", "x.event_id", "x.event_type")


_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '\d+', '*', 'g')"


@query(f"SELECT shape, count(*) AS pages FROM (SELECT {_SHAPE} AS shape FROM pages) GROUP BY shape")
def media_shapes(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(media_shape(F.col("url")).alias("shape")).agg(F.count("*").alias("pages"))


_HOST = r"regexp_extract(url, '^[a-z]+://([^/]*)', 1)"


@query(
    f"""WITH s AS (SELECT {_HOST} AS host, list_sort(list_distinct(list({_SHAPE}))) AS shapes FROM pages GROUP BY 1), b AS (SELECT list({_SHAPE}) AS base FROM pages WHERE url LIKE '%/en/%')
SELECT host, len(shapes) AS shapes, len(list_intersect(shapes, base)) > 0 AS same_media FROM s, b"""
)
def substitution_overlap(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), "url", media_shape(F.col("url")).alias("shape"))
    shapes = pages.select("host", "shape").distinct()
    english = pages.where("url like '%/en/%'").select("shape").distinct().withColumn("english", F.lit(True))
    both = shapes.join(english, "shape", "left").groupBy("host")
    return both.agg(F.count("*").alias("shapes"), F.coalesce(F.bool_or("english"), F.lit(False)).alias("same_media"))


@query("""SELECT lang, count(*) AS pages FROM (SELECT regexp_extract(html, '<html [^>]*lang="([^"]*)"', 1) AS lang FROM pages) GROUP BY lang""")
def attribute_list(spark, sf_dir):
    tag = F.regexp_extract("html", "<html ([^>]*)>", 1)
    lang = F.coalesce(attribute(attributes(tag), "LANG"), F.lit(""))
    return table(spark, sf_dir, "pages").groupBy(lang.alias("lang")).agg(F.count("*").alias("pages"))


@query("SELECT p_partkey, 'seg-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(6, len(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') || '-' || CAST(p_size AS VARCHAR) || '-$.m4s' AS uri FROM part")
def template_fill(spark, sf_dir):
    uri = fill_template(F.lit("seg-$Number%06d$-$Bandwidth$-$$.m4s"), Number=F.col("p_partkey"), Bandwidth=F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", uri.alias("uri"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 3600 + CAST(l_quantity AS INTEGER) * 60 + 1.5 AS DOUBLE) AS seconds FROM lineitem")
def duration_parse(spark, sf_dir):
    text = F.concat(F.lit("PT"), F.col("l_linenumber").cast("string"), F.lit("H"), F.col("l_quantity").cast("int").cast("string"), F.lit("M1.5S"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", iso_duration(text).alias("seconds"))


@query(
    """SELECT s_suppkey, CASE WHEN k = 0 THEN 'UPID_TYPE_NOT_USED' WHEN k = 8 AND len(s_name) <> 8 THEN 'UPID_WRONG_LENGTH'
WHEN k = 3 AND NOT regexp_full_match(s_name, '[A-Z0-9]{11,12}') THEN 'UPID_MALFORMED_ADID' WHEN k = 12 AND len(s_name) <= 4 THEN 'UPID_MPU_NO_PRIVATE_DATA' END AS problem
FROM (SELECT s_suppkey, s_name, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 8 ELSE 12 END AS k FROM supplier)"""
)
def upid_validate(spark, sf_dir):
    from cuelake.functions.splice import upid_problem

    part = F.col("s_suppkey") % 4
    kind = F.when(part == 0, 0).when(part == 1, 3).when(part == 2, 8).otherwise(12)
    return table(spark, sf_dir, "supplier").select("s_suppkey", upid_problem(kind, F.hex(F.encode("s_name", "UTF-8")), F.col("s_name")).alias("problem"))


@query(
    """SELECT family, count(*) AS parts FROM (SELECT CASE WHEN c LIKE 'avc1%' THEN 'h264' ELSE regexp_extract(c, '^[^.]*') END AS family
FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'avc1.64001f' WHEN 1 THEN 'mp4a.40.2' WHEN 2 THEN 'ec-3' ELSE lower(p_brand) || '.x' END AS c FROM part)) GROUP BY family"""
)
def codec_families(spark, sf_dir):
    part = F.col("p_size") % 4
    codec = F.when(part == 0, "avc1.64001f").when(part == 1, "mp4a.40.2").when(part == 2, "ec-3").otherwise(F.concat(F.lower("p_brand"), F.lit(".x")))
    return table(spark, sf_dir, "part").groupBy(codec_family(codec).alias("family")).agg(F.count("*").alias("parts"))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM o WHERE n <= 4 OR i IN (0, floor((n - 1) / 3.0 + 0.5), floor(2 * (n - 1) / 3.0 + 0.5), n - 1)"""
)
def spread_sample(spark, sf_dir):
    return spread(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 4).select("o_custkey", "o_orderkey")


def spread(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Of each key's rows in order, n that are evenly spread, first and last included; all, if there are no more."""
    by = Window.partitionBy(*keys).orderBy(*order)
    total = F.count("*").over(Window.partitionBy(*keys))
    marked = rows.withColumns({"_i": F.row_number().over(by) - 1, "_n": total})
    places = [F.floor(F.lit(k) * (F.col("_n") - 1) / F.lit(float(n - 1)) + 0.5) for k in range(n)]
    return marked.where((F.col("_n") <= n) | F.col("_i").isin(*places)).drop("_i", "_n")


@query(
    """SELECT o_custkey, o_orderkey, CAST(epoch_us(lead(o_orderdate) OVER w) - epoch_us(o_orderdate) AS BIGINT) AS gap FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def period_gap(spark, sf_dir):
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.lead(at).over(by) - at).alias("gap"))


@query(
    """SELECT l_orderkey, l_linenumber, s AS signature FROM (SELECT l_orderkey, l_linenumber, s, lag(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, s) AS p
FROM (SELECT *, l_returnflag || '/' || l_linestatus AS s FROM lineitem)) WHERE s <> p"""
)
def structural_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("signature", F.concat_ws("/", "l_returnflag", "l_linestatus"))
    before = F.lag("signature").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "signature"))
    return rows.withColumn("before", before).where("signature <> before").select("l_orderkey", "l_linenumber", "signature")


@query(
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, epoch_us(ts) AS a, lag(epoch_us(ts) + CAST(round(value * 600) AS BIGINT) * 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e
FROM events WHERE event_type = 'view') WHERE a < e - 500000"""
)
def interstitial_overlap(spark, sf_dir):
    views = _events(spark, sf_dir).where("event_type = 'view'")
    rows = views.withColumns({"a": F.unix_micros(F.col("ts").cast("timestamp")), "size": F.round(F.col("value") * 600).cast("long") * 1_000_000})
    return overlapping(rows, ["user_id"], "a", "size", ["ts", "event_id"], 500_000).where("overlaps").select("user_id", "event_id")


@query(
    """WITH w AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY user_id)
SELECT user_id // 10 AS stream, max(a) AS overlap_start, min(b) AS overlap_end, min(b) > max(a) AS common FROM w GROUP BY 1"""
)
def window_overlap(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = _events(spark, sf_dir).groupBy("user_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    found = own.groupBy(F.expr("user_id div 10").alias("stream")).agg(F.max("a").alias("overlap_start"), F.min("b").alias("overlap_end"))
    return found.withColumn("common", F.col("overlap_end") > F.col("overlap_start"))


@query(
    f"""SELECT user_id, errors, warnings, infos, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM (SELECT user_id,
count(*) FILTER (WHERE s = 'error') AS errors, count(*) FILTER (WHERE s = 'warning') AS warnings, count(*) FILTER (WHERE s = 'info') AS infos
FROM (SELECT user_id, {_SEVERITY} AS s FROM events) GROUP BY user_id)"""
)
def verdict_summary(spark, sf_dir):
    from cuelake.operators.findings import verdicts

    events = _events(spark, sf_dir)
    return verdicts(events, _graded(events), "user_id")


@query(
    """SELECT code, user_id, count(*) AS n FROM (SELECT 'LONG' AS code, user_id FROM events WHERE value > 90 UNION ALL SELECT 'FAILED', user_id FROM events WHERE event_type = 'error') GROUP BY 1, 2"""
)
def union_findings(spark, sf_dir):
    from cuelake.operators.findings import emit, rule

    rules = [rule(F.col("value") > 90, "warning", "LONG"), rule(F.col("event_type") == "error", "error", "FAILED")]
    return emit(_events(spark, sf_dir), rules, ("user_id",)).groupBy("code", "user_id").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events),
s AS (SELECT user_id, day, list_sort(list(event_type)) AS codes FROM d GROUP BY 1, 2),
l AS (SELECT *, lag(codes) OVER (PARTITION BY user_id ORDER BY day) AS old FROM s)
SELECT user_id, CAST(day AS VARCHAR) AS day, array_to_string(list_sort(list_filter(old, lambda x: NOT list_contains(codes, x))), ',') AS cleared FROM l
WHERE old IS NOT NULL AND len(list_filter(old, lambda x: NOT list_contains(codes, x))) > 0"""
)
def cleared_codes(spark, sf_dir):
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("codes"))
    old = F.lag("codes").over(Window.partitionBy("user_id").orderBy("day"))
    cleared = days.withColumn("cleared", F.array_except(old, F.col("codes"))).where(F.size("cleared") > 0)
    return cleared.select("user_id", F.col("day").cast("string").alias("day"), F.array_join(F.array_sort("cleared"), ",").alias("cleared"))


@query(
    "WITH w(name, a, b) AS (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in WINDOWS) + ") "
    "SELECT name, event_type, count(*) AS n FROM events JOIN w ON ts >= a AND ts < b GROUP BY 1, 2"
)
def interval_containment(spark, sf_dir):
    spans = spark.createDataFrame(WINDOWS, "name string, a string, b string").selectExpr("name", "cast(a as timestamp_ntz) a", "cast(b as timestamp_ntz) b")
    return contained(_events(spark, sf_dir), F.broadcast(spans), "ts", "a", "b").groupBy("name", "event_type").agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey, n_name, r_name, CAST(CASE WHEN r_regionkey IS NULL THEN 1 ELSE 2 END AS INTEGER) AS hops FROM customer
JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
)
def wrapper_chain(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("c_custkey", "n_name", "r_name", F.when(F.col("r_regionkey").isNull(), 1).otherwise(2).alias("hops"))
