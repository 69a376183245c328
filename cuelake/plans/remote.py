"""Remote periods of manifests, resolved against a table of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators.findings import emit, rule
from cuelake.sources import dash

MOST, LATE_MS, LENGTH = 6, 2000.0, 0.5


def resolve(periods: DataFrame, sets: DataFrame, fetched: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Resolutions and findings for the first ``most`` remote periods of each manifest; ``fetched`` has (href, ok, body, ms).
    A manifest with more of them has a finding that says so."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("period_index"))
    numbered = periods.where("xlink_href is not null").withColumn("_n", order)
    asked = numbered.where(F.col("_n") <= most)
    beyond = emit(numbered.where(F.col("_n") == most + 1), [rule(F.lit(True), "info", "XLINK_NOT_RESOLVED")])
    asked = asked.select("doc_id", "period_index", F.col("xlink_href").alias("href"), "declared_duration").join(fetched, "href", "left")
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("period_index").cast("string"))
    good = F.coalesce(F.col("ok"), F.lit(False)) & (F.length(F.coalesce("body", F.lit(""))) > 0)
    xml = F.trim(F.regexp_replace(F.trim("body"), r"^<\?xml[^>]*\?>", ""))
    whole = F.when(xml.rlike(r"<(?:[\w-]+:)?MPD[\s>]"), xml).otherwise(F.concat(F.lit('<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static">'), xml, F.lit("</MPD>")))
    asked = asked.withColumns({"good": good, "readable": good & xml.startswith("<"), "key": key})
    parsed = dash.parsed(asked.where("readable").select(F.col("key").alias("doc_id"), whole.alias("body")))
    theirs = dash.adaptation_sets(parsed)
    found = dash.periods(parsed, theirs).groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("periods"), F.sum(F.coalesce("declared_duration", "media_duration")).alias("seconds"))
    shapes = lambda rows, name: rows.select(name, F.explode(F.split("signature", r"\|")).alias("shape")).where("shape <> ''").groupBy(name).agg(F.collect_set("shape").alias("shapes"))
    # both grow with the manifests, however small the file of the periods' numbers is: not to be broadcast
    content = shapes(sets.join(periods.where("not is_placeholder").select("doc_id", "period_index").hint("merge"), ["doc_id", "period_index"]), "doc_id").withColumnRenamed("shapes", "content")
    own = shapes(theirs.withColumnRenamed("doc_id", "key"), "key")
    rows = asked.join(found, "key", "left").join(own, "key", "left").join(content, "doc_id", "left").withColumn("periods", F.coalesce("periods", F.lit(0)))
    shared = (F.size("shapes") > 0) & (F.size("content") > 0) & ~F.arrays_overlap("shapes", "content")
    done = F.col("readable")
    out = emit(
        rows,
        [
            rule(~F.col("good"), "error", "XLINK_RESOLVE_FAILED"),
            rule(F.col("good") & ~done, "error", "XLINK_RESOLVE_UNPARSEABLE"),
            rule(done & (F.col("periods") == 0), "warning", "XLINK_RESOLVED_EMPTY"),
            rule(done & (F.col("ms") > LATE_MS), "warning", "XLINK_RESOLVE_SLOW"),
            rule(done & (F.col("seconds") > 0) & (F.abs(F.col("seconds") - F.col("declared_duration")) > LENGTH), "error", "XLINK_DURATION_MISMATCH"),
            rule(done & shared, "warning", "XLINK_CODEC_MISMATCH"),
        ],
    )
    return rows.select("doc_id", "period_index", "href", "good", "ms", "declared_duration", "periods", "seconds"), out.unionByName(beyond)
