"""python -m cuelake PATH, or python -m cuelake compare SOURCE OUTPUT: findings of playlists and manifests, or of a stitched output
against its feed. Exit code 0: passed or warned; 1: failed; 2: not readable."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators.findings import grouped
from cuelake.plans import dash, hls, report, stitching
from cuelake.runtime import ship
from cuelake.sources import landed

PLANS = {"hls": hls, "dash": dash}


def _printed(findings: DataFrame, key: str, as_json: bool) -> bool:
    """Print findings by code, gravest first; whether there is an error among them."""
    lines = grouped(findings, key).orderBy(key, "rank", "code")
    shown = lines.select(F.to_json(F.struct("*")) if as_json else F.concat_ws("  ", "severity", "code", F.col("n").cast("string"), F.col(key).cast("string")), "severity")
    failed = False
    for text, severity in shown.toLocalIterator():
        print(text)
        failed |= severity == "error"
    return failed


def _read(spark: SparkSession, path: str) -> DataFrame:
    return landed.manifests(spark, path).withColumn("protocol", landed.protocol(F.col("body")))


def analyse(spark: SparkSession, path: str, as_json: bool) -> int:
    docs = _read(spark, path).persist()
    known = {r[0] for r in docs.select("protocol").distinct().collect()}
    worst = 0 if known & set(PLANS) else 2
    for name, plan in PLANS.items():
        if name in known:
            own = plan.analyse(docs.where(F.col("protocol") == name))
            worst = max(worst, int(_printed(own.coded, "doc_id", as_json)))
            own.release()
    docs.unpersist()
    return worst


def compare(spark: SparkSession, source: str, output: str, as_json: bool, markdown: bool) -> int:
    """A feed against its stitched output, each a playlist or a manifest."""
    sides = [_read(spark, path).select("body", "protocol").limit(2).collect() for path in (source, output)]
    if any(len(x) != 1 or x[0]["protocol"] not in PLANS for x in sides):
        return 2
    parts: dict[str, list[DataFrame]] = {"breaks": [], "stats": [], "segments": []}
    analyses = []
    for name, (row,) in zip(("source", "output"), sides, strict=True):
        own = PLANS[row["protocol"]].analyse(landed.pasted(spark, {name: row["body"]}))
        analyses.append(own)
        parts["breaks"].append(own.breaks.select("doc_id", "index", "start_time", "pdt", "event_id", "segmentation_type", "signalled_duration", "actual_duration", "discontinuity_at_start", "window_clipped", "media_uris", "signal"))
        parts["stats"].append(own.stats.select("doc_id", "window_start_pdt", "window_end_pdt"))
        if row["protocol"] == "hls":
            media = own.segments.select("doc_id", "uri")
        else:
            media = own.breaks.select("doc_id").limit(0).select("doc_id", F.lit(None).cast("string").alias("uri"))
        parts["segments"].append(media)
    breaks, stats, media = (a.unionByName(b) for a, b in parts.values())
    pairs = spark.createDataFrame([("pair", "source", "output")], "pair_id string, source_id string, output_id string")
    found = stitching.compare(pairs, breaks, stats, media)
    if markdown:
        print(report.comparison(found.avails, found.findings, found.summary).first()["report"])
        failed = not found.findings.where("severity = 'error'").isEmpty()
    else:
        failed = _printed(found.findings, "pair_id", as_json)
        row = found.summary.first()
        if not as_json:
            print(f"fill rate {row['fill_rate'] * 100:.1f} %, {row['signalled']} avails")
    for own in analyses:
        own.release()
    return int(failed)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cuelake", description=__doc__)
    parser.add_argument("paths", nargs="+", help="a file or folder that Spark can read; or: compare SOURCE OUTPUT")
    parser.add_argument("--json", action="store_true", help="print findings as JSON lines")
    parser.add_argument("--markdown", action="store_true", help="of compare: print a report")
    given = parser.parse_args(arguments)
    comparing = given.paths[0] == "compare" and len(given.paths) == 3
    if not comparing and len(given.paths) != 1:
        parser.error("give one path, or compare SOURCE OUTPUT")
    spark = ship(SparkSession.builder.appName("cuelake").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if comparing:
        return compare(spark, *given.paths[1:], given.json, given.markdown)
    return analyse(spark, given.paths[0], given.json)


if __name__ == "__main__":
    raise SystemExit(main())
