"""Markdown reports, one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import number_text
from cuelake.operators.findings import grouped


def _lines(rows: DataFrame, key: str, order: list, line: Column, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n").alias(name))


def cell(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\|", r"\\|")


def markdown(verdicts: DataFrame, stats: DataFrame, breaks: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, report): verdict, what was checked, findings by severity, and a table of breaks."""
    many = F.when(F.col("n") > 1, F.concat(F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise("")
    where = F.when(F.col("first_line").isNotNull(), F.concat(F.lit(", line "), F.col("first_line").cast("string"))).otherwise("")
    found = _lines(grouped(findings), "doc_id", ["rank", "code"], F.concat(F.lit("- "), "severity", F.lit(" `"), "code", F.lit("`"), many, where, F.coalesce(F.concat(F.lit(": "), F.col("detail")), F.lit(""))), "_findings")
    row = F.concat(
        F.lit("| "), F.concat_ws(" | ", F.col("index").cast("string"), number_text(F.col("start_time")), number_text(F.col("signalled_duration")), number_text(F.col("actual_duration")), F.when(F.col("closed"), "yes").otherwise("no"), cell(F.col("event_id").cast("string"))), F.lit(" |")
    )
    table = _lines(breaks, "doc_id", ["index"], row, "_breaks")
    full = verdicts.join(stats.select("doc_id", "segment_count", "window_duration", "break_count", "ad_percent"), "doc_id", "left").join(found, "doc_id", "left").join(table, "doc_id", "left")
    text = F.concat(
        F.lit("# Ad signalling report\n\n**Document:** "), F.col("doc_id").cast("string"), F.lit("  \n**Verdict:** "), F.upper("verdict"), F.format_string(" (%d errors, %d warnings, %d notes)", "errors", "warnings", "infos"),
        F.lit("\n\n## Checked\n\n"), F.format_string("- %d segments over %s s\n- %d breaks, %s %% of the time", F.coalesce("segment_count", F.lit(0)), number_text(F.coalesce("window_duration", F.lit(0.0)), 1), F.coalesce("break_count", F.lit(0)), number_text(F.coalesce("ad_percent", F.lit(0.0)), 1)),
        F.lit("\n\n## Findings\n\n"), F.coalesce("_findings", F.lit("None.")),
        F.coalesce(F.concat(F.lit("\n\n## Breaks\n\n| # | start | signalled | actual | closed | event |\n|-|-|-|-|-|-|\n"), "_breaks"), F.lit("")), F.lit("\n"),
    )
    return full.select("doc_id", text.alias("report"))


def comparison(avails: DataFrame, findings: DataFrame, summary: DataFrame) -> DataFrame:
    """(pair_id, report): fill of a stitched output, its findings, and a table of avails."""
    many = F.when(F.col("n") > 1, F.concat(F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise("")
    found = _lines(grouped(findings, "pair_id"), "pair_id", ["rank", "code"], F.concat(F.lit("- "), "severity", F.lit(" `"), "code", F.lit("`"), many, F.coalesce(F.concat(F.lit(": "), F.col("detail")), F.lit(""))), "_findings")
    shown = [F.col("index").cast("string"), number_text(F.col("start_time")), number_text(F.col("signalled")), number_text(F.col("stitched")), number_text(F.col("delta")), number_text(F.col("alignment")), F.col("status")]
    table = _lines(avails, "pair_id", ["start_time", "index"], F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")), "_avails")
    full = summary.join(found, "pair_id", "left").join(table, "pair_id", "left")
    text = F.concat(
        F.lit("# Stitching report\n\n**Pair:** "), F.col("pair_id").cast("string"),
        F.format_string("  \n**Fill:** %s %% (%s of %s s, %d avails)", number_text(F.col("fill_rate") * 100, 1), number_text(F.col("stitched_seconds")), number_text(F.col("signalled_seconds")), "signalled"),
        F.format_string("\n\n- %d filled, %d under-filled, %d over-filled, %d passed through, %d not stitched, %d unsignalled", "filled", "under_filled", "over_filled", "passthrough", "not_stitched", "unsignalled"),
        F.lit("\n\n## Findings\n\n"), F.coalesce("_findings", F.lit("None.")),
        F.coalesce(F.concat(F.lit("\n\n## Avails\n\n| # | start | signalled | stitched | difference | offset | status |\n|-|-|-|-|-|-|-|\n"), "_avails"), F.lit("")), F.lit("\n"),
    )
    return full.select("pair_id", text.alias("report"))


def file_name(uri: Column, extension: str, at: Column) -> Column:
    """A file name from an address and a time: host and path without what a file name can't hold."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", ""), r"[^A-Za-z0-9]+", "-")
    return F.concat(F.substring(F.regexp_replace(plain, "^-|-$", ""), 1, 60), F.lit("-"), F.date_format(at, "yyyyMMdd-HHmm"), F.lit(f".{extension}"))
