"""Findings as rows: all rules of one grain are conditions in one select, exploded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import number_text
from cuelake.operators.texts import DETAILS

FINDING = "struct<severity string, code string, line_number int, break_index int, at_time double>"


def rule(when: Column, severity: str | Column, code: str | Column, line: Column | None = None, index: Column | None = None, at: Column | None = None) -> Column:
    """A finding where the condition holds, else null."""
    of = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    found = F.struct(
        as_column(severity).alias("severity"), as_column(code).alias("code"), of(line, "int").alias("line_number"), of(index, "int").alias("break_index"), of(at, "double").alias("at_time")
    )
    return F.when(F.coalesce(when, F.lit(False)), found)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: What codes mean, as one constant map.
_MEANINGS = "map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in DETAILS.items()) + ")"


def told(findings: DataFrame) -> DataFrame:
    """Findings with a title, the code in words, and a detail: what the code means, and where it was found. Details are
    looked up here, once for all rules, and not carried by each."""
    place = [(" Line ", F.col("line_number").cast("string"), "."), (" Break ", F.col("break_index").cast("string"), "."), (" At ", number_text(F.col("at_time")), " s.")]
    where = [F.when(F.col(n).isNotNull(), F.concat(F.lit(a), c, F.lit(b))).otherwise("") for n, (a, c, b) in zip(("line_number", "break_index", "at_time"), place, strict=True)]
    title = F.lower(F.replace(F.col("code"), F.lit("_"), F.lit(" ")))
    detail = F.concat(F.try_element_at(F.expr(_MEANINGS), F.col("code")), *where)
    keys = [c for c in findings.columns if c not in ("severity", "code", "line_number", "break_index", "at_time")]
    return findings.select(*keys, "severity", "code", title.alias("title"), detail.alias("detail"), "line_number", "break_index", "at_time")


def emit(rows: DataFrame, rules: list[Column], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, and the fields of every finding that holds; ``told`` says what they mean."""
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rows.select(*keys, F.inline(found))


def emit_array(rows: DataFrame, findings: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return rows.select(*keys, F.inline(F.filter(findings, lambda x: x.isNotNull())))


def verdicts(docs: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by severity and the verdict of every document, those without findings included."""
    many = findings.groupBy(key).agg(
        *[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))]
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    full = docs.select(key).distinct().join(many, key, "left").select(key, zero("errors"), zero("warnings"), zero("infos"))
    return full.withColumn("verdict", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))


def grouped(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings of a document by severity, code and title with their number, gravest first."""
    if "title" not in findings.columns:
        findings = told(findings)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    many = findings.groupBy(key, "severity", "code", "title").agg(F.count("*").alias("n"), F.min("line_number").alias("first_line"), *([F.min("detail").alias("detail")] if "detail" in findings.columns else []))
    return many.withColumn("rank", rank)
