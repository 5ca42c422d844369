"""Reports over findings: per document, totals, exit status, text and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_document(checked: DataFrame, keys=("doc_id",)) -> DataFrame:
    """keys, errors, warnings, suppressed; clean documents too. checked: documents with findings and suppressed."""
    count = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long")
    return checked.select(*keys, count("error").alias("errors"), count("warning").alias("warnings"), F.col("suppressed").cast("long").alias("suppressed"))


def totals(report: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return report.agg(F.count(F.lit(1)).alias("documents"), total("errors"), total("warnings"), total("suppressed"))


def exit_status(total: DataFrame, strict: bool = False) -> DataFrame:
    """status 1 with errors, or under strict with warnings, else 0."""
    bad = (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    return total.select(bad.cast("int").alias("status"))


FIELDS = ("line", "col", "severity", "rule", "match", "message")


def quoted(text: Column) -> Column:
    """The text in quotes, escaped as a Python literal: single quotes unless it holds these and no double ones."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(c), F.lit(name))
    single, double = F.contains(t, F.lit("'")), F.contains(t, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))


def text_lines(findings: DataFrame, path: str = "path") -> DataFrame:
    """path:line:col [severity] rule: message  ->  'match'."""
    return findings.select(F.format_string("%s:%d:%d [%s] %s: %s  ->  %s", F.col(path), "line", "col", "severity", "rule", "message", quoted(F.col("match"))).alias("value"))


def json_report(checked: DataFrame, path: str = "path") -> DataFrame:
    """path and its findings as JSON, [] for clean documents; one row each, as one object of all would have to fit a single task."""
    part = F.transform("findings", lambda f: F.struct(f["line"].alias("line"), f["col"].alias("col"), f["severity"].alias("severity"), f["rule"].alias("rule"), f["match"].alias("match"), f["message"].alias("message")))
    return checked.select(path, F.to_json(part).alias("findings"), "suppressed")


def structural_json(findings: DataFrame, path: str = "path") -> DataFrame:
    return findings.select(F.to_json(F.struct(F.col(path).alias("file"), "line", "rule", "excerpt", "message")).alias("value"))
