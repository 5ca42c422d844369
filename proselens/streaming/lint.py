"""Rules over streams. All rules work within a row, so a stream of documents needs no state; roll-ups of findings keep theirs under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.operators import phrases, structure


def findings_stream(docs: DataFrame, cfg: dict, keys=("doc_id",)) -> DataFrame:
    """Phrase and structural findings of a stream of documents, in append mode."""
    a = phrases.findings(docs, cfg, keys).select(*keys, "line", "col", "severity", "rule", "match", "message")
    s = structure.findings(docs, keys).select(*keys, "line", F.lit(None).cast("int").alias("col"), F.lit("warning").alias("severity"), "rule", F.col("excerpt").alias("match"), "message")
    return a.unionByName(s)


def rule_rates(docs: DataFrame, cfg: dict, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by window and rule; documents that come later than `late` after the newest are left out of closed windows."""
    found = phrases.findings(docs.withWatermark(time, late), cfg, keys=(time,))
    return found.groupBy(F.window(time, width), "rule").count()
