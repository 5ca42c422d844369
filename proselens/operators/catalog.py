"""The catalog of tells that need a paragraph or a reader: detectors by paragraph, quotes as evidence, overrides.

Detectors are heuristics: whether an abstract noun, a hedge or a triplet is a tell is left to a reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import structure
from .structure import EXCERPT, compiled
from .verdicts import ANTITHESIS, TRIPLET

# ---------------------------------------------------------------------------
# Openers, connectives and hedges of the catalog.
OPENERS = ("situated", "in a world where", "in the rapidly evolving landscape of", "as we navigate", "today, more than ever", "in recent years", "picture this:", "imagine")
TRANSITIONS = ("furthermore", "moreover", "additionally")
HEDGES = ("may", "might", "could", "perhaps", "possibly", "potentially", "somewhat", "arguably")
HEDGE_STACK = 3  # hedges in one sentence
# ---------------------------------------------------------------------------
COUNTER = r"\bcounter-[a-z]+"
BALANCED = r"^while [^,.!?]{1,80} is [^,.!?]{1,40}, [^.!?]{1,80} is equally "


def _any(words) -> str:
    return "|".join(words)


#: (category, pattern, least matches): searched in a paragraph's text, or in each of its sentences.
BY_PARAGRAPH = (
    ("antithesis", ANTITHESIS, 1), ("opener", rf"^(?:{_any(OPENERS)})", 1), ("triplet", TRIPLET, 1), ("counter", COUNTER, 1), ("transition", rf"^(?:{_any(TRANSITIONS)})\b", 1))
BY_SENTENCE = (("hedges", rf"\b(?:{_any(HEDGES)})\b", HEDGE_STACK), ("balanced", BALANCED, 1))


def findings(docs: DataFrame, keys=("doc_id",), text: str = "text") -> DataFrame:
    """keys, line (of the paragraph), category, hits, excerpt: for each paragraph and category that it shows. Code, quotations, tables and headers are no paragraphs."""
    from proselens.functions.text import sentences

    d = structure.parsed(docs, text).select(*keys, F.explode("paragraphs").alias("p")).select(*keys, F.col("p.start").alias("line"), F.col("p.body").alias("body"))
    d = d.withColumn("s", sentences(F.col("body")))
    row = lambda name, hits: F.struct(F.lit(name).alias("category"), hits.cast("int").alias("hits"))
    found = [F.when((n := F.regexp_count("body", F.lit(compiled(p)))) >= least, row(name, n)) for name, p, least in BY_PARAGRAPH]
    def stacked(p: str, least: int):
        return F.size(F.filter("s", lambda x: F.regexp_count(x, F.lit(compiled(p))) >= least))

    for name, p, least in BY_SENTENCE:
        n = stacked(p, least)
        found.append(F.when(n > 0, row(name, n)))
    d = d.select(*keys, "line", F.substring("body", 1, EXCERPT).alias("excerpt"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return d.select(*keys, "line", "f.category", "f.hits", "excerpt")


def evidence(scores: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """scores (key, quote and further columns) with supported: the quote is not empty and stands in the document's text. Scores of unknown documents are not supported."""
    d = docs.select(key, F.col("text").alias("_text"))
    ok = F.coalesce((F.length("quote") > 0) & F.contains("_text", F.col("quote")), F.lit(False))
    return scores.join(d, key, "left").withColumn("supported", ok).drop("_text")


def without_allowed(findings: DataFrame, allowed: DataFrame, by: str) -> DataFrame:
    """findings less those that overrides allow: allowed (by, rule, match) names a rule and a match in lower case, or null for all matches of the rule."""
    a = allowed.select(F.col(by).alias("_by"), F.col("rule").alias("_rule"), F.col("match").alias("_match"))
    return findings.join(a, (F.col(by) == F.col("_by")) & (F.col("rule") == F.col("_rule")) & F.coalesce(F.lower("match") == F.col("_match"), F.col("_match").isNull()), "left_anti")


__all__ = ["evidence", "findings", "without_allowed"]
