"""Judgement arithmetic: density, clusters, verdicts, profile and length gates. Scores are inputs; none are made up here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions.text import SPACE, WORD

from .structure import compiled

# ---------------------------------------------------------------------------
# Floors and limits of the signals.
DENSITY, DENSITY_WORDS, DENSITY_HITS = 2.0, 150, 3
REVISE_HITS = 3
CLUSTER = 2
SAMPLES, SAMPLES_SEVERAL, SAMPLE_WORDS, HOLDOUTS = 4, 5, 1500, 1
LENGTH_SHARE = 0.1
# ---------------------------------------------------------------------------
VOICE = ("d1", "d2", "d3", "d4", "d6", "d7")
#: Heuristic detectors of antithesis and of triplets; whether a triplet is abstract is left to a reader.
ANTITHESIS = r"\b(?:doesn't|does not|isn't|is not|aren't|are not|wasn't|was not) (?:just|merely|only)\b|\bnot just [^.!?]{1,80}?,? but\b|\bthis is not [^.!?]{1,80}?\. it is\b"
TRIPLET = r"\b\w+, \w+,? and \w+\b"


def density(flagged: Column, words: Column) -> Column:
    """Findings per 100 words are a signal above the limit, on enough words and with enough findings."""
    return (words >= DENSITY_WORDS) & (flagged >= DENSITY_HITS) & (flagged * F.lit(100.0) / F.when(words > 0, words) > DENSITY)


def clusters(paragraphs: Column) -> Column:
    """How many paragraphs hold two antitheses or two triplets."""
    def clustered(p):
        hits = lambda pattern: F.regexp_count(p["body"], F.lit(compiled(pattern)))
        return (hits(ANTITHESIS) >= CLUSTER) | (hits(TRIPLET) >= CLUSTER)

    return F.size(F.filter(paragraphs, clustered))


def verdict(df: DataFrame) -> DataFrame:
    """df (d1..d7, words, flagged, clusters, missing_markers) with density, verdict and driver; the most serious branch wins and names its first cause.

    A low fifth dimension with all else clean falls in no branch of the protocol; it is REVISE with driver d5-gap here."""
    low = sum(((F.col(c) <= 2).cast("int") for c in VOICE), F.lit(0))
    three = sum(((F.col(c) == 3).cast("int") for c in VOICE), F.lit(0))
    dense = F.coalesce(density(F.col("flagged"), F.col("words")), F.lit(False))
    branches = (
        (low >= 2, "REWRITE", "two-low-dimensions"), (dense & (F.col("clusters") >= CLUSTER), "REWRITE", "density-and-clusters"),
        (low == 1, "REVISE", "low-dimension"), (three >= 1, "REVISE", "dimension-at-3"), (dense, "REVISE", "density"), (F.col("clusters") >= 1, "REVISE", "cluster"),
        (F.col("flagged") >= REVISE_HITS, "REVISE", "hits"), (F.coalesce("missing_markers", F.lit(False)), "REVISE", "missing-markers"), (F.col("d5") >= 4, "PASS", "clean"))
    v, d = F, F
    for i, (test, name, driver) in enumerate(branches):
        v = v.when(test, F.lit(name)) if i else F.when(test, F.lit(name))
        d = d.when(test, F.lit(driver)) if i else F.when(test, F.lit(driver))
    return df.withColumn("density", dense).withColumn("verdict", v.otherwise(F.lit("REVISE"))).withColumn("driver", d.otherwise(F.lit("d5-gap")))


def profile_gate(samples: DataFrame, writer: str = "writer", words: str = "words", holdout: str = "holdout", registers: str | None = None) -> DataFrame:
    """One row for each writer: samples, words, held-out pieces, and whether a profile may be built from them."""
    n, w, h = F.count_if(~F.col(holdout)), F.sum(F.when(~F.col(holdout), F.col(words)).otherwise(0)), F.count_if(F.col(holdout))
    need = F.lit(SAMPLES) if registers is None else F.when(F.count_distinct(registers) > 1, SAMPLES_SEVERAL).otherwise(SAMPLES)
    out = samples.groupBy(writer).agg(n.alias("samples"), w.alias("sample_words"), h.alias("holdouts"), need.alias("need"))
    return out.withColumn("ready", (F.col("samples") >= F.col("need")) & (F.col("sample_words") >= SAMPLE_WORDS) & (F.col("holdouts") >= HOLDOUTS))


def length_gate(before: Column, after: Column) -> Column:
    """A rewrite stays within a tenth of its source's words."""
    return F.abs(after - before) * 10 <= before


__all__ = ["ANTITHESIS", "SPACE", "TRIPLET", "WORD", "clusters", "density", "length_gate", "profile_gate", "verdict"]
