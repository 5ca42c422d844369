"""Blinded studies: assignment, prompts, sheets and scores as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONDITIONS = ("correct", "wrong", "none", "anchor")
RATINGS = "blind_id string, writer string, candidate string, rating string, fidelity_flag string, forced_choice_pick string"
REFERENCE_CHARS = 1200
NO_PROFILE = "(NO PROFILE: write in a clean, competent default voice.)"
NO_HOLDOUT = "(no holdout sample found for this writer)\n"
NO_REFERENCE = "(no reference sample on file)"


def blind_id(*parts: Column) -> Column:
    """item- and eight digits of the SHA-1 of the parts; a missing profile counts as None."""
    return F.concat(F.lit("item-"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary")), 1, 8))


def plan(writers: DataFrame, run: str, brief: str, conditions=("correct", "wrong", "none"), anchor: bool = False, seed: int = 1, everyone: DataFrame | None = None) -> DataFrame:
    """Items of a run: each writer with each condition, and an anchor.

    writers (writer, holdout: path or null). A wrong profile is one of the run's other writers, else of everyone (writer); the choice is that with the least hash of
    seed, target and candidate, so reruns agree. Where nobody else exists the item is left out. Writers are few: they are the run's participants."""
    if unknown := set(conditions) - {"correct", "wrong", "none"}:
        raise ValueError(f"unknown condition {sorted(unknown)[0]!r}")
    t = writers.select(F.col("writer").alias("target"), "holdout")
    pool = writers.select(F.col("writer").alias("other"), F.lit(0).alias("far"))
    if everyone is not None:
        pool = pool.unionByName(everyone.select(F.col("writer").alias("other"), F.lit(1).alias("far")))
    choice = F.struct("far", F.sha1(F.concat_ws("|", F.lit(str(seed)), "target", "other").cast("binary")), "other")
    wrong = t.join(pool, F.col("target") != F.col("other")).groupBy("target").agg(F.min(choice)["other"].alias("wrong"))
    rows = t.join(wrong, "target", "left").withColumn("condition", F.explode(F.array(*[F.lit(c) for c in [*conditions, *(["anchor"] if anchor else [])]])))
    rows = rows.where("condition <> 'wrong' or wrong is not null")
    profile = F.when(F.col("condition").isin("correct", "anchor"), F.col("target")).when(F.col("condition") == "wrong", F.col("wrong"))
    source = F.when(F.col("condition") == "anchor", F.col("holdout"))
    last = F.when(F.col("condition") == "anchor", F.coalesce("holdout", F.lit("none"))).otherwise(profile)
    bid = blind_id(F.lit(run), F.col("target"), F.lit(brief), F.col("condition"), last)
    return rows.select(F.lit(run).alias("run"), bid.alias("blind_id"), "target", F.lit(brief).alias("brief"), "condition", profile.alias("profile"),
                       F.when(F.col("condition") == "anchor", F.lit("anchor")).otherwise(F.lit("authored")).alias("kind"), F.concat(F.lit("drafts/"), bid, F.lit(".md")).alias("draft"), source.alias("source"))


def prompts(items: DataFrame, brief_text: str, profiles: DataFrame, instructions: str) -> DataFrame:
    """blind_id, prompt for authored items; profiles (writer, text)."""
    p = profiles.select(F.col("writer").alias("profile"), F.col("text").alias("profile_text"))
    body = F.concat(F.lit(f"{instructions}\n\n=== BRIEF ===\n{brief_text}\n\n=== VOICE PROFILE ===\n"), F.coalesce("profile_text", F.lit(NO_PROFILE)), F.lit("\n"))
    return items.where("kind = 'authored'").join(p, "profile", "left").select("blind_id", body.alias("prompt"))


def anchor_drafts(items: DataFrame, samples: DataFrame) -> DataFrame:
    """blind_id, draft text of anchors: the held-out sample's; samples (path, text)."""
    s = samples.select(F.col("path").alias("source"), "text")
    return items.where("kind = 'anchor'").join(s, "source", "left").select("blind_id", F.coalesce("text", F.lit(NO_HOLDOUT)).alias("text"))


def reference_block(samples: DataFrame) -> DataFrame:
    """writer, reference: the first sample by path, stripped and cut; samples (writer, path, text)."""
    first = samples.groupBy("writer").agg(F.min_by("text", "path").alias("t"))
    t = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    return first.select("writer", F.concat(F.substring(t, 1, REFERENCE_CHARS), F.when(F.length(t) > REFERENCE_CHARS, F.lit("\n...")).otherwise(F.lit(""))).alias("reference"))


def sheet(items: DataFrame, seed: int = 1) -> DataFrame:
    """Blank rating rows: candidates of each writer in an order that hashes of seed and blind_id shuffle, lettered from a on."""
    w = Window.partitionBy("target").orderBy(F.sha1(F.concat_ws("|", F.lit(f"{seed}-sheet"), "blind_id").cast("binary")), "blind_id")
    blank = F.lit("")
    return items.withColumn("n", F.row_number().over(w)).select("blind_id", F.col("target").alias("writer"), F.char(F.lit(96) + F.col("n")).alias("candidate"), blank.alias("rating"), blank.alias("fidelity_flag"), blank.alias("forced_choice_pick"))


def final_ratings(ratings: DataFrame, order: str = "row_no") -> DataFrame:
    """The last row of each blind_id that has a rating, with rating as a number and the flag in upper case."""
    rated = ratings.where(F.trim(F.coalesce("rating", F.lit(""))) != "")
    last = rated.groupBy("blind_id").agg(F.max_by(F.struct("rating", "fidelity_flag"), order).alias("r"))
    return last.select("blind_id", F.expr("try_cast(trim(r.rating) as double)").alias("rating"), F.upper(F.trim(F.coalesce("r.fidelity_flag", F.lit("")))).alias("flag"))


def rated_items(items: DataFrame, ratings: DataFrame, order: str = "row_no") -> DataFrame:
    return final_ratings(ratings, order).join(items.select("blind_id", "target", "condition"), "blind_id").select("target", "condition", "rating", "flag")


def means(items: DataFrame, ratings: DataFrame, order: str = "row_no") -> DataFrame:
    """target and its mean rating by condition; flagged drafts count."""
    return rated_items(items, ratings, order).groupBy("target").pivot("condition", list(CONDITIONS)).agg(F.avg("rating"))


def lift(by_writer: DataFrame) -> DataFrame:
    """means with lift: correct less the mean of the controls there are; null without correct or without any control."""
    controls = F.filter(F.array("wrong", "none"), lambda x: x.isNotNull())
    mean = F.when(F.size(controls) > 0, F.aggregate(controls, F.lit(0.0), lambda a, x: a + x) / F.size(controls))
    return by_writer.withColumn("lift", F.col("correct") - mean)


def pooled(lifts: DataFrame) -> DataFrame:
    return lifts.where("lift is not null").agg(F.avg("lift").alias("mean_lift"), F.min("lift").alias("min_lift"), F.max("lift").alias("max_lift"), F.count("lift").alias("writers"))


def flags(items: DataFrame, ratings: DataFrame, order: str = "row_no") -> DataFrame:
    return rated_items(items, ratings, order).agg(F.count_if(F.col("flag") == "F").alias("flagged"))


def forced_choice(items: DataFrame, ratings: DataFrame, mode: str = "row") -> DataFrame:
    """hits, total and percent of picks that name the correct item. mode row: the row's own blind_id counts; letter: the candidate whose letter was picked."""
    picks = ratings.where(F.trim(F.coalesce("forced_choice_pick", F.lit(""))) != "")
    if mode == "letter":
        named = ratings.select("writer", F.col("candidate").alias("letter"), F.col("blind_id").alias("picked")).distinct()
        picks = picks.withColumn("letter", F.lower(F.trim("forced_choice_pick"))).join(named, ["writer", "letter"], "left").withColumn("blind_id", F.col("picked"))
    hit = F.coalesce(F.col("condition") == "correct", F.lit(False))
    out = picks.join(items.select("blind_id", "condition"), "blind_id", "left").agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.col("hits") * 100.0 / F.col("total")).otherwise(F.lit(0.0)))
