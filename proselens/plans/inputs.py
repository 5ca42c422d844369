"""Inputs of the queries: documents with an authored snippet at the end, so that every rule has hits and misses, and study tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.functions.text import spread
from proselens.operators import config

DASH, CURLY = "—", "’"
#: One snippet for each doc_id modulo their number.
SNIPPETS = [
    "Plain words follow, nothing to see and nothing to mark in this closing line.",
    "They call the new oven a game-changer. Every paradigm shifts with its users.",
    "Call it a paradigm shift. Make no mistake, the dam is a testament to thrift.",
    "Here's the thing: rents fell. Let that sink in.",
    f"Nobody{CURLY}s talking about it. Here{CURLY}s what{CURLY}s wild: no one is talking about it.",
    "In conclusion, buy the smaller boat. At the end of the day it pays for itself.",
    "We saw a significant drop. Its signification was lost. Robust, robust and seamless.",
    "Their load-bearing excuse gave way. Paint the load-bearing wall. One loadbearing\nbeam and a payload-bearing rocket.",
    f"The ferry left {DASH} we waved {DASH} and ate.",
    f"One {DASH} two {DASH} three {DASH} four {DASH} five {DASH} six {DASH} seven {DASH} eight {DASH} nine {DASH} ten {DASH} end {DASH} and more {DASH} still {DASH} so.",
    "He closed the ledger quietly. A quietly amused judge nodded. The bakery moved quietly\nin May.",
    "quietly they rowed, quietly sang, quietly slept; actually, actually, actually, actually dry.",
    "More at https://news.msn.com/a/1 today, and https://example.net/of/msn.com/a too.",
    "See https://user@Timesofindia.indiatimes.com:80/x and https://msn.com@evil.example/x or https://www.msn.com./story.",
    "The `game-changer` phrase and\n```\nat the end of the day\n```\nthen the game-changer itself.",
    "It's worth noting that it's worth sailing, and it's worth kingfishers.",
    "I want to be clear: the honest truth is what comes next, put simply.",
    "This is a game-changer. <!-- proselint: ignore-line banned-phrase -->\nIt is robust.",
    "<!-- proselint: ignore-next-line -->\nThis is a game-changer and robust.\nThis is the move.",
    "This is a game-changer. <!-- proselint: ignore-line filler -->\nRobust. <!-- proselint: ignore -->",
    "A `proselint: ignore-line` game-changer. proselint: ignore-line robust.",
    f"ségame-changer, that game-changer café, game-changer_x, regame-changer, {CURLY}game-changer{CURLY}.",
    "worth its weight in gold, worth its weight, the movement is the move.",
    "Where your voice lives, the line that never bends, one buys you time.",
    "\nTwo of them new. Two of them torn.\n",
    "\nIt opens at six. It smells of resin. It closes in winter.\n",
    "\n## The one thing that sinks it\n\n## Why this matters\n\n## How a chart carries a value\n",
    "\n## Design That Carries a Decision ##\n> ## The real deal\n### the real deal\n",
    "\n- **Calibration:** What is it? Week six, and again later.\n\n4. Send it now. Compare. Wait. Done.\n",
    "\n> You rang. We came. No one. Try again.\n\n| A one. | B two. | C three. |\n\n[How are they? What is it? What does it hide?]\n",
    "\nan old map that you can read is worth more than ten new ones which you can not.\n",
    "\nCopper is softer than brass. The result is better than we expected and here is one more line to fill it.\n\nIt is better than one that doesn't.\n",
    "\n~~~\nA b. C d. E f. G h.\n~~~\nOne two. Three four.\n",
    "\n```\nOne two. Three four. Five six.\nnever closed here. No. Not yet.\n",
    "\nTwo of them new. Two of them torn. <!-- structproselint: ignore-line -->\n\n<!-- structproselint: ignore-next-line -->\nHalf of it wet. Half of it dry.\n\nStage 1: do it. Stage 2: stop. Stage 3: go.\n",
    "\nSmith (2019) wrote it. Short one. Another one. And one.\n\n\"This is a quoted prompt that goes on for well over sixty characters, as it should.\" Yes. No. So.\n",
    "\n**Type:** a **Title:** b\n**Label.** One two. Three four. Five six.\nMore text follows here\nand wraps. To the end.\n",
    "\nIt doesn't just work, it isn't merely fast. Not just neat but clean.\n\nClarity, transparency, and accountability; innovation, collaboration and growth.\n",
    "\nHe said e.g. This. Then: nothing else:\n\nWhat everyone misses\n# What everyone misses\n####### seven\n#no space\n",
    "\nUno. Dos. Tres. Cuatro y otra frase que es bastante mas larga que las otras de antes.\n",
]
TEAM = {"no_dashes": False, "dash_density_cap": 1.0, "flag_loaded_quietly": True, "aggregator_domains": ["msn.com", "timesofindia"]}
NOTHING = {"banned_phrases": [], "engagement_bait": [], "soft_phrases": [], "filler_words": [], "watch_words": {}, "aggregator_domains": [], "no_dashes": False, "dash_density_cap": 0, "load_bearing_literal_only": False, "flag_loaded_quietly": False}


def only(**keys) -> dict:
    """A full rule set with these rules on and all others off."""
    return config.SHIPPED | NOTHING | keys


def shipped(*keys: str) -> dict:
    return only(**{k: config.SHIPPED[k] for k in keys})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("raw"))
    return spread(d)


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text: each document with its snippet on new lines below."""
    d = documents(spark, sf_dir)
    snippet = F.get(F.array(*[F.lit(s) for s in SNIPPETS]), F.pmod("doc_id", F.lit(len(SNIPPETS))).cast("int"))
    return d.select("doc_id", "lang", "source", F.concat("raw", F.lit("\n"), snippet).alias("text"))


RUN, BRIEF = "run1", "b1"


def writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """writer, holdout: sources stand in for writers; their smallest doc_id names the held-out piece."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null")
    return d.groupBy(F.col("source").alias("writer")).agg(F.min("doc_id").alias("m")).select("writer", F.when(F.col("m") % 3 != 0, F.concat(F.lit("holdout/"), F.col("m").cast("string"))).alias("holdout"))


def ratings(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """Rating rows derived from documents: doc_id chooses the condition, the rating, flags, blanks, picks and unknown items."""
    from proselens.operators.study import CONDITIONS

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null")
    d = d.select(F.col("doc_id").alias("row_no"), "source", F.get(F.array(*[F.lit(c) for c in CONDITIONS]), F.floor(F.col("doc_id") / 20 % 4).cast("int")).alias("condition"))
    j = d.join(F.broadcast(items.select(F.col("target").alias("source"), "condition", "blind_id")), ["source", "condition"], "left")  # items: four for each writer
    n = F.col("row_no")
    return j.select("row_no", F.when(n % 17 == 0, F.lit("item-unknown")).otherwise(F.col("blind_id")).alias("blind_id"), F.col("source").alias("writer"), F.lit("a").alias("candidate"),
                    F.when(n % 11 == 0, F.lit(" ")).otherwise((n * 7 % 5 + 1).cast("string")).alias("rating"), F.when(n % 5 == 0, F.lit(" f ")).otherwise(F.lit("")).alias("fidelity_flag"),
                    F.when(n % 13 == 0, F.lit("a")).otherwise(F.lit("")).alias("forced_choice_pick"))
