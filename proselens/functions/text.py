"""Text expressions shared by the rules: Unicode-aware patterns, matches with offsets, positions and masks.

Patterns are Java regular expressions. Word characters are letters, numbers and underscore; space includes the four separators U+001C to U+001F.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x{1c}-\x{1f}]"
#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What guards a phrase's edges: alphanumerics and combining marks, no underscore.
GUARD = r"[\p{L}\p{N}\p{M}]"
LINE_END = r"\R|[\x{1c}-\x{1e}]"
SPANS = "array<struct<off:int,match:string>>"


def quote(literal: str) -> str:
    """A pattern for the literal."""
    return re.sub(r"([^\w\s])", r"\\\1", literal, flags=re.A) if literal.isascii() else "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in literal)


def bounded(literal: str) -> str:
    """A pattern for the literal with a word boundary at either end."""
    before = "(?<!" if re.match(r"\w", literal) else "(?<="
    after = "(?!" if re.search(r"\w$", literal) else "(?="
    return f"{before}{WORD}){quote(literal)}{after}{WORD})"


def _pattern(p) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def spans(text: Column, pattern) -> Column:
    """All non-overlapping matches: array of (off, match), off counting code points from 0."""
    p = _pattern(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    between = F.slice(F.split(text, p, F.lit(-1)), F.lit(1), F.size(found))
    pairs = F.zip_with(between, found, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, x):
        off = acc["at"] + F.length(x["s"])
        here = F.array(F.struct(off.alias("off"), x["m"].alias("match")))
        return F.struct((off + F.length(x["m"])).alias("at"), F.concat(acc["out"], here).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def no_spans() -> Column:
    return F.array().cast(SPANS)


def masked(text: Column, pattern: str) -> Column:
    """text with every match blanked: line feeds stay, any other character becomes a space, so offsets hold."""
    p = _pattern(pattern)
    blank = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.regexp_replace(m, r"[^\n]", " "))
    return F.array_join(F.zip_with(F.split(text, p, F.lit(-1)), blank, lambda s, m: F.concat(s, F.coalesce(m, F.lit("")))), "")


def line_of(text: Column, off: Column) -> Column:
    before = F.substring(text, F.lit(1), off)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, off: Column) -> Column:
    return F.length(F.substring_index(F.substring(text, F.lit(1), off), "\n", -1)) + 1


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def folded(text: Column) -> Column:
    """Lower case, with the two letters that only case-insensitive matching equates with s and i; for substring tests only, as lengths may change."""
    return F.replace(F.replace(F.lower(text), F.lit("ſ"), F.lit("s")), F.lit("ı"), F.lit("i"))


def any_of(literals) -> str:
    """A pattern for any of the literals as a tree of their common beginnings, so that a position of the text costs one step where none begins."""
    tree: dict = {}
    for literal in literals:
        at = tree
        for c in literal:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(node: dict) -> str:
        if "" in node:  # a shorter literal makes the longer ones idle
            return ""
        parts = [quote(c) + written(below) for c, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return written(tree)


def settled(df: DataFrame) -> DataFrame:
    """df behind a barrier: what is computed below is computed once a row, instead of being copied by the optimizer into every use above."""
    return df.withColumn("_r", F.rand(0)).where("_r >= 0").drop("_r")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its scan has fewer: a file of one row group is one task. Larger inputs stay as they are read."""
    wide = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wide) if df.rdd.getNumPartitions() < wide else df


def once(value: Column, use) -> Column:
    """use(value), with value computed once: a column that is merely named would be computed wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def constant(rows: list[tuple], schema: str) -> Column:
    """The rows as a literal array of structs; parsed from one string, as thousands of literals take seconds to build."""
    names = [c.split(":")[0] for c in schema.split(",")]
    return F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows], ensure_ascii=False)), f"array<struct<{schema}>>")


def lines(text: Column) -> Column:
    """Physical lines; an end of line at the end of the text opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def sentences(text: Column) -> Column:
    """Pieces after . ! or ? and space, stripped; single characters and lead-ins that end with a colon are none."""
    parts = F.transform(F.split(text, rf"(?U)(?<=[.!?]){SPACE}+", -1), strip)
    return F.filter(parts, lambda s: (F.length(s) > 1) & ~F.endswith(s, F.lit(":")))


@F.pandas_udf(StringType())  # an object, as no session need be there yet
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")
