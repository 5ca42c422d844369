"""Phrase rules over documents: one projection, no shuffle.

Every rule gives an array of hits of its document; the arrays are concatenated, put in order, reduced and suppressed within the row, and
exploded last. Phrases are tested in three steps: one alternation on the whole text, a substring for each phrase, and the phrase's own pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions.text import GUARD, SPACE, WORD, any_of, bounded, column_of, constant, folded, line_of, no_spans, quote, settled, spans, strip, word_count

from .config import PHYSICAL_NOUNS
from .normalize import prepared

# Rules in the order in which they break ties, and floors of the dash density.
RULES = ("dash", "dash-density", "load-bearing-context", "banned-phrase", "engagement-bait", "soft-cliche", "loaded-adverb", "filler", "overuse", "source")
DENSITY_WORDS, DENSITY_DASHES = 150, 3
DASHES = r"[—–―]"

HIT = "struct<off:int,severity:string,rule:string,match:string,message:string,rule_ord:int,phrase_ord:int,hit_ord:int>"
PHRASE = "rule:string,severity:string,rule_ord:int,phrase_ord:int,pattern:string,core:string,left:boolean,right:boolean,limit:int,message:string"
FINDING = "struct<line:int,col:int,rule_ord:int,phrase_ord:int,hit_ord:int,severity:string,rule:string,match:string,message:string>"
#: Directives are HTML comments of a tool whose name ends with lint, but not of the structural one.
DIRECTIVE = rf"(?diU)<!--{SPACE}*(?!struct){WORD}*lint:{SPACE}*ignore(-next-line|-line)?(?!{WORD})(.*?)-->"


def _ord(rule: str) -> int:
    return RULES.index(rule)


def _hits(found: Column, rule: str, severity: str, message: Column, phrase_ord: Column | int = 0) -> Column:
    p = phrase_ord if isinstance(phrase_ord, Column) else F.lit(phrase_ord)
    return F.transform(found, lambda x, i: F.struct(
        x["off"].alias("off"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), strip(x["match"]).alias("match"), message.alias("message"),
        F.lit(_ord(rule)).alias("rule_ord"), p.cast("int").alias("phrase_ord"), i.cast("int").alias("hit_ord")))


def template(phrase: str) -> str:
    """[word] is one word, [verb] a word in -ing; the rest is literal."""
    kinds = {"[word]": f"{WORD}+", "[verb]": f"{WORD}+ing"}
    return "".join(kinds.get(part) or quote(part) for part in re.split(r"(\[word\]|\[verb\])", phrase))


def phrase_table(cfg: dict) -> list[tuple]:
    """(rule, severity, rule_ord, phrase_ord, pattern, core, guard left, guard right, limit, message) of every phrase and word."""
    rows = []
    kinds = (("banned_phrases", "banned-phrase", "error", "canned phrase: '{}'", False), ("engagement_bait", "engagement-bait", "error", "manufactured-stance opener: '{}'", False),
             ("soft_phrases", "soft-cliche", "warning", "overused phrasing: '{}'", True))
    for key, rule, severity, message, soft in kinds:
        for k, p in enumerate(cfg[key]):
            parts = re.split(r"\[word\]|\[verb\]", p) if soft else [p]
            rows.append((rule, severity, _ord(rule), k, "(?diU)" + (template(p) if soft else quote(p)), max(parts, key=len).lower(), p[:1].isalnum(), p[-1:].isalnum(), -1, message.format(p)))
    for k, w in enumerate(cfg["filler_words"]):
        rows.append(("filler", "warning", _ord("filler"), k, "(?diU)" + bounded(w), w.lower(), False, False, -1, f"filler or intensifier: '{w}'"))
    for k, (w, limit) in enumerate(cfg["watch_words"].items()):
        rows.append(("overuse", "warning", _ord("overuse"), k, "(?diU)" + bounded(w), w.lower(), False, False, limit, f"'{w}' over its soft cap of {limit}"))
    return rows


def phrase_hits(text: Column, cfg: dict) -> Column:
    rows = phrase_table(cfg)
    if not rows:
        return F.array().cast(f"array<{HIT}>")
    table = constant(rows, PHRASE)
    low = folded(text)

    def one(r: Column) -> Column:
        def kept(x):
            before = F.substring(text, x["off"], F.lit(1))
            after = F.substring(text, x["off"] + F.length(x["match"]) + 1, F.lit(1))
            return ~(r["left"] & (x["off"] > 0) & before.rlike(GUARD)) & ~(r["right"] & after.rlike(GUARD))

        found = F.filter(spans(text, r["pattern"]), kept)
        # a watched word gives one hit, the first over its limit
        found = F.when(r["limit"] < 0, found).when(F.size(found) > r["limit"], F.slice(found, r["limit"] + 1, F.lit(1))).otherwise(no_spans())
        return F.transform(found, lambda x, i: F.struct(x["off"].alias("off"), r["severity"].alias("severity"), r["rule"].alias("rule"), strip(x["match"]).alias("match"), r["message"].alias("message"),
                                                        r["rule_ord"].alias("rule_ord"), r["phrase_ord"].alias("phrase_ord"), i.cast("int").alias("hit_ord")))

    def all_of(low_text: Column) -> Column:
        near = F.filter(table, lambda r: F.contains(low_text, r["core"]))
        return F.flatten(F.transform(near, one))

    gate = low.rlike(any_of({r[5] for r in rows}))
    return F.when(gate, F.flatten(F.transform(F.array(low), all_of))).otherwise(F.array().cast(f"array<{HIT}>"))


def dash_hits(text: Column, cfg: dict) -> Column:
    found = F.when(text.rlike(DASHES), spans(text, DASHES)).otherwise(no_spans())
    if cfg["no_dashes"]:
        return _hits(found, "dash", "error", F.lit("dash; use a comma, colon or full stop"))
    cap = float(cfg["dash_density_cap"])
    if cap <= 0:
        return F.array().cast(f"array<{HIT}>")
    words = word_count(text)
    allowed = F.floor(F.lit(cap) * words / 100).cast("int")
    over = (F.size(found) >= DENSITY_DASHES) & (words >= DENSITY_WORDS) & (F.size(found) > allowed)
    first = F.when(over, F.slice(found, allowed + 1, F.lit(1))).otherwise(no_spans())
    return _hits(first, "dash-density", "warning", F.concat(F.size(found).cast("string"), F.lit(" dashes in "), words.cast("string"), F.lit(" words")))


def load_bearing_hits(text: Column) -> Column:
    found = F.when(folded(text).contains("bearing"), spans(text, rf"(?diU)load[-\s\x{{1c}}-\x{{1f}}]?bearing(?!{WORD})")).otherwise(no_spans())

    def figurative(x):
        rest = F.substring(text, x["off"] + F.length(x["match"]) + 1, F.length(text))
        word = F.regexp_extract(rest, rf"(?U)^{SPACE}+([\p{{L}}\p{{Nl}}\p{{No}}]+)", 1)
        return ~F.lower(word).isin(PHYSICAL_NOUNS)

    return _hits(F.filter(found, figurative), "load-bearing-context", "warning", F.lit("'load-bearing' before a non-structural word; confirm that it is literal"))


def loaded_adverb_hits(text: Column) -> Column:
    p = rf"(?dmiU)(?<!{WORD})quietly(?!{WORD})(?={SPACE}*(?:[.,;:!?)\]]|$))"
    found = F.when(folded(text).contains("quietly"), spans(text, p)).otherwise(no_spans())
    return _hits(found, "loaded-adverb", "warning", F.lit("trailing 'quietly'; put it before the verb or cut it"))


def host(url: Column) -> Column:
    """Host of a URL: user and port dropped, lower case, no trailing dot."""
    h = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r":.*$", "")), r"\.+$", "")


def source_hits(text: Column, cfg: dict) -> Column:
    """URLs on a listed domain: a dotted entry is a suffix of the host, a bare one any of its labels. The first entry that matches is named."""
    domains = [d for d in (x.lower().strip(".") for x in cfg["aggregator_domains"]) if d]
    if not domains:
        return F.array().cast(f"array<{HIT}>")
    urls = F.when(folded(text).contains("://"), spans(text, rf"(?diU)https?://[^\s\x{{1c}}-\x{{1f}})\"'<>]+")).otherwise(no_spans())

    def named(x):
        h = host(x["match"])
        tests = [F.when((h == d) | F.endswith(h, F.lit("." + d)) if "." in d else F.array_contains(F.split(h, r"\."), d), F.lit(d)) for d in domains]
        return F.coalesce(*tests)

    return F.transform(F.filter(urls, lambda x: named(x).isNotNull()), lambda x, i: F.struct(
        x["off"].alias("off"), F.lit("error").alias("severity"), F.lit("source").alias("rule"), strip(x["match"]).alias("match"), F.concat(F.lit("low-trust source: "), named(x)).alias("message"),
        F.lit(_ord("source")).alias("rule_ord"), F.lit(0).alias("phrase_ord"), i.cast("int").alias("hit_ord")))


def all_hits(text: Column, cfg: dict) -> Column:
    parts = [dash_hits(text, cfg), phrase_hits(text, cfg), source_hits(text, cfg)]
    if cfg["load_bearing_literal_only"]:
        parts.append(load_bearing_hits(text))
    if cfg["flag_loaded_quietly"]:
        parts.append(loaded_adverb_hits(text))
    return F.concat(*[p.cast(f"array<{HIT}>") for p in parts])


def placed(text: Column, hits: Column) -> Column:
    """Hits as findings in order of line, column, rule, phrase and hit."""
    return F.array_sort(F.transform(hits, lambda h: F.struct(
        line_of(text, h["off"]).alias("line"), column_of(text, h["off"]).alias("col"), h["rule_ord"].alias("rule_ord"), h["phrase_ord"].alias("phrase_ord"), h["hit_ord"].alias("hit_ord"),
        h["severity"].alias("severity"), h["rule"].alias("rule"), h["match"].alias("match"), h["message"].alias("message"))).cast(f"array<{FINDING}>"))


def without_shadowed(found: Column) -> Column:
    """Soft findings that start exactly where an error starts go."""
    errors = F.transform(F.filter(found, lambda f: f["severity"] == "error"), lambda f: F.struct(f["line"], f["col"]))
    return F.filter(found, lambda f: ~((f["rule"] == "soft-cliche") & F.array_contains(errors, F.struct(f["line"], f["col"]))))


def suppressions(text: Column) -> Column:
    """array of (line, rules) from directives; the rule * stands for all."""
    def of_line(line, i):
        def one(m):
            names = F.regexp_extract_all(F.regexp_extract(m, DIRECTIVE, 2), F.lit(r"[A-Za-z][\p{L}\p{N}_-]*"), F.lit(0))
            target = i + 1 + F.when(F.regexp_extract(m, DIRECTIVE, 1) == "-next-line", F.lit(1)).otherwise(F.lit(0))
            return F.struct(target.cast("int").alias("line"), F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("*"))).alias("rules"))

        return F.transform(F.regexp_extract_all(line, F.lit(DIRECTIVE), F.lit(0)), one)

    none = F.array().cast("array<struct<line:int,rules:array<string>>>")
    return F.when(F.contains(text, F.lit("<!--")), F.flatten(F.transform(F.split(text, "\n", -1), of_line))).otherwise(none)


def checked(docs: DataFrame, cfg: dict, text: str = "text") -> DataFrame:
    """docs with findings (array, in order) and suppressed (how many were silenced)."""
    d = settled(docs.withColumn("_t", prepared(F.col(text))))
    d = d.withColumn("_found", placed(F.col("_t"), all_hits(F.col("_t"), cfg)))
    d = settled(d.withColumn("_found", without_shadowed(F.col("_found"))).withColumn("_sup", suppressions(F.col("_t"))))
    silent = lambda f: F.exists("_sup", lambda s: (s["line"] == f["line"]) & (F.array_contains(s["rules"], "*") | F.array_contains(s["rules"], f["rule"])))
    d = d.withColumn("findings", F.when(F.size("_sup") == 0, F.col("_found")).otherwise(F.filter("_found", lambda f: ~silent(f))))
    return d.withColumn("suppressed", F.size("_found") - F.size("findings")).drop("_t", "_found", "_sup")


def findings(docs: DataFrame, cfg: dict, keys=("doc_id",), text: str = "text") -> DataFrame:
    """One row for each finding: the keys, line, col, severity, rule, match, message and its place among the document's findings."""
    d = settled(checked(docs, cfg, text).select(*keys, "findings")).select(*keys, F.posexplode("findings").alias("place", "f"))
    return d.select(*keys, "place", "f.line", "f.col", "f.severity", "f.rule", "f.match", "f.message", "f.phrase_ord")
