"""The queries in DuckDB SQL, written independently of the Spark expressions: splitting and edge tests instead of lookaround, windows instead of arrays."""

from __future__ import annotations

import re

from proselens.operators import config
from .inputs import BRIEF, RUN, SNIPPETS

W, G = r"[\p{L}\p{N}_]", r"[\p{L}\p{N}\p{M}]"
NL = "chr(10)"


def lit(s) -> str:
    if isinstance(s, bool):
        return str(s).lower()
    return str(s) if isinstance(s, (int, float)) else "'" + s.replace("'", "''") + "'"


def seeded() -> str:
    rows = ", ".join(f"({k}, {lit(s)})" for k, s in enumerate(SNIPPETS))
    return f"snippets(k, s) as (values {rows}), seeded as (select doc_id, lang, source, coalesce(text, '') || {NL} || s as text from documents join snippets on doc_id % {len(SNIPPETS)} = k)"


def mask(e: str, p: str) -> str:
    return f"array_to_string(list_transform(list_zip(string_split_regex({e}, {lit(p)}), list_transform(regexp_extract_all({e}, {lit(p)}), lambda m: regexp_replace(m, '[^\\n]', ' ', 'g'))), lambda z: z[1] || coalesce(z[2], '')), '')"


def prepared() -> str:
    quotes = "translate(text, '‘’“”', '''''\"\"')"
    return (f"{seeded()}, fenced as (select doc_id, lang, source, {mask(quotes, '(?s)```.*?```')} t from seeded), "
            f"norm as (select doc_id, lang, source, {mask('t', '`[^`\\n]*`')} t from fenced)")


def escape(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s, flags=re.A)


def phrases(cfg: dict) -> list[tuple]:
    """(rule, severity, rule_ord, phrase_ord, pattern, core, left class, right class, limit)"""
    out = []
    for key, rule, sev, o in (("banned_phrases", "banned-phrase", "error", 3), ("engagement_bait", "engagement-bait", "error", 4), ("soft_phrases", "soft-cliche", "warning", 5)):
        for k, p in enumerate(cfg[key]):
            pat = escape(p).replace(r"\[word\]", W + "+").replace(r"\[verb\]", W + "+ing") if o == 5 else escape(p)
            core = max(re.split(r"\[word\]|\[verb\]", p), key=len).lower()
            out.append((rule, sev, o, k, "(?i)" + pat, core, G if p[0].isalnum() else "", G if p[-1].isalnum() else "", -1))
    for k, w in enumerate(cfg["filler_words"]):
        out.append(("filler", "warning", 7, k, "(?i)" + escape(w), w, W, W, -1))
    for k, (w, n) in enumerate(cfg["watch_words"].items()):
        out.append(("overuse", "warning", 8, k, "(?i)" + escape(w), w, W, W, n))
    return out


HIT = "doc_id, off, severity, rule, rule_ord, phrase_ord, match"


def spans(p: str) -> str:
    """doc_id, t, off, match, i of a fixed pattern's matches."""
    return (f"(select doc_id, t, i, coalesce(list_sum(list_transform(seg[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) off, ms[i] match "
            f"from (select *, unnest(range(1, len(ms) + 1)) i from (select doc_id, t, string_split_regex(t, {lit(p)}) seg, regexp_extract_all(t, {lit(p)}) ms from norm where regexp_matches(t, {lit(p)}))))")


def hits(cfg: dict) -> str:
    """CTEs that end with hits(HIT)."""
    ctes, parts = [prepared()], []
    rows = phrases(cfg)
    if rows:
        values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
        ctes += [f"phr(rule, severity, rule_ord, phrase_ord, p, core, lc, rc, lim) as (values {values})",
                 "low as (select doc_id, t, translate(lower(t), 'ſı', 'si') l from norm)",
                 "pm as (select phr.*, doc_id, t, string_split_regex(t, p) seg, regexp_extract_all(t, p) ms from low join phr on contains(l, core))",
                 "pu as (select *, unnest(range(1, len(ms) + 1)) i from pm)",
                 "po as (select *, coalesce(list_sum(list_transform(seg[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) off, ms[i] match from pu)",
                 "pe as (select *, row_number() over (partition by doc_id, rule, phrase_ord order by off) nth from po where not (lc <> '' and off > 0 and regexp_matches(substr(t, cast(off as bigint), 1), lc)) "
                 "and not (rc <> '' and regexp_matches(substr(t, cast(off + length(match) + 1 as bigint), 1), rc)))"]
        parts.append(f"select {HIT} from pe where lim < 0 or nth = lim + 1")
    if cfg["no_dashes"]:
        parts.append(f"select doc_id, off, 'error' severity, 'dash' rule, 0 rule_ord, 0 phrase_ord, match from {spans('[—–―]')}")
    elif cfg["dash_density_cap"]:
        parts.append(f"select doc_id, off, 'warning' severity, 'dash-density' rule, 1 rule_ord, 0 phrase_ord, match from (select *, count(*) over (partition by doc_id) n, len(regexp_extract_all(t, '{W}+')) words from {spans('[—–―]')}) "
                     f"where words >= 150 and n >= 3 and n > floor({cfg['dash_density_cap']} * words / 100) and i = floor({cfg['dash_density_cap']} * words / 100) + 1")
    if cfg["load_bearing_literal_only"]:
        p = r"(?i)load[-\s]?bearing"
        parts.append(f"select doc_id, off, 'warning' severity, 'load-bearing-context' rule, 2 rule_ord, 0 phrase_ord, match from (select *, substr(t, cast(off + length(match) + 1 as bigint)) rest from {spans(p)}) "
                     f"where not regexp_matches(rest, '^{W}') and lower(regexp_extract(rest, '^\\s+(\\p{{L}}+)', 1)) not in ({', '.join(map(lit, config.PHYSICAL_NOUNS))})")
    if cfg["flag_loaded_quietly"]:
        parts.append(f"select doc_id, off, 'warning' severity, 'loaded-adverb' rule, 6 rule_ord, 0 phrase_ord, match from (select *, substr(t, cast(off + length(match) + 1 as bigint)) rest, case when off > 0 then substr(t, cast(off as bigint), 1) else '' end pre from {spans('(?i)quietly')}) "
                     f"where not regexp_matches(pre, '{W}') and (rest = '' or regexp_matches(rest, '^\\s*([.,;:!?)\\]]|\\n|$)'))")
    if cfg["aggregator_domains"]:
        h = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(match, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':.*$', ''), '[.]+$', '')"
        tests = " or ".join(f"h = {lit(d)} or ends_with(h, {lit('.' + d)})" if "." in d else f"list_contains(string_split(h, '.'), {lit(d)})" for d in cfg["aggregator_domains"])
        url = "(?i)https?://[^\\s)\"'<>]+"
        parts.append(f"select doc_id, off, 'error' severity, 'source' rule, 9 rule_ord, 0 phrase_ord, match from (select *, lower({h}) h from {spans(url)}) where {tests}")
    ctes.append("hits as (" + " union all ".join(parts) + ")")
    return ", ".join(ctes)


def found(cfg: dict) -> str:
    """CTEs that end with kept(doc_id, line, col, severity, rule, match, rule_ord, phrase_ord, gone): after soft ones in an error's place are dropped; gone where a directive silences."""
    place = (f"placed as (select h.*, off - length(replace(substr(t, 1, cast(off as bigint)), {NL}, '')) + 1 line, length(string_split(substr(t, 1, cast(off as bigint)), {NL})[-1]) + 1 col from hits h join norm using (doc_id))")
    shadow = "clear as (select * from placed p where not (rule = 'soft-cliche' and exists (select 1 from placed e where e.doc_id = p.doc_id and e.line = p.line and e.col = p.col and e.severity = 'error')))"
    d = r"(?i)<!--\s*proselint:\s*ignore(-next-line|-line)?\b(.*?)-->"
    sup = (f"tl as (select doc_id, unnest(string_split(t, {NL})) l, generate_subscripts(string_split(t, {NL}), 1) n from norm where contains(t, '<!--')), "
           f"dir as (select doc_id, n, unnest(regexp_extract_all(l, {lit(d)}, 1)) verb, unnest(regexp_extract_all(l, {lit(d)}, 2)) names from tl), "
           f"sup as (select doc_id, n + case when verb = '-next-line' then 1 else 0 end line, regexp_extract_all(names, '[A-Za-z][\\p{{L}}\\p{{N}}_-]*') rules from dir)")
    kept = "kept as (select *, exists (select 1 from sup s where s.doc_id = c.doc_id and s.line = c.line and (len(rules) = 0 or list_contains(rules, c.rule))) gone from clear c)"
    return ", ".join([hits(cfg), place, shadow, sup, kept])


def findings(cfg: dict) -> str:
    return f"with {found(cfg)} select doc_id, cast(line as bigint) line, cast(col as bigint) col, severity, rule, match, cast(phrase_ord as bigint) phrase_ord from kept where not gone"


# ---------------------------------------------------------------- structure

# Patterns that results depend on.
HEADER_STANCES = [
    r"^(the|a) +(one +)?(thing|part|piece|bit|one) +(that|nobody|no one|everyone|most)\b", r"^why +(this|that|it) +matters\b", r"^what +(everyone|nobody|no one|most people) +(misses|gets wrong|forgets)\b",
    r"^the +\w+ +(nobody|no one) +\w+", r"^here'?s +(the|what|why)\b", r"^(the real|the actual) +\w+", r"^what +.{0,40} +is +really\b", r"\bis +the +(point|moment|whole|tell)\b",
    r"^(design|structure|the \w+) +that +carr(ies|y)\b", r"\bcarr(ies|y) +(a|the) +(decision|argument|weight|meaning|story)\b"]
COMPARATIVE = r"\b(worth +(more|less)|more|less|better|worse|stronger|weaker|cheaper|faster|safer|harder|easier) +than\b"
NEGATED_TAIL = r"\b(that|than|which|who) +((you|it|they|we|one|he|she|others?|most) +)?(do|does|did|is|are|was|were|will|would|can|could|have|has|had) *n[o’']t\b *[.!?\"]*$"
LABELED_STEP = r"\b(stage|step|round|question|phase|prompt|slide) +\d+ *:"
ANTITHESIS = r"\b(?:doesn't|does not|isn't|is not|aren't|are not|wasn't|was not) (?:just|merely|only)\b|\bnot just [^.!?]{1,80}?,? but\b|\bthis is not [^.!?]{1,80}?\. it is\b"
TRIPLET = r"\b\w+, \w+,? and \w+\b"
BREAKS = {
    "q": r"^\s*>", "h": r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", "f": r"^\s*(\*\*[^*]{1,40}:\*\*\s*){2,}", "t": r"^\s*\|.*\|\s*$", "b": r"(?s)^\s*\[.*\]\s*$",
    "c": r"(?i)\((?:19|20)\d\d\)|\bDOI\b|https?://|\barXiv\b|\bpp\.\s*\d", "u": r'"[^"]{60,}"',
}
TRIM = r"'^\s+|\s+$', '', 'g'"


def paragraphs() -> str:
    """CTEs up to paras(doc_id, start_line, body), cl (lines) and words."""
    m = lambda k: f"regexp_matches(line, {lit(BREAKS[k])})"
    return (f"{seeded()}, sl as (select doc_id, case when string_split(text, {NL})[-1] = '' then string_split(text, {NL})[:-2] else string_split(text, {NL}) end ls from seeded), "
            "rl as (select doc_id, unnest(ls) raw, generate_subscripts(ls, 1) n from sl), "
            "fl as (select *, regexp_matches(raw, '^\\s*(```|~~~)') fence, sum(case when regexp_matches(raw, '^\\s*(```|~~~)') then 1 else 0 end) over (partition by doc_id order by n) nf from rl), "
            "cl as (select doc_id, n, raw, case when fence or nf % 2 = 1 then '' else regexp_replace(raw, '`[^`]*`', ' ', 'g') end line, "
            "regexp_matches(raw, '<!--\\s*structproselint:\\s*ignore-line\\s*-->') or coalesce(regexp_matches(lag(raw) over (partition by doc_id order by n), '<!--\\s*structproselint:\\s*ignore-next-line\\s*-->'), false) skip from fl), "
            f"bl as (select *, skip or regexp_matches(line, '^\\s*$') or {' or '.join(m(k) for k in BREAKS)} stop from cl), "
            "isl as (select *, sum(case when stop then 1 else 0 end) over (partition by doc_id order by n) g from bl), "
            f"paras as (select doc_id, min(n) start_line, string_agg(regexp_replace(line, {TRIM}), ' ' order by n) body from isl where not stop group by doc_id, g)")


def sentences() -> str:
    label = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)?\*\*[^*]{1,90}?\*\*:?\s*"
    return (f"{paragraphs()}, sp as (select *, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, {TRIM})), lambda s: length(s) > 1 and not ends_with(s, ':')) sents from paras), "
            f"ps as (select *, regexp_matches(body, {lit(label)}) labeled from sp)")


def structural() -> str:
    """CTEs up to sf(doc_id, line, rule, excerpt), without density, and wc(doc_id, words)."""
    stance = " or ".join(f"regexp_matches(title, {lit('(?i)' + p)})" for p in HEADER_STANCES)
    runs = "len(sents) >= 3 and len(list_filter(range(1, len(sents) - 1), lambda i: length(sents[i]) <= 46 and length(sents[i + 1]) <= 46 and length(sents[i + 2]) <= 46)) > 0"
    maxim = f"list_filter(sents, lambda s: regexp_matches(s, {lit('(?i)' + COMPARATIVE)}) and regexp_matches(s, {lit('(?i)' + NEGATED_TAIL)}))"
    steps = "(?i)" + LABELED_STEP
    return (f"{sentences()}, hd as (select doc_id, n line, 'header' rule, substr(title, 1, 70) excerpt from (select *, regexp_replace(regexp_extract(line, {lit(BREAKS['h'])}, 1), {TRIM}) title from cl "
            f"where not skip and not regexp_matches(line, {lit(BREAKS['q'])}) and regexp_matches(line, {lit(BREAKS['h'])})) where {stance}), "
            "tb as (select doc_id, start_line line, 'two-beat' rule, substr(body, 1, 80) excerpt from ps where not labeled and len(sents) = 2 and length(sents[1]) <= 46 and length(sents[2]) <= 46 "
            "and abs(length(sents[1]) - length(sents[2])) <= 14 and regexp_matches(sents[1], '^\\p{Lu}') and regexp_matches(sents[2], '^\\p{Lu}')), "
            f"ap as (select doc_id, start_line line, 'aphorism' rule, substr({maxim}[1], 1, 80) excerpt from ps where not labeled and len({maxim}) > 0), "
            f"st as (select doc_id, start_line line, 'staccato' rule, substr(body, 1, 80) excerpt from ps where not labeled and not regexp_matches(body, '^\\s*([-*+]|\\d+[.)])\\s+') and len(regexp_extract_all(body, {lit(steps)})) < 2 and {runs}), "
            "sf as (select * from hd union all select * from tb union all select * from ap union all select * from st), "
            f"wc as (select doc_id, sum(len(regexp_extract_all(line, '{W}+'))) words from cl group by doc_id)")


def density() -> str:
    return (f"{structural()}, dn as (select doc_id, 0 line, 'density' rule, n || ' hits / ' || words || ' words' excerpt from (select doc_id, cast(words as bigint) words, (select count(*) from sf where sf.doc_id = wc.doc_id) n from wc) "
            "where words >= 100 and n * 100.0 / words > 2.0)")


def by_rule(rule: str) -> str:
    return f"with {structural()} select doc_id, cast(line as bigint) line, rule, excerpt from sf where rule = {lit(rule)}"


def cluster_counts() -> str:
    n = lambda p: f"len(regexp_extract_all(body, {lit('(?i)' + p.replace(chr(92) + 'w', W))}))"
    return f"{paragraphs()}, ck as (select doc_id, count(*) filter ({n(ANTITHESIS)} >= 2 or {n(TRIPLET)} >= 2) clusters from paras group by doc_id)"


def amended() -> dict:
    """The rule set that the query findings_amended resolves, put together by hand."""
    c = config.SHIPPED
    return {"no_dashes": True, "load_bearing_literal_only": True, "banned_phrases": [p for p in c["banned_phrases"] if p != "game-changer"] + ["load-bearing wall", "smaller boat"], "engagement_bait": c["engagement_bait"],
            "soft_phrases": c["soft_phrases"] + ["to be honest", "in all honesty", "i'll be real with you"], "filler_words": [w for w in c["filler_words"] if w != "robust"] + ["truthfully", "frankly", "candidly"],
            "watch_words": {"quietly": 2, "actually": 1, "silently": 2}, "dash_density_cap": 1.0}


def catalog() -> str:
    edge = lambda p: p.replace(r"\w", W)
    count = lambda e, p: f"len(regexp_extract_all({e}, {lit('(?i)' + edge(p))}))"
    hedge = count("s", r"\b(?:may|might|could|perhaps|possibly|potentially|somewhat|arguably)\b")
    balanced = count("s", r"^while [^,.!?]{1,80} is [^,.!?]{1,40}, [^.!?]{1,80} is equally ")
    parts = {
        "antithesis": count("body", ANTITHESIS), "triplet": count("body", TRIPLET), "counter": count("body", r"\bcounter-[a-z]+"),
        "opener": count("body", r"^(?:situated|in a world where|in the rapidly evolving landscape of|as we navigate|today, more than ever|in recent years|picture this:|imagine)"),
        "transition": count("body", r"^(?:furthermore|moreover|additionally)\b"),
        "hedges": f"len(list_filter(sents, lambda s: {hedge} >= 3))", "balanced": f"len(list_filter(sents, lambda s: {balanced} >= 1))"}
    rows = " union all ".join(f"select doc_id, start_line, body, '{k}' category, {v} hits from sp" for k, v in parts.items())
    return f"with {sentences()} select doc_id, cast(start_line as bigint) line, category, cast(hits as bigint) hits, substr(body, 1, 80) excerpt from ({rows}) where hits > 0"


# ---------------------------------------------------------------- study

def items(anchor: bool = True) -> str:
    rows = "('correct'), ('wrong'), ('none')" + (", ('anchor')" if anchor else "")
    return ("wr as (select source writer, case when min(doc_id) % 3 <> 0 then 'holdout/' || min(doc_id) end holdout from documents where source is not null group by source), "
            "wrong as (select a.writer target, arg_min(b.writer, sha1('1|' || a.writer || '|' || b.writer)) other from wr a join wr b on a.writer <> b.writer group by a.writer), "
            f"it0 as (select w.writer target, w.holdout, c.condition, case c.condition when 'wrong' then x.other when 'none' then null else w.writer end profile from wr w left join wrong x on x.target = w.writer cross join (values {rows}) c(condition) where c.condition <> 'wrong' or x.other is not null), "
            f"items as (select target, condition, profile, case when condition = 'anchor' then holdout end source, 'item-' || substr(sha1('{RUN}|' || target || '|{BRIEF}|' || condition || '|' || case when condition = 'anchor' then coalesce(holdout, 'none') else coalesce(profile, 'None') end), 1, 8) blind_id from it0)")


def rated() -> str:
    return (f"{items()}, d0 as (select doc_id n, source, ['correct', 'wrong', 'none', 'anchor'][1 + cast(floor(doc_id / 20.0) as bigint) % 4] condition from documents where source is not null), "
            "rt as (select n, case when n % 17 = 0 then 'item-unknown' else blind_id end blind_id, d0.source writer, case when n % 11 = 0 then '' else cast(n * 7 % 5 + 1 as varchar) end rating, case when n % 5 = 0 then 'F' else '' end flag, "
            "n % 13 = 0 pick from d0 left join items on items.target = d0.source and items.condition = d0.condition), "
            "fin as (select * from (select *, row_number() over (partition by blind_id order by n desc) k from rt where rating <> '' and blind_id is not null) where k = 1), "
            "ri as (select i.target, i.condition, cast(rating as double) rating, flag from fin join items i using (blind_id))")


def study_means() -> str:
    one = lambda c: f"avg(rating) filter (condition = '{c}') \"{c}\""
    return f"{rated()}, mn as (select target, {', '.join(map(one, ('correct', 'wrong', 'none', 'anchor')))} from ri group by target), lf as (select *, correct - case when wrong is not null and \"none\" is not null then (wrong + \"none\") / 2 else coalesce(wrong, \"none\") end lift from mn)"
