"""Sinks: manifests, rating sheets, ratings and results. Study tables are as small as their participants; documents stay in DataFrames."""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.operators import study

HEADINGS = {"correct": "correct", "wrong": "wrong", "none": "none", "anchor": "anchor"}


def manifest_json(items: DataFrame, run: str, brief: str, writers: list[str], conditions: list[str], anchor: bool, seed: int) -> str:
    """The manifest of a run, keys sorted; source only on anchors."""
    rows = [r.asDict() for r in items.drop("run").orderBy("target", "condition").collect()]  # the run's items
    for r in rows:
        if r["kind"] != "anchor":
            r.pop("source")
    return json.dumps({"run": run, "brief": brief, "writers": writers, "conditions": conditions, "anchor": anchor, "seed": seed, "items": rows}, indent=2, sort_keys=True)


def write_ratings(sheet: DataFrame, path: str) -> None:
    """The blank rating table as CSV with a header."""
    sheet.select(*[c.split()[0] for c in study.RATINGS.split(", ")]).write.option("emptyValue", "").csv(path, header=True)


def ratings_file(sheet: DataFrame, path) -> None:
    """The same in one file, which raters edit; a study's rows are few."""
    names = [c.split()[0] for c in study.RATINGS.split(", ")]
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(names)
        w.writerows([r[n] for n in names] for r in sheet.orderBy("writer", "candidate").collect())


def sheet_markdown(sheet: DataFrame, drafts: DataFrame, references: DataFrame, title: str, instructions: str) -> str:
    """The rating sheet: for each writer the reference, then the candidates. drafts (blind_id, text), references (writer, reference)."""
    rows = sheet.join(drafts, "blind_id", "left").join(references, "writer", "left").orderBy("writer", "candidate").collect()
    out, last = [f"# {title}", "", instructions, ""], None
    for r in rows:
        if r["writer"] != last:
            last = r["writer"]
            out += [f"## Writer: {last}", "", "Reference (real writing by this writer):", "", r["reference"] or study.NO_REFERENCE, "", "Candidates:", ""]
        out += [f"### {last} / candidate {r['candidate']}  [{r['blind_id']}]", "", (r["text"] or "").strip() or "(draft not generated yet)", ""]
    return "\n".join(out)


def results_markdown(items: DataFrame, ratings: DataFrame, title: str) -> str:
    """Means by condition and lift of each writer, pooled lift, fidelity flags and forced choice."""
    out, lifts = [f"# {title}", ""], study.lift(study.means(items, ratings))
    for r in lifts.orderBy("target").collect():
        means = ", ".join(f"{HEADINGS[c]}={r[c]:.2f}" for c in study.CONDITIONS if r[c] is not None)
        out.append(f"- **{r['target']}**: {means}" + (f"  ->  lift = {r['lift']:+.2f}" if r["lift"] is not None else "  (no lift without correct and a control)"))
    p, f, c = study.pooled(lifts).first(), study.flags(items, ratings).first()[0], study.forced_choice(items, ratings).first()
    if p["writers"]:
        out += ["", f"**Pooled lift:** mean {p['mean_lift']:+.2f} over {p['writers']} writer(s), from {p['min_lift']:+.2f} to {p['max_lift']:+.2f}."]
    if f:
        out.append(f"**Fidelity flags:** {f} candidate(s).")
    if c["total"]:
        out.append(f"**Forced choice:** {c['hits']}/{c['total']} ({c['percent']:.0f}%).")
    if len(out) == 2:
        out.append("No ratings found.")
    return "\n".join(out)


def merged_findings(*findings: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Findings of several passes, each place (keys, line, col) once: the most severe, then the first rule by name."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    best = F.min(F.struct((F.col("severity") != "error").alias("mild"), "rule", "match", "message", "severity")).alias("b")
    return out.groupBy(*keys, "line", "col").agg(best).select(*keys, "line", "col", "b.severity", "b.rule", "b.match", "b.message")
