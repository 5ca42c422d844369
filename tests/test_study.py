import hashlib

import pytest
from pyspark.sql import functions as F

from proselens.operators import study, verdicts


def test_blind_id(spark):
    got = spark.range(1).select(study.blind_id(F.lit("run1"), F.lit("w1"), F.lit("b1"), F.lit("none"), F.lit(None))).first()[0]
    assert got == "item-e1caad15" == "item-" + hashlib.sha1(b"run1|w1|b1|none|None").hexdigest()[:8]


def test_plan(spark):
    w = spark.createDataFrame([("a", "h/a"), ("b", None)], "writer string, holdout string")
    rows = study.plan(w, "r", "b", anchor=True).collect()
    assert len(rows) == 8 and {(r["target"], r["profile"]) for r in rows if r["condition"] == "wrong"} == {("a", "b"), ("b", "a")}
    assert {r["source"] for r in rows if r["kind"] == "anchor"} == {"h/a", None}
    assert study.plan(w.where("writer = 'a'"), "r", "b").count() == 2
    everyone = spark.createDataFrame([("a",), ("z",)], "writer string")
    assert study.plan(w.where("writer = 'a'"), "r", "b", everyone=everyone).where("condition = 'wrong'").first()["profile"] == "z"
    with pytest.raises(ValueError):
        study.plan(w, "r", "b", conditions=("odd",))
    sheet = study.sheet(study.plan(w, "r", "b")).collect()
    assert sorted(r["candidate"] for r in sheet if r["writer"] == "a") == ["a", "b", "c"]


def test_scores(spark):
    items = spark.createDataFrame([("a1", "a", "correct"), ("a2", "a", "wrong"), ("a3", "a", "none"), ("a4", "a", "anchor"), ("b1", "b", "correct"), ("b2", "b", "wrong"), ("b3", "b", "none"), ("c1", "c", "correct")], "blind_id string, target string, condition string")
    rows = [("a1", "a", "1", ""), ("a1", "a", "4", " f "), ("a1", "a", "  ", ""), ("a2", "a", "2", ""), ("a3", "a", "3", ""), ("a4", "a", "5", ""), ("b1", "b", "3", ""), ("b2", "b", "3", ""), ("b3", "b", "", "F"), ("zz", "b", "5", "F"), ("c1", "c", "4", "")]
    picks = {0: "a", 9: "b"}
    r = spark.createDataFrame([(k, i, w, "a" if k else "b", v, f, picks.get(k, "")) for k, (i, w, v, f) in enumerate(rows)], "row_no long, blind_id string, writer string, candidate string, rating string, fidelity_flag string, forced_choice_pick string")
    lifts = {x["target"]: x["lift"] for x in study.lift(study.means(items, r)).collect()}
    assert lifts == {"a": 1.5, "b": 0.0, "c": None}
    assert study.pooled(study.lift(study.means(items, r))).first().asDict() == {"mean_lift": 0.75, "min_lift": 0.0, "max_lift": 1.5, "writers": 2}
    assert study.flags(items, r).first()[0] == 1
    assert study.forced_choice(items, r).first().asDict() == {"hits": 1, "total": 2, "percent": 50.0}
    assert study.forced_choice(items, r.where("row_no > 90")).first().asDict() == {"hits": 0, "total": 0, "percent": 0.0}


def test_verdicts(spark):
    five = (5, 5, 5, 5, 5, 5, 5)
    cases = [(five, 400, 2, 0, "PASS"), ((3, 5, 5, 5, 5, 5, 5), 400, 0, 0, "REVISE"), ((2, 5, 5, 5, 5, 5, 5), 400, 0, 0, "REVISE"), ((2, 2, 5, 5, 5, 5, 5), 400, 0, 0, "REWRITE"), (five, 150, 4, 0, "REVISE"),
             (five, 149, 2, 0, "PASS"), (five, 150, 3, 0, "REVISE"), (five, 200, 6, 2, "REWRITE"), ((5, 5, 5, 5, 2, 5, 5), 400, 0, 0, "REVISE"), (five, 0, 0, 0, "PASS")]
    d = spark.createDataFrame([(k, *c[0], *c[1:4], False) for k, c in enumerate(cases)], "k int, d1 int, d2 int, d3 int, d4 int, d5 int, d6 int, d7 int, words long, flagged long, clusters int, missing_markers boolean")
    got = {r["k"]: r for r in verdicts.verdict(d).collect()}
    assert [got[k]["verdict"] for k in range(len(cases))] == [c[4] for c in cases]
    assert got[8]["driver"] == "d5-gap" and got[4]["driver"] == "density" and got[6]["driver"] == "hits"


def test_gates(spark):
    d = spark.createDataFrame([("a", 400, False)] * 4 + [("a", 10, True), ("b", 2000, False)], "writer string, words int, holdout boolean")
    assert {r["writer"]: r["ready"] for r in verdicts.profile_gate(d).collect()} == {"a": True, "b": False}
    assert [r[0] for r in spark.createDataFrame([(100, 110), (100, 111), (0, 0)], "a int, b int").select(verdicts.length_gate(F.col("a"), F.col("b"))).collect()] == [True, False, True]
