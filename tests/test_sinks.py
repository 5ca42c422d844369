import csv
import io
import json

from proselens import __main__ as cli
from proselens.operators import study
from proselens.sources import readers, sinks


def test_round_trip_of_a_run(spark, tmp_path):
    w = spark.createDataFrame([("a", "h/a"), ("b", None)], "writer string, holdout string")
    items = study.plan(w, "r", "b", anchor=True)
    (tmp_path / "m.json").write_text(sinks.manifest_json(items, "r", "b", ["a", "b"], ["correct", "wrong", "none"], True, 1))
    assert readers.manifest(spark, str(tmp_path / "m.json")).count() == 8
    assert "source" not in json.loads((tmp_path / "m.json").read_text())["items"][1]
    sheet = study.sheet(items)
    sinks.write_ratings(sheet, str(tmp_path / "ratings"))
    assert readers.ratings(spark, str(tmp_path / "ratings")).count() == 8
    md = sinks.sheet_markdown(sheet, spark.createDataFrame([("x", "y")], "blind_id string, text string"), spark.createDataFrame([("a", "ref")], "writer string, reference string"), "Sheet", "Rate.")
    assert md.count("### ") == 8 and study.NO_REFERENCE in md and "ref" in md
    ids = {(r["target"], r["condition"]): r["blind_id"] for r in items.collect()}
    rows = [(ids["a", "correct"], "4"), (ids["a", "wrong"], "2"), (ids["a", "none"], "3")]
    (tmp_path / "r.csv").write_text("blind_id,writer,candidate,rating,fidelity_flag,forced_choice_pick\n" + "".join(f"{i},a,a,{v},,\n" for i, v in rows))
    text = sinks.results_markdown(readers.manifest(spark, str(tmp_path / "m.json")), readers.ratings(spark, str(tmp_path / "r.csv")), "T")
    assert "lift = +1.50" in text


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "good.md").write_text("Clean.\n")
    (tmp_path / "bad.md").write_text("This is a game-changer. Robust.\n")
    (tmp_path / "warn.md").write_text("Robust.\n")
    run = lambda *a: cli.main([*a[:1], *(str(tmp_path / x) if x.endswith((".md", ".json")) else x for x in a[1:])])
    assert [run("lint", "good.md"), run("lint", "bad.md"), run("lint", "warn.md"), run("lint", "warn.md", "--strict"), run("lint", "none.md")] == [0, 1, 0, 1, 2]
    assert "banned-phrase" in capsys.readouterr().out
    (tmp_path / "c.json").write_text('{"no_dash": true}')
    assert run("lint", "good.md", "--config", "c.json") == 2
    (tmp_path / "two.md").write_text("None of them wrong. None of them ours.\n")
    assert [run("structure", "two.md"), run("structure", "two.md", "--strict"), run("structure", "good.md", "--strict")] == [0, 1, 0]


def test_json_errors_and_standard_input(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "b.md").write_text('It is "robust", isn\'t it?\nThey call the oven a game-changer. <!-- proselint: ignore -->\n')
    (tmp_path / "a.md").write_text("Clean.\n")
    b, a, none = (str(tmp_path / n) for n in ("b.md", "a.md", "none.md"))
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("Robust \xff.".encode("latin-1"))))
    assert cli.main(["lint", "--json", b, a, none, "-", b]) == 2  # one cannot be read; the others are reported all the same
    out = capsys.readouterr()
    got = json.loads(out.out)
    assert list(got["files"]) == [b, a, "-"] and got["suppressed"] == 1 and got["files"][a] == [] and "none.md" in out.err
    assert got["files"][b] == [{"line": 1, "col": 8, "severity": "warning", "rule": "filler", "match": "robust", "message": got["files"][b][0]["message"]}]
    assert cli.main(["lint", b, "--preset", "fillers"]) == 0 and f"{b}:1:8 [warning] filler:" in capsys.readouterr().out
    (tmp_path / "bad.md").write_bytes(b"\xff")
    assert cli.main(["structure", "--json", a, str(tmp_path / "bad.md")]) == 2 and not capsys.readouterr().out
    (tmp_path / "two.md").write_text("Two of them new. Two of them torn.\n")
    assert cli.main(["structure", "--json", a, str(tmp_path / "two.md")]) == 0
    assert [(r["line"], r["rule"], sorted(r)) for r in json.loads(capsys.readouterr().out)] == [(1, "two-beat", ["excerpt", "file", "line", "message", "rule"])]
    monkeypatch.setattr(cli, "lint", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    assert cli.main(["lint", a]) == 130


def test_study_from_plan_to_results(spark, tmp_path, capsys):
    root = ["study", "--root", str(tmp_path)]
    assert [cli.main([*root, "add-writer", w]) for w in ("ann", "ben")] == [0, 0] and cli.main([*root, "add-brief", "tide"]) == 0
    (tmp_path / "writers/ann/holdout/x.md").write_text("Held back.")
    (tmp_path / "writers/ann/samples/s.md").write_text("  A sample. " + "z" * 1300)
    (tmp_path / "writers/ann/profile.md").write_text("Short sentences.")
    assert cli.main([*root, "add-writer", "ann"]) == 0 and (tmp_path / "writers/ann/profile.md").read_text() == "Short sentences."  # kept
    plan = [*root, "plan", "r1", "--brief", "tide", "--writers", "ann, ben", "--anchor"]
    assert cli.main([*plan[:-4], "none", *plan[-3:]]) == 1 and cli.main([*root, "prompts", "r1"]) == 1
    assert cli.main(plan) == 0 and cli.main(plan) == 1 and "already" in capsys.readouterr().err
    items = json.loads((tmp_path / "runs/r1/manifest.json").read_text())["items"]
    assert len(items) == 8 and cli.main([*root, "prompts", "r1"]) == 0
    by = {(i["target"], i["condition"]): i["blind_id"] for i in items}
    prompt = lambda w, c: (tmp_path / f"runs/r1/prompts/{by[w, c]}.txt").read_text()
    assert "Short sentences." in prompt("ann", "correct") and study.NO_PROFILE in prompt("ben", "none") and len(list((tmp_path / "runs/r1/prompts").iterdir())) == 6
    assert [(tmp_path / f"runs/r1/drafts/{by[w, 'anchor']}.md").read_text() for w in ("ann", "ben")] == ["Held back.", study.NO_HOLDOUT]
    assert cli.main([*root, "sheet", "r1", "--format", "forcedchoice"]) == 0
    sheet = (tmp_path / "runs/r1/rating-sheet.md").read_text()
    assert "Held back." in sheet and "..." in sheet and study.NO_REFERENCE in sheet and "(draft not generated yet)" in sheet
    rows = list(csv.DictReader(open(tmp_path / "runs/r1/ratings.csv")))
    assert [r["candidate"] for r in rows] == list("abcd") * 2 and all(r["rating"] == "" for r in rows)
    for r in rows:
        r["rating"] = "5" if r["blind_id"] == by["ann", "correct"] else "2" if r["blind_id"] == by["ann", "none"] else ""
    with open(tmp_path / "runs/r1/ratings.csv", "w", newline="") as f:
        w = csv.DictWriter(f, rows[0])
        w.writeheader()
        w.writerows(rows)
    assert cli.main([*root, "score", "r1"]) == 0 and "lift = +3.00" in (tmp_path / "runs/r1/results.md").read_text()


def test_merged(spark):
    a = spark.createDataFrame([(1, 1, 2, "warning", "soft", "x", "m"), (1, 3, 1, "warning", "filler", "y", "m")], "doc_id long, line int, col int, severity string, rule string, match string, message string")
    b = spark.createDataFrame([(1, 1, 2, "error", "banned", "x", "m")], a.schema)
    assert sorted((r["line"], r["rule"]) for r in sinks.merged_findings(a, b).collect()) == [(1, "banned"), (3, "filler")]
