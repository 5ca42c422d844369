"""Studies on disk: <root>/writers/<id>/{samples,holdout,profile.md}, <root>/briefs/<id>.md and <root>/runs/<run>/. Participants and items are few; what is
computed from them are the operators of operators.study."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from proselens.operators import study

from . import readers, sinks

PROFILE = "# Voice profile: {}\n\nThe finished profile goes here. Build it from the writer's samples, with one piece held back in holdout/.\n"
BRIEF = "# Brief: {}\n\nFacts, audience and format of the piece to be written, on a subject that the writers have not written about. No prose to imitate.\n"
AUTHORING = ("Write a draft from the brief below in the voice of the profile. Use what the profile says the writer does, keep hedges and every fact, add concrete detail,\n"
             "check the draft against the profile, and do not imitate any source. Give back the draft only.")
RATING = ("Rate each candidate from 1 (clearly not this writer) over 3 (could be anyone) to 5 (unmistakably this writer) before you open the manifest. Flag F where a\n"
          "candidate invents facts, claims more certainty than the brief, or overdoes the writer's habits.")
CHOICE = "Read the reference of each writer, choose the one candidate that sounds most like it, and record its letter in the ratings. Do not open the manifest before."


class RunError(ValueError):
    """A study that cannot go on; the command line turns it into a message and status 1."""


def created(path: Path, text: str) -> Path:
    """Write the file where there is none."""
    path.parent.mkdir(parents=True, exist_ok=True)
    if not path.exists():
        path.write_text(text, encoding="utf-8")
    return path


def add_writer(root: str, writer: str) -> Path:
    home = Path(root) / "writers" / writer
    for part in ("samples", "holdout"):
        (home / part).mkdir(parents=True, exist_ok=True)
    created(home / "profile.md", PROFILE.format(writer))
    return home


def add_brief(root: str, brief: str) -> Path:
    return created(Path(root) / "briefs" / f"{brief}.md", BRIEF.format(brief))


def writers(root: str) -> list[str]:
    home = Path(root) / "writers"
    return sorted(p.name for p in home.iterdir() if p.is_dir()) if home.is_dir() else []


def first_file(folder: Path) -> Path | None:
    """The first by name that does not begin with a dot."""
    return min((p for p in folder.iterdir() if not p.name.startswith(".")), default=None) if folder.is_dir() else None


def text_of(path: Path) -> str:
    return path.read_text(encoding="utf-8", errors="replace")


def plan(spark: SparkSession, root: str, run: str, brief: str, names: list[str], conditions: list[str], anchor: bool = False, seed: int = 1) -> Path:
    """Assign conditions and write the manifest. A run that has one is refused."""
    home = Path(root) / "runs" / run
    if (home / "manifest.json").exists():
        raise RunError(f"run {run!r} has a plan already; delete {home} to plan it anew")
    known = writers(root)
    if unknown := [w for w in names if w not in known]:
        raise RunError(f"unknown writer {unknown[0]!r}")
    if not (Path(root) / "briefs" / f"{brief}.md").exists():
        raise RunError(f"unknown brief {brief!r}")
    rows = []
    for w in names:
        held = first_file(Path(root) / "writers" / w / "holdout")
        rows.append((w, str(held.relative_to(root)) if held else None))
    schema = "writer string, holdout string"
    try:
        items = study.plan(spark.createDataFrame(rows, schema), run, brief, conditions, anchor, seed, spark.createDataFrame([(w,) for w in known], "writer string") if len(names) < 2 else None)
    except ValueError as e:
        raise RunError(str(e)) from e
    for part in ("drafts", "prompts"):
        (home / part).mkdir(parents=True, exist_ok=True)
    (home / "manifest.json").write_text(sinks.manifest_json(items, run, brief, names, conditions, anchor, seed), encoding="utf-8")
    return home / "manifest.json"


def items_of(spark: SparkSession, root: str, run: str) -> tuple[Path, DataFrame]:
    home = Path(root) / "runs" / run
    if not (home / "manifest.json").exists():
        raise RunError(f"no run {run!r}; plan it first")
    return home, readers.manifest(spark, str(home / "manifest.json"))


def write_prompts(spark: SparkSession, root: str, run: str) -> int:
    """One prompt file for each authored item, and the drafts of anchors; returns the number of prompts."""
    home, items = items_of(spark, root, run)
    row = items.first()
    profiles = [(w, text_of(p)) for w in writers(root) if (p := Path(root) / "writers" / w / "profile.md").exists()]
    found = items.where("kind = 'anchor' and source is not null").select("source").collect()
    held = [(r["source"], text_of(p)) for r in found if (p := Path(root) / r["source"]).exists()]
    for r in study.anchor_drafts(items, spark.createDataFrame(held, "path string, text string")).collect():
        (home / "drafts" / f"{r['blind_id']}.md").write_text(r["text"], encoding="utf-8")
    brief = text_of(Path(root) / "briefs" / f"{row['brief']}.md") if row else ""
    made = study.prompts(items, brief, spark.createDataFrame(profiles, "writer string, text string"), AUTHORING).collect()
    for r in made:
        (home / "prompts" / f"{r['blind_id']}.txt").write_text(r["prompt"], encoding="utf-8")
    return len(made)


def write_sheet(spark: SparkSession, root: str, run: str, kind: str = "rating") -> Path:
    """The rating sheet and the blank ratings; kind (rating or forcedchoice) changes the instructions only."""
    home, items = items_of(spark, root, run)
    manifest = readers.manifest_keys(spark, str(home / "manifest.json"))
    drafts = [(r["blind_id"], text_of(p)) for r in items.select("blind_id", "draft").collect() if (p := home / r["draft"]).exists()]
    samples = [(w, str(p), text_of(p)) for w in writers(root) if (p := first_file(Path(root) / "writers" / w / "samples"))]
    rows = study.sheet(items, manifest["seed"])
    references = study.reference_block(spark.createDataFrame(samples, "writer string, path string, text string"))
    text = sinks.sheet_markdown(rows, spark.createDataFrame(drafts, "blind_id string, text string"), references, f"Blind rating sheet: run {run} (brief {manifest['brief']})", RATING if kind == "rating" else CHOICE)
    (home / "rating-sheet.md").write_text(text, encoding="utf-8")
    sinks.ratings_file(rows, home / "ratings.csv")
    return home / "rating-sheet.md"


def score(spark: SparkSession, root: str, run: str) -> str:
    """The results of the run, also written beside its manifest."""
    home, items = items_of(spark, root, run)
    if not (home / "ratings.csv").exists():
        raise RunError(f"no ratings for run {run!r}; write its sheet first")
    text = sinks.results_markdown(items, readers.ratings(spark, str(home / "ratings.csv")), f"Results: run {run}")
    (home / "results.md").write_text(text, encoding="utf-8")
    return text
