"""Command line: python -m proselens lint|structure FILE..., score MANIFEST RATINGS, and study add-writer|add-brief|plan|prompts|sheet|score.

Status 0; 1 for findings that count and for studies that cannot go on; 2 for files that cannot be read, settings that are not valid and other failures; 130 when interrupted."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from proselens.operators import config, phrases, report, structure
from proselens.sources import readers, runs, sinks


def arguments() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="proselens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("lint", "structure"):
        s = sub.add_parser(name)
        s.add_argument("files", nargs="+", help="files, or - for standard input")
        s.add_argument("--json", action="store_true")
        s.add_argument("--strict", action="store_true")
        if name == "lint":
            s.add_argument("--config")
            s.add_argument("--base", choices=["fallback", "shipped"], default="fallback")
            s.add_argument("--preset", choices=sorted(config.PRESETS), action="append", default=[])
            s.add_argument("--html", action="store_true")
            s.add_argument("--quiet", action="store_true")
    s = sub.add_parser("score")
    s.add_argument("manifest")
    s.add_argument("ratings")
    s = sub.add_parser("study")
    s.add_argument("--root", default="data")
    more = s.add_subparsers(dest="step", required=True)
    for name in ("add-writer", "add-brief", "plan", "prompts", "sheet", "score"):
        t = more.add_parser(name)
        t.add_argument("id")
        if name == "plan":
            t.add_argument("--brief", required=True)
            t.add_argument("--writers", required=True)
            t.add_argument("--conditions", default="correct,wrong,none")
            t.add_argument("--anchor", action="store_true")
            t.add_argument("--seed", type=int, default=1)
        if name == "sheet":
            t.add_argument("--format", choices=["rating", "forcedchoice"], default="rating")
    return ap


def lint(spark: SparkSession, args) -> int:
    cfg = config.with_presets(config.load(args.config, args.base), args.preset)
    docs, failed = readers.named_files(spark, args.files, args.html)
    for f in failed:
        print(f"proselens: {f}", file=sys.stderr)
    checked = phrases.checked(docs, cfg).cache()
    rows = lambda: checked.orderBy("ord").select("path", "findings", "suppressed").toLocalIterator()
    total = report.totals(report.by_document(checked, ("path",)))
    t = total.first()
    if args.json:
        files = {r["path"]: [{k: f[k] for k in report.FIELDS} for f in r["findings"]] for r in rows()}  # files named on the command line
        print(json.dumps({"suppressed": t["suppressed"], "files": files}, indent=2, ensure_ascii=False))
    else:
        if not args.quiet:
            for r in rows():
                for f in r["findings"]:
                    print(f"{r['path']}:{f['line']}:{f['col']} [{f['severity']}] {f['rule']}: {f['message']}  ->  {f['match']!r}")
        silent = f", {t['suppressed']} suppressed" if t["suppressed"] else ""
        print(f"proselens: {t['errors']} error(s), {t['warnings']} warning(s){silent} across {t['documents']} file(s).")
    return 2 if failed else report.exit_status(total, args.strict).first()[0]


def structural(spark: SparkSession, args) -> int:
    """A file that cannot be read, or is not UTF-8, ends the run before anything is printed."""
    docs, failed = readers.named_files(spark, args.files, strict=True, repeats=True)
    if failed:
        raise OSError(failed[0])
    docs = docs.cache()
    if bad := docs.where("error is not null").orderBy("ord").first():
        raise ValueError(f"not UTF-8: {bad['path']}")
    found = structure.findings(docs, ("ord", "path")).orderBy("ord", "place")
    rows = [r.asDict() for r in found.collect()]  # of files named on the command line
    if args.json:
        print(json.dumps([{"file": r["path"], **{k: r[k] for k in ("line", "rule", "excerpt", "message")}} for r in rows], indent=2, ensure_ascii=False))
    else:
        for r in rows:
            print(f"{r['path']}:{r['line']} [warning] {r['rule']}: {r['message']}  ->  {r['excerpt']!r}")
        print(f"proselens: {len(rows)} structural warning(s).")
    return int(args.strict and len(rows) > 0)


def studied(spark: SparkSession, args) -> int:
    split = lambda s: [x.strip() for x in s.split(",") if x.strip()]
    try:
        if args.step == "add-writer":
            print(runs.add_writer(args.root, args.id))
        elif args.step == "add-brief":
            print(runs.add_brief(args.root, args.id))
        elif args.step == "plan":
            print(runs.plan(spark, args.root, args.id, args.brief, split(args.writers), split(args.conditions), args.anchor, args.seed))
        elif args.step == "prompts":
            print(f"{runs.write_prompts(spark, args.root, args.id)} prompts")
        elif args.step == "sheet":
            print(runs.write_sheet(spark, args.root, args.id, args.format))
        else:
            print(runs.score(spark, args.root, args.id))
    except runs.RunError as e:
        print(f"proselens: {e}", file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        spark = SparkSession.builder.getOrCreate()
        if args.cmd == "score":
            print(sinks.results_markdown(readers.manifest(spark, args.manifest), readers.ratings(spark, args.ratings), "Results"))
            return 0
        return {"lint": lint, "structure": structural, "study": studied}[args.cmd](spark, args)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  any failure is status 2 at the command line, as 1 stands for findings
        print(f"proselens: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
