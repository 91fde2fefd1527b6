"""Command line: check, profile, diff, fix, impact, init and baseline.

Exit codes: 0 below the threshold, 1 at or above it, 2 where something could not be done.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import api
from .operators import baselines, impact, report
from .operators import checks as checks_
from .operators import profile as profiling
from .operators.config import Config, ConfigError, find, load
from .operators.drift import DriftError, compare
from .operators.findings import exit_code
from .operators.impact import ImpactError
from .operators.initialize import learn, to_toml
from .operators.references import ReferenceFault
from .sources import sinks, store
from .sources.tables import EXCEL_SUFFIXES, LoadError, discover

FAILURES = (LoadError, ConfigError, ImpactError, ReferenceFault, baselines.BaselineError, DriftError, OSError)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata", description="Find, measure and repair defects of tables.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, many: bool = False, read: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in paths:
            p.add_argument(x, nargs="+" if many else None)
        if read:
            p.add_argument("--delimiter")
            p.add_argument("--sheet")
            p.add_argument("--max-rows", type=int)
            p.add_argument("--config")
            p.add_argument("--no-config", action="store_true")
        return p

    def reporting(p: argparse.ArgumentParser, *formats: str) -> None:
        p.add_argument("--format", choices=("text", "json", "html", *formats), default="text")
        p.add_argument("--output")
        p.add_argument("--fail-on", choices=("error", "warning", "info", "never"))
        p.add_argument("--ignore", action="append", default=[])

    p = command("check", "paths", many=True)
    reporting(p, "github")
    p.add_argument("--all-sheets", action="store_true")
    p.add_argument("--references", action="append", default=[])
    p.add_argument("--key", action="append", default=[])
    p = command("profile", "path")
    p.add_argument("--all-sheets", action="store_true")
    p = command("diff", "baseline", "current")
    reporting(p)
    p.add_argument("--saved", action="store_true")
    p.add_argument("--baseline-store", default=".baselines")
    p = command("fix", "path")
    for flag in ("--drop-duplicates", "--dry-run", "--explain", "--show-values", "--force"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--output")
    p.add_argument("--log")
    p.add_argument("--min-confidence", choices=("high", "medium"), default="high")
    p.add_argument("--format", choices=("text", "json"), default="text")
    p = command("impact", "path")
    p.add_argument("--sum")
    p.add_argument("--avg", "--mean")
    p.add_argument("--min")
    p.add_argument("--max")
    p.add_argument("--group-by")
    p = command("init", "path")
    p.add_argument("--output", default="lodestrata.toml")
    p.add_argument("--key", action="append", default=[])
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p = commands.add_parser("baseline")
    p.add_argument("action", choices=("save", "list", "show", "verify", "delete"))
    p.add_argument("name", nargs="?")
    p.add_argument("path", nargs="?")
    p.add_argument("--store", default=".baselines")
    p.add_argument("--yes", action="store_true")
    p.add_argument("--delimiter")
    p.add_argument("--sheet")
    return top


def _config(args) -> Config:
    if getattr(args, "no_config", False):
        config = Config()
    else:
        path = getattr(args, "config", None) or find(".")
        config = load(path) if path else Config()
    config.ignore = [*config.ignore, *getattr(args, "ignore", [])]
    config.key = getattr(args, "key", None) or config.key
    config.fail_on = getattr(args, "fail_on", None) or config.fail_on
    return config


def _how(args) -> dict:
    return {k: v for k, v in (("delimiter", args.delimiter), ("sheet", args.sheet), ("max_rows", getattr(args, "max_rows", None))) if v is not None}


def _out(args, text: str, *inputs: str) -> None:
    if not getattr(args, "output", None):
        sys.stdout.write(text)
        return
    if any(os.path.abspath(args.output) == os.path.abspath(x) for x in inputs if x):
        raise OSError(f"{args.output} is an input")
    sinks.write_text(api.session(), args.output, text)


def _profiled(path: str, args) -> profiling.Profiled:
    return profiling.profile(api.open_table(path, **_how(args)))


def _targets(args) -> list[tuple[str, dict]]:
    out = []
    for path in discover(api.session(), args.paths if hasattr(args, "paths") else [args.path]):
        if getattr(args, "all_sheets", False) and path.lower().endswith(EXCEL_SUFFIXES):
            from .sources import excel

            out += [(path, {"sheet": s}) for s in excel.sheet_names(path)]
        else:
            out.append((path, {}))
    return out


def _check(args) -> int:
    config, reports, failed = _config(args), [], []
    targets = _targets(args)
    for path, more in targets:
        try:
            table = api.open_table(path, **(_how(args) | more))
            done = profiling.profile(table)
            found = checks_.run_checks(done, config)
            for spec in args.references:
                ref = checks_.redact(api.check_reference(table, api.Reference.parse(spec), config, api.open_table), checks_.sensitive_columns(done, config))
                found += [f for f in ref if not config.silenced(f.code, f.column)]
            reports.append((f"{path}#{more['sheet']}" if more else path, done.n_rows, len(table.header), found))
            done.close()
        except LoadError as error:
            if len(targets) == 1:
                raise
            failed.append(f"{path}: {error}")
    render = {"text": report.text, "json": report.as_json, "html": report.as_html, "github": lambda p, r, c, f: report.annotations(p, f)}[args.format]
    if args.format == "html" and len(reports) > 1:
        text = report.batch_html(reports)
    elif args.format == "json" and len(reports) > 1:
        text = json.dumps({"reports": [json.loads(report.as_json(*r)) for r in reports], "rollup": report.rollup([(r[0], r[3]) for r in reports]), "failed": failed}, ensure_ascii=False, indent=1) + "\n"
    else:
        text = "\n".join(render(*r) for r in reports)
    _out(args, text, *getattr(args, "paths", []))
    for line in failed:
        print(line, file=sys.stderr)
    return 2 if failed else max((exit_code(r[3], config.fail_on) for r in reports), default=0)


def _profile(args) -> int:
    for path, more in _targets(args):
        done = profiling.profile(api.open_table(path, **(_how(args) | more)))
        print(f"{path}: {report.plural(done.n_rows, 'row')}")
        for p in done.columns:
            stats = "" if p.median is None else f"  median {report.number(p.median)}  {report.number(p.min)} to {report.number(p.max)}"
            print(f"  {report.safe(p.name):28}{p.kind:12}{report.percent(p.n_null, p.n_rows):>7} null  {p.distinct:>10,} distinct{stats}")
    return 0


def _diff(args) -> int:
    config = _config(args)
    old = baselines.verify(api.session(), args.baseline_store, args.baseline) if args.saved else args.baseline
    new = _profiled(args.current, args)
    found = compare(_profiled(old, args), new, config)
    render = {"text": report.text, "json": report.as_json, "html": report.as_html}[args.format]
    _out(args, render(args.current, new.n_rows, len(new.columns), found), args.baseline, args.current)
    return exit_code(found, config.fail_on)


def _fix(args) -> int:
    config, done = _config(args), _profiled(args.path, args)
    if any(f.code in ("ragged-rows", "excel-formulas") for f in done.table.findings) and not args.force:
        raise LoadError(f"{args.path}: rows of several lengths, or formulas, are not repaired; --force does it all the same")
    if args.max_rows and not args.dry_run:
        raise LoadError("a part of a file is not repaired")
    out = api.repair.plan(done, config, args.min_confidence, args.drop_duplicates)
    if args.format == "json" or args.show_values:
        sys.stdout.write(report.plan_json(out, args.show_values))
    elif args.dry_run or args.explain:
        sys.stdout.write(report.plan_text(out, args.explain))
    if args.dry_run:
        return 0
    if (gates := api.repair.hazards(out)) and not args.force:
        raise LoadError(f"{args.path}: not written ({', '.join(gates)}); a spreadsheet could run what it would hold, --force writes it all the same")
    to, log = args.output or f"{os.path.splitext(args.path)[0]}.fixed", args.log or f"{os.path.splitext(args.path)[0]}.changes"
    if {os.path.abspath(to), os.path.abspath(log)} & {os.path.abspath(args.path)} or to == log:
        raise OSError("output and log may not replace the input or each other")
    sep = "\t" if args.path.endswith((".tsv", ".tab")) else done.table.delimiter
    sinks.write_csv(out.table, done.table.header, to, sep)
    sha = "" if store.is_folder(api.session(), args.path) else store.digest(api.session(), args.path)
    sinks.audit_log(out, sha).write.mode("overwrite").option("header", True).option("escape", '"').csv(log)
    print(f"repaired rows in {to}, {report.plural(out.changes.count(), 'change')} in {log}, {report.plural(len(out.refusals), 'refusal')}")
    return 0


def _impact(args) -> int:
    shared = impact.prepare(_profiled(args.path, args), _config(args))
    shown: dict[str, dict] = {}
    if args.sum:
        shown["sum"] = impact.sum_impact(shared, args.sum).first().asDict()
    for name in ("avg", "min", "max"):
        if column := getattr(args, name):
            row = impact.aggregate_impact(shared, column).first().asDict()
            shown[name] = {k: v for k, v in row.items() if k.startswith(name)}
    if args.group_by:
        whole, merges = impact.group_impact(shared, args.group_by, args.sum)
        shown["groups"] = whole.first().asDict()
        if args.group_by not in shared.private:
            shown["groups"]["merges"] = [r.asDict() for r in merges.limit(5).collect()]
    shown["duplicates"] = impact.duplicate_impact(shared, args.sum).first().asDict()
    print(json.dumps(shown, indent=1, ensure_ascii=False, default=str))
    return 0


def _init(args) -> int:
    done = _profiled(args.path, args)
    learnt = learn(checks_.run_checks(done, Config(key=args.key)), args.key)
    text = to_toml(learnt)
    if args.dry_run:
        sys.stdout.write(text)
        return 0
    if store.exists(api.session(), args.output) and not args.force:
        raise OSError(f"{args.output} exists")
    sinks.write_text(api.session(), args.output, text)
    print(f"{args.output}: {report.plural(len(learnt.kept), 'finding')} still reported")
    return 0


def _baseline(args) -> int:
    if args.action == "list":
        print("\n".join(baselines.names(api.session(), args.store)))
    elif args.action == "save":
        done = profiling.profile(api.open_table(args.path, **_how(args)))
        print(json.dumps(baselines.save(api.session(), args.store, args.name, args.path, done.n_rows, done.table.header)))
    elif args.action == "show":
        print(json.dumps(baselines.show(api.session(), args.store, args.name), indent=1))
    elif args.action == "verify":
        print(baselines.verify(api.session(), args.store, args.name))
    elif not args.yes:
        raise baselines.BaselineError("deleting a baseline needs --yes")
    else:
        baselines.delete(api.session(), args.store, args.name)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    run: dict = {"check": _check, "profile": _profile, "diff": _diff, "fix": _fix, "impact": _impact, "init": _init, "baseline": _baseline}
    try:
        return run[args.command](args)
    except FAILURES as error:
        print(f"lodestrata: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())


