"""Command line: scan, stats, overview, guide, completions.  Exit code 0 without findings, 1 with, 2 on errors; overview and stats give 0."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from .config import Config, ConfigError, load_config

GUIDE = {
    "setup": "Run 'python -m dupeloom scan <folder>'. Settings come from dupeloom.toml, or from [tool.dupeloom] of pyproject.toml.",
    "triage": "Merge functions that should change together; leave those that are alike by chance, and mark them '# dupeloom: ignore -- <reason>'; '# dupeloom: ignore-file' in a file's first five lines leaves it out.",
    "tune": "exact_min_lines and exact_min_stmts bound identical functions, similar_min_lines and threshold those that are alike; min_lines sets both line floors.",
}


#: Files that say how a project runs its checks, and what to add to them.
PLACES = {
    ".pre-commit-config.yaml": "a local hook with 'entry: python -m dupeloom scan .' and 'pass_filenames: false'",
    ".github/workflows": "a step 'python -m dupeloom scan . --format sarif > dupeloom.sarif' and an upload of that file",
    "tox.ini": "an environment with 'commands = python -m dupeloom scan .'",
    "noxfile.py": "a session that runs 'python -m dupeloom scan .'",
    "Makefile": "a target 'duplicates: ; python -m dupeloom scan .'",
    "pyproject.toml": "settings in [tool.dupeloom]",
}


def guide(topic: str, folder: Path) -> str:
    """A topic's text; for 'setup' also what the folder's own files suggest."""
    found = [f"{name}: {advice}." for name, advice in PLACES.items() if (folder / name).exists()] if topic == "setup" else []
    return "\n".join([GUIDE[topic], *(["Found here:", *(f"  {x}" for x in found)] if found else [])])


def completions(shell: str) -> str:
    """A script that completes commands and options in a shell."""
    commands = {name: sorted(o for a in p._actions for o in a.option_strings if o.startswith("--")) for name, p in parser()._subparsers._group_actions[0].choices.items()}
    if shell == "fish":
        lines = [f"complete -c dupeloom -n __fish_use_subcommand -a '{' '.join(commands)}'"]
        return "\n".join(lines + [f"complete -c dupeloom -n '__fish_seen_subcommand_from {name}' -l {o[2:]}" for name, options in commands.items() for o in options]) + "\n"
    cases = "\n".join(f"    {name}) words='{' '.join(options)}' ;;" for name, options in commands.items())
    head = "autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else ""
    return f"""{head}_dupeloom() {{
  local words='{" ".join(commands)}'
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  COMPREPLY=($(compgen -f -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -F _dupeloom dupeloom
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dupeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "stats", "overview"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--format", choices=("text", "json", "sarif"))
        c.add_argument("--threshold", type=float)
        c.add_argument("--min-lines", type=int)
        c.add_argument("--exact-min-lines", type=int)
        c.add_argument("--similar-min-lines", type=int)
        c.add_argument("--exact-min-stmts", type=int)
        c.add_argument("--max-results", type=int)
        c.add_argument("--exclude", action="append")
        c.add_argument("--tests", action="store_true", help="scan test files only")
        c.add_argument("--containment", action="store_true")
        c.add_argument("--suggest", action="store_true")
        c.add_argument("--method", choices=("exact", "minhash"), default="exact")
        c.add_argument("--focus", action="append", help="report findings that touch this file")
        c.add_argument("--focus-from", help="file with a path on each line, or - for standard input")
        c.add_argument("--save", metavar="FOLDER", help="also write all relations of the report there, as Parquet")
        c.add_argument("-v", "--verbose", action="count", default=0)
    g = sub.add_parser("guide")
    g.add_argument("topic", nargs="?", choices=sorted(GUIDE), default="setup")
    sub.add_parser("completions").add_argument("shell", choices=("bash", "zsh", "fish"))
    return p


def resolved(args: argparse.Namespace) -> Config:
    """The folder's settings with the command line's on top."""
    folder = Path(args.path)
    config = load_config(folder if folder.is_dir() else folder.parent)
    scan = {k: getattr(args, k) for k in ("threshold", "min_lines", "exact_min_lines", "similar_min_lines", "exact_min_stmts") if getattr(args, k) is not None}
    if args.exclude:
        scan["exclude"] = (*config.scan.exclude, *args.exclude)
    config = config.with_settings("scan", **scan)
    if args.tests:
        config = config.with_settings("scan", include=config.scan.scoped_to_tests().include, exclude=())
    output = {k: v for k, v in (("format", args.format), ("max_results", args.max_results)) if v is not None}
    config = config.with_settings("output", **output)
    if args.containment:
        config = config.with_settings("containment", enabled=True)
    if args.suggest:
        config = config.with_settings("suggest", enabled=True)
    return config.check()


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "guide":
        print(guide(args.topic, Path.cwd()))
        return 0
    if args.command == "completions":
        print(completions(args.shell), end="")
        return 0
    logging.basicConfig(stream=sys.stderr, level=(logging.WARNING, logging.INFO, logging.DEBUG)[min(args.verbose, 2)])
    from .overview import file_overview, format_overview, function_entries, ordered_files, partner_lists
    from .plans.scan import scan
    from .report import FORMATS, _rows, save
    from .sources.files import read_focus_list
    from .stats import format_stats

    try:
        config = resolved(args)
        if not Path(args.path).exists():
            raise ConfigError(f"{args.path} does not exist")
        focus = None
        if args.focus or args.focus_from:
            focus = [*(args.focus or ()), *(read_focus_list(args.focus_from) if args.focus_from else ())]
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("dupeloom").config("spark.ui.enabled", "false").getOrCreate()
        report = scan(spark, args.path, config, focus, args.method)
        if args.save:
            save(report, args.save)
        as_json = config.output.format == "json"
        if args.command == "stats":
            print(format_stats(report.statistics().first().asDict(), report.suppressed(), as_json), end="")
            return 0
        if args.command == "overview":
            entries = function_entries(report.fragments.drop("tree", "shingles", "body_shingles", "runs", "statement_lines"), report.pairs, report.containments)
            if as_json:
                entries = entries.join(partner_lists(report.pairs), "frag_id", "left")
            rows = _rows(entries)
            names = {r["frag_id"]: r["name"] for r in rows}
            print(format_overview(_rows(ordered_files(file_overview(report.fragments, report.pairs, report.containments))), rows, names, as_json), end="")
            return 0
        print(FORMATS[config.output.format](report), end="")
        found = not report.pairs.isEmpty() or report.containments is not None and not report.containments.isEmpty()
        return int(found)
    except (ConfigError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
