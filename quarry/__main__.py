"""Command line: ``python -m quarry scan|stale|diff|structure|style|accept|fix ROOT``.

Exit codes: 0 nothing to act on, 1 a finding that is not accepted reaches ``--fail-on``, 2 a usage or input error.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quarry import report
from quarry.functions.storage import local_session
from quarry.plans import deletion
from quarry.session import COMMANDS, AuditSession
from quarry.sources import config, files, history, ledger


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarry")
    out.add_argument("command", choices=[*COMMANDS, "accept", "fix"])
    out.add_argument("root", nargs="?", default=".")
    out.add_argument("--config")
    out.add_argument("--format", choices=["text", "json", "sarif"], default="text")
    out.add_argument("--confidence", choices=list(report.FLOORS), default="all")
    out.add_argument("--accepted", help="ledger of accepted findings")
    out.add_argument("--fail-on", choices=list(report.FLOORS))
    out.add_argument("--base", help="commit that diff and fix compare with")
    out.add_argument("--baseline", help="commit or date whose files style compares with")
    out.add_argument("--experimental", action="store_true")
    out.add_argument("--output", help="file for accept's ledger or fix's plan")
    out.add_argument("--plan", help="reviewed plan that fix applies")
    out.add_argument("--validate", action="append", default=[], help="shell command that must succeed without the files")
    out.add_argument("--restore", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (config.ConfigError, ledger.LedgerError, deletion.PlanError, ValueError, OSError) as e:
        print(f"quarry: {e}", file=sys.stderr)
        return 2


def run(args: argparse.Namespace) -> int:
    if args.command == "fix" and args.restore:
        print("\n".join(deletion.restore_last(args.root)))
        return 0
    spark = local_session()
    accepted = ledger.load(spark, args.accepted) if args.accepted else None  # before any analysis
    settings = config.load(args.root, args.config)
    base = args.base or ("HEAD" if args.command in ("diff", "fix") else None)
    session = AuditSession.from_directory(spark, args.root, settings, base)
    command = {"accept": "scan", "fix": "stale"}.get(args.command, args.command)
    baseline = files.snapshot(spark, args.root, history.resolve(args.root, args.baseline)) if args.baseline else None
    findings = session.findings(command, args.experimental, baseline).cache()
    if args.command == "accept":
        text = ledger.dump(ledger.build(findings, accepted).collect())
        Path(args.output or "quarry-accepted.json").write_text(text, "utf-8")
        return 0
    remaining = findings.join(accepted.select("id").distinct(), "id", "left_anti").select(*findings.columns) if accepted is not None else findings
    if args.command == "fix":
        head = (files.git(args.root, "rev-parse", "HEAD") or b"").decode().strip() or None
        plan = deletion.build(args.root, remaining, settings, args.base, head)
        if not args.plan:
            text = json.dumps(plan, indent=2, sort_keys=True) + "\n"
            Path(args.output).write_text(text, "utf-8") if args.output else print(text, end="")
            return 0
        reviewed = deletion.load(args.plan)
        deletion.require_same(reviewed, plan)
        print(json.dumps(deletion.apply(args.root, reviewed, args.validate), indent=2))
        return 0
    write = {"text": report.to_text, "sarif": report.to_sarif}.get(args.format)
    if write:
        print(write(remaining, command, args.confidence), end="")
    else:
        metrics = {k: v for k, v in session.metrics(command).drop("repo").first().asDict().items()}
        if accepted is not None:
            metrics["accepted_findings"] = findings.count() - remaining.count()
        print(report.to_json(remaining, command, root=str(args.root), confidence=args.confidence, metrics=metrics, base=base), end="")
    return report.exit_code(remaining, args.fail_on)


if __name__ == "__main__":
    sys.exit(main())
