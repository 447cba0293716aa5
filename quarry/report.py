"""Reports of findings: JSON, SARIF, text, Markdown, and the exit code for automation.

Reports are read by people and tools, so their rows come to the driver; everything before stays distributed.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import tier

FLOORS = {"high": 0.85, "medium": 0.65, "all": 0.0}
TOOL = "quarry"


def above(findings: DataFrame, confidence: str) -> DataFrame:
    return findings.where(F.col("confidence") >= FLOORS[confidence])


def summary(findings: DataFrame) -> dict[str, Any]:
    """Counts by rule and confidence; taken before any floor."""
    rows = findings.groupBy("rule", tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n")).collect()
    rules: dict[str, int] = {}
    tiers = {"high": 0, "medium": 0, "low": 0}
    for r in rows:
        rules[r["rule"]] = rules.get(r["rule"], 0) + r["n"]
        tiers[r["tier"]] += r["n"]
    return {"findings": sum(rules.values()), "by_confidence": tiers, "by_rule": dict(sorted(rules.items()))}


def _rows(findings: DataFrame) -> list[dict[str, Any]]:
    out = []
    for r in findings.orderBy(F.desc("confidence"), "rule", "path", "id").collect():
        row = {k: r[k] for k in ("rule", "category", "severity", "confidence", "risk", "path", "recommendation", "id")}
        if r["replacement"] is not None:
            row["replacement"] = r["replacement"]
        row["evidence"] = [{"type": e["type"], "value": _value(e["value"])} for e in r["evidence"]]
        row["risks"] = list(r["risks"])
        out.append(row)
    return out


def _value(text: str) -> Any:
    try:
        return json.loads(text)
    except (TypeError, json.JSONDecodeError):
        return text


def as_dict(findings: DataFrame, command: str, root: str = ".", confidence: str = "all", metrics: dict | None = None, base: str | None = None) -> dict[str, Any]:
    rows = _rows(above(findings, confidence))
    out = {"schema_version": 1, "command": command, "root": root, "summary": summary(findings) | {"shown": len(rows)}, "metrics": metrics or {}, "findings": rows}
    return out | ({"base": base} if base else {})


def to_json(findings: DataFrame, command: str, **more) -> str:
    """The same findings give the same bytes."""
    return json.dumps(as_dict(findings, command, **more), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def to_sarif(findings: DataFrame, command: str, confidence: str = "all") -> str:
    rows = _rows(above(findings, confidence))
    rules = sorted({r["rule"] for r in rows})
    results = []
    for r in rows:
        line = next((e["value"] for e in r["evidence"] if e["type"] == "definition_line"), next((e["value"][0] for e in r["evidence"] if e["type"] == "definition_lines"), 1))
        say = f"{r['rule']} ({r['recommendation']})" + (f"; see {r['replacement']}" if "replacement" in r else "")
        results.append({
            "ruleId": r["rule"], "ruleIndex": rules.index(r["rule"]), "level": "warning" if r["severity"] == "warning" else "note", "message": {"text": say},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": line}}}], "partialFingerprints": {"findingId/v1": r["id"]},
            "properties": {"confidence": r["confidence"], "risk": r["risk"], "recommendation": r["recommendation"], "evidence": sorted({e["type"] for e in r["evidence"]})},
        })
    named = [{"id": r, "name": "".join(w.title() for w in r.split("-")), "shortDescription": {"text": r.replace("-", " ")}, "properties": {"tags": ["maintainability"]}} for r in rules]
    run = {"tool": {"driver": {"name": TOOL, "rules": named}}, "results": results, "properties": {"command": command, "summary": summary(findings)}}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def to_text(findings: DataFrame, command: str, confidence: str = "all") -> str:
    rows, counts = _rows(above(findings, confidence)), summary(findings)
    out = [f"{command}: {counts['findings']} findings, {len(rows)} shown ({', '.join(f'{k} {v}' for k, v in counts['by_confidence'].items())})"]
    for r in rows:
        out.append(f"{r['confidence']:.3f} {r['rule']} {r['path']}" + (f" -> {r['replacement']}" if "replacement" in r else "") + f" [{r['recommendation']}, risk {r['risk']:.3f}]")
        out += [f"    {e['type']}: {json.dumps(e['value'], ensure_ascii=False)}" for e in r["evidence"] if not e["type"].endswith("_sha256")]
        out += [f"    risk: {x}" for x in r["risks"]]
    return "\n".join(out) + "\n"


def sarif_summary(text: str, first: int = 10) -> str:
    """Markdown of a SARIF report: counts and the first rows."""
    run = json.loads(text)["runs"][0]
    rows = [f"| {r['level']} | {r['ruleId']} | {r['locations'][0]['physicalLocation']['artifactLocation']['uri']}:{r['locations'][0]['physicalLocation']['region']['startLine']} | {r['properties']['confidence']:.3f} |" for r in run["results"]]
    out = [f"### {run['tool']['driver']['name']}: {len(rows)} findings", ""]
    if rows:
        out += ["| level | rule | place | confidence |", "| --- | --- | --- | --- |", *rows[:first]]
    return "\n".join(out + ([f"\n{len(rows) - first} more"] if len(rows) > first else [])) + "\n"


def exit_code(remaining: DataFrame, fail_on: str | None) -> int:
    """1 if a finding that is not accepted reaches the tier, whatever is shown; else 0."""
    if not fail_on:
        return 0
    return int(bool(remaining.where(F.col("confidence") >= FLOORS[fail_on]).head(1)))
