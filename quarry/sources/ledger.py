"""The ledger of accepted findings: strict JSON in, sorted JSON out."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LARGEST = 4 * 1024 * 1024
ID = re.compile(r"[a-z][a-z-]*:[0-9a-f]{12}")
KEYS = {"id", "rule", "path", "note"}
SCHEMA = "id string, rule string, path string, note string"


class LedgerError(ValueError):
    pass


def parse(text: str) -> list[dict[str, str]]:
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise LedgerError(f"not JSON: {e}") from e
    if not isinstance(raw, dict) or raw.get("schema_version") != 1 or not isinstance(raw.get("accepted"), list):
        raise LedgerError("a ledger holds schema_version 1 and a list named accepted")
    seen: set[str] = set()
    for entry in raw["accepted"]:
        if not isinstance(entry, dict) or not {"id", "rule", "path"} <= set(entry) <= KEYS or not all(isinstance(v, str) for v in entry.values()):
            raise LedgerError("an entry holds id, rule, path and maybe note, all text")
        if not ID.fullmatch(entry["id"]) or entry["id"].split(":")[0] != entry["rule"]:
            raise LedgerError(f"bad id: {entry['id']}")
        if entry["id"] in seen:
            raise LedgerError(f"twice: {entry['id']}")
        seen.add(entry["id"])
    return sorted(({"note": "", **e} for e in raw["accepted"]), key=lambda e: e["id"])


def load(spark: SparkSession, path: str | Path) -> DataFrame:
    path = Path(path)
    if path.stat().st_size > LARGEST:
        raise LedgerError("larger than 4 MiB")
    return spark.createDataFrame([tuple(e[k] for k in ("id", "rule", "path", "note")) for e in parse(path.read_text("utf-8"))], SCHEMA)


def build(findings: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Entries for the findings; notes are carried over, entries without a finding go."""
    rows = findings.select("id", "rule", "path").distinct()
    if previous is None:
        return rows.selectExpr("id", "rule", "path", "'' as note").orderBy("id")
    return rows.join(previous.select("id", "note"), "id", "left").selectExpr("id", "rule", "path", "coalesce(note, '') as note").orderBy("id")


def dump(entries: Sequence) -> str:
    return json.dumps({"schema_version": 1, "accepted": [{k: e[k] for k in ("id", "rule", "path", "note") if k != "note" or e[k]} for e in entries]}, indent=2, ensure_ascii=False) + "\n"
