"""Repository scans: (repo, path, source) tables from a folder, a tree of folders, or a commit."""

from __future__ import annotations

import fnmatch
import os
import subprocess
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import paths

FILES = "repo string, path string, source string"


def git(root: str | Path, *args: str) -> bytes | None:
    """Output of a git command, None where git or the repository is missing or the command fails."""
    try:
        done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, timeout=120, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def _ignore_rules(root: Path) -> list[tuple[bool, str]]:
    try:
        lines = (root / ".gitignore").read_text("utf-8", "replace").splitlines()
    except OSError:
        return []
    return [(not x.startswith("!"), x.lstrip("!").strip("/")) for x in map(str.strip, lines) if x and not x.startswith("#")]


def _left_out(path: str, rules: Sequence[tuple[bool, str]]) -> bool:
    out = False
    for drops, rule in rules:  # the last rule that fits decides
        parts = path.split("/")
        if fnmatch.fnmatch(path, rule) or path.startswith(rule + "/") or "/" not in rule and any(fnmatch.fnmatch(p, rule) for p in parts):
            out = drops
    return out


def list_files(root: str | Path, exclude: Sequence[str] = ()) -> list[str]:
    """Relative paths that git knows or would add, else all not ignored; no links, nothing outside the root, sorted."""
    root = Path(root)
    listed = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    if listed is not None:
        found = [p for p in listed.decode("utf-8", "surrogateescape").split("\0") if p]
    else:
        rules = _ignore_rules(root)
        found = [Path(d, f).relative_to(root).as_posix() for d, _, names in os.walk(root) for f in names]
        found = [p for p in found if not _left_out(p, rules)]
    home, keep = root.resolve(), []
    for p in sorted(set(found)):
        full = root / p
        if full.is_symlink() or not full.is_file() or not full.resolve().is_relative_to(home):
            continue
        if set(p.split("/")[:-1]) & set(paths.IGNORED) or any(fnmatch.fnmatch(p, e) or fnmatch.fnmatch(p, e.removeprefix("**/")) for e in exclude):
            continue
        keep.append(p)
    return keep


def decode(raw: bytes) -> str:
    return raw.decode("utf-8-sig", "replace")


def scan_repository(spark: SparkSession, root: str | Path, repo: str | None = None, exclude: Sequence[str] = (), suffix: str = ".py") -> DataFrame:
    """One working tree, listed on the driver."""
    root = Path(root)
    rows = [(repo or root.resolve().name, p, decode((root / p).read_bytes())) for p in list_files(root, exclude) if p.endswith(suffix)]
    return spark.createDataFrame(rows, FILES)


def scan_tree(spark: SparkSession, base: str, suffix: str = ".py") -> DataFrame:
    """Many checkouts below ``base`` (one folder each) in any store that Spark reads; listed and read by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(base)
    inside = F.regexp_extract("path", r"^[^:]*:?/*" + base.split("://")[-1].strip("/").replace(".", r"\.") + r"/(.*)$", 1)
    rows = raw.select(F.substring_index(inside, "/", 1).alias("repo"), F.regexp_replace(inside, "^[^/]*/", "").alias("path"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("source"))
    return rows.where((F.col("path") != "") & ~paths.ignored(F.col("path")))


def snapshot(spark: SparkSession, root: str | Path, commit: str, repo: str | None = None, suffix: str = ".py") -> DataFrame:
    """The files of a commit."""
    listed = git(root, "ls-tree", "-r", "-z", "--name-only", commit) or b""
    names = [p for p in listed.decode("utf-8", "surrogateescape").split("\0") if p.endswith(suffix)]
    rows = [(repo or Path(root).resolve().name, p, decode(git(root, "show", f"{commit}:{p}") or b"")) for p in names]
    return spark.createDataFrame(rows, FILES)
