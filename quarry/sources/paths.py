"""Paths as columns: module names, categories, ignored folders, deployment files, globs."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.columns import name

# Folders never scanned, and what marks a deployment file.
IGNORED = (".git", ".hg", ".mypy_cache", ".pytest_cache", ".quarry", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "htmlcov", "node_modules", "site-packages", "tmp", "venv")
DEPLOY_NAMES = (
    "app.json", "app.yaml", "app.yml", "compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml", "fly.toml", "heroku.yaml", "heroku.yml", "netlify.toml",
    "procfile", "railway.json", "render.yaml", "render.yml", "serverless.yaml", "serverless.yml", "supervisord.conf", "tox.ini",
)
DEPLOY_FOLDERS = ("deploy", "deployment", "helm", "infra", "k8s", "kubernetes")
CONFIG_ENDS = (".conf", ".ini", ".json", ".toml", ".yaml", ".yml")


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def ignored(path: Column) -> Column:
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, IGNORED)))


def category(path: Column) -> Column:
    """The first that fits: migration, generated, vendor, test, script, source."""
    parts, low = folders(path), F.lower(name(path))

    def has(*names: str) -> Column:
        return F.arrays_overlap(parts, F.array(*map(F.lit, names)))

    return (
        F.when(has("migrations"), "migration")
        .when(has("generated") | low.endswith("_pb2.py"), "generated")
        .when(has("vendor", "site-packages"), "vendor")
        .when(has("tests", "test") | low.startswith("test_") | low.endswith("_test.py"), "test")
        .when(low.isin("conftest.py", "setup.py") | F.lower(path).startswith("scripts/"), "script")
        .otherwise("source")
    )


def module_names(path: Column, roots: Sequence[str] = ()) -> Column:
    """Spellings under which a file can be imported: without each import root (longest first), then in full."""
    full = F.regexp_replace(F.regexp_replace(path, "\\.py$", ""), "(^|/)__init__$", "")
    known = sorted({"src", "lib", *(r.strip("/") for r in roots if r.strip("/"))}, key=lambda r: (-r.count("/"), r))
    short = [F.when(full.startswith(r + "/"), F.substring(full, len(r) + 2, 10_000)) for r in known]
    spelled = F.transform(F.array_compact(F.array(*short, full)), lambda m: F.replace(m, F.lit("/"), F.lit(".")))
    names = F.array_distinct(F.filter(spelled, lambda m: m != ""))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("")))


def deployment_file(path: Column) -> Column:
    low, base = F.lower(path), F.lower(name(path))
    config = F.lit(False)
    for end in CONFIG_ENDS:
        config = config | base.endswith(end)
    folder = F.arrays_overlap(folders(low), F.array(*map(F.lit, DEPLOY_FOLDERS)))
    return (
        (base == "dockerfile") | base.startswith("dockerfile.") | base.isin(*DEPLOY_NAMES) | base.startswith("docker-compose.") | base.endswith(".service")
        | low.rlike("^\\.github/workflows/.*\\.ya?ml$") | (folder & config)
    )


def glob_regex(patterns: Sequence[str]) -> str | None:
    """One regular expression for any of the globs: full paths, path tails, and **/ with nothing before it."""
    out = set()
    for p in patterns:
        p = p.replace("\\", "/").removeprefix("./")
        body = fnmatch.translate(p).removeprefix("(?s:").rsplit(")", 1)[0]
        out.add(f"(?s:^{body}$)")
        if "/" not in p or not p.startswith("/"):
            tail = re.sub(r"\.\*", "[^/]*", body)
            out.add(f"(?s:(^|/){tail}$)")
        if p.startswith("**/"):
            out.add(f"(?s:^{fnmatch.translate(p[3:]).removeprefix('(?s:').rsplit(')', 1)[0]}$)")
    return "|".join(sorted(out)) or None


def matches(path: Column, patterns: Sequence[str]) -> Column:
    regex = glob_regex(patterns)
    return path.rlike(regex) if regex else F.lit(False)
