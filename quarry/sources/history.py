"""Change history as tables: commits, files touched, births, import migrations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.files import git

COMMITS = "repo string, seq int, commit string, ts long, path string, status string"
PARENTS = "repo string, commit string, parent string"


def read_log(spark: SparkSession, root: str | Path, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """(repo, seq, commit, ts, path, status): newest commit first (seq 0)."""
    out = git(root, "log", "--no-renames", "--name-status", "--format=%x01%H%x02%ct", *([f"-{limit}"] if limit else [])) or b""
    rows = []
    for seq, entry in enumerate(out.decode("utf-8", "replace").split("\x01")[1:]):
        head, *lines = entry.strip().split("\n")
        commit, ts = head.split("\x02")
        rows += [(repo or Path(root).resolve().name, seq, commit, int(ts), path, status[0]) for line in lines if "\t" in line for status, path in [line.split("\t", 1)]]
    return spark.createDataFrame(rows, COMMITS)


def read_parents(spark: SparkSession, root: str | Path, repo: str | None = None) -> DataFrame:
    """(repo, commit, parent): one row for each parent of each commit that HEAD descends from."""
    listed = (git(root, "rev-list", "--parents", "HEAD") or b"").decode().splitlines()
    name = repo or Path(root).resolve().name
    return spark.createDataFrame([(name, commit, p) for commit, *parents in map(str.split, listed) for p in parents], PARENTS)


def resolve(root: str | Path, value: str) -> str:
    """The commit that a reference names, else the last one of HEAD's history before a date."""
    for args in (("rev-parse", "--verify", "--quiet", f"{value}^{{commit}}"), ("rev-list", "-1", f"--before={value}", "HEAD")):
        if found := (git(root, *args) or b"").decode().split():
            return found[0]
    raise ValueError(f"neither a commit nor a date with a commit before it: {value}")


def births(log: DataFrame) -> DataFrame:
    """(repo, path, commit, ts, seq) of the latest commit that added each path."""
    first = F.min_by(F.struct("commit", "ts", "seq"), "seq").alias("b")
    return log.where("status = 'A'").groupBy("repo", "path").agg(first).select("repo", "path", "b.commit", "b.ts", "b.seq")


def changed_paths(spark: SparkSession, root: str | Path, base: str, repo: str | None = None) -> DataFrame:
    """(repo, path): committed since the base, changed in the work tree, and untracked."""
    listed = [git(root, "diff", "--name-only", "-z", f"{base}...HEAD"), git(root, "diff", "--name-only", "-z", "HEAD"), git(root, "ls-files", "-z", "--others", "--exclude-standard")]
    if listed[0] is None:
        raise ValueError(f"not a commit to compare with: {base}")
    found = {p for raw in listed if raw for p in raw.decode("utf-8", "replace").split("\0") if p}
    return spark.createDataFrame([(repo or Path(root).resolve().name, p) for p in sorted(found)], "repo string, path string")


def import_migrations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, removed, added): import targets that a changed file lost and gained.

    Both sides are fact tables (repo, path, imports); a missing side has no imports.
    """

    def targets(df: DataFrame, out: str) -> DataFrame:
        flat = F.flatten(F.transform("imports", lambda i: F.concat(F.array(i["module"]), F.transform(F.filter(i["names"], lambda n: n != "*"), lambda n: F.concat_ws(".", i["module"], n)))))
        return df.select("repo", "path", F.array_sort(F.array_distinct(F.filter(flat, lambda m: m != ""))).alias(out))

    none = F.array().cast("array<string>")
    both = targets(before, "b").join(targets(after, "a"), ["repo", "path"], "full")
    both = both.select("repo", "path", F.coalesce("b", none).alias("b"), F.coalesce("a", none).alias("a"))
    out = both.select("repo", "path", F.array_except("b", "a").alias("removed"), F.array_except("a", "b").alias("added"))
    return out.where((F.size("removed") > 0) | (F.size("added") > 0))


def coupling(log: DataFrame, last: int = 100) -> DataFrame:
    """(a, b, pair_count, affinity) of files changed together in the last commits."""
    from quarry.operators.grouping import cochange

    rows = log.where(F.col("seq") < last).where(F.col("path").endswith(".py"))
    rows = rows.select(F.concat_ws("\x1f", "repo", "commit").alias("event"), F.concat_ws("\x1f", "repo", "path").alias("item"))
    pairs = cochange(rows, "event", "item")
    parts = {c: F.split(c, "\x1f") for c in ("a", "b")}
    return pairs.select(parts["a"][0].alias("repo"), parts["a"][1].alias("a"), parts["b"][1].alias("b"), "pair_count", "affinity")
