"""Graph operators: alias resolution and reachability."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import prefixes
from quarry.functions.storage import materialise


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", max_rounds: int = 1000) -> DataFrame:
    """(node): all nodes reachable from the roots, roots included; cycles are no matter.

    One join a round with the newly reached nodes only; each round writes those alone to the shared folder.
    """
    seen = materialise(roots.select(F.col(node).alias("node")).where("node is not null").distinct(), "reached")
    frontier = seen
    for _ in range(max_rounds):
        step = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).join(frontier, "node").select(F.col("next").alias("node")).distinct()
        frontier = materialise(step.join(seen, "node", "left_anti"), "frontier")
        if not frontier.head(1):
            return seen.withColumnRenamed("node", node)
        seen = seen.unionByName(frontier)
    raise RuntimeError("reachability did not settle")


def resolve(spellings: DataFrame, aliases: DataFrame, spelling: str, alias: str, owner: str, sep: str = ".", by: Sequence[str] = ()) -> DataFrame:
    """``spellings`` with each owner of its longest known dotted prefix; ambiguous prefixes keep every owner.

    Prefixes are exploded and joined by equality (within ``by``), never by startswith.
    """
    rows = spellings.withColumn("__p", F.explode(prefixes(F.col(spelling), sep)))
    known = rows.join(aliases.select(*by, F.col(alias).alias("__p"), F.col(owner)).distinct(), [*by, "__p"])
    best = F.max(F.length("__p")).over(Window.partitionBy(*[F.col(c) for c in spellings.columns]))
    return known.withColumn("__best", best).where(F.length("__p") == F.col("__best")).select(*spellings.columns, owner).distinct()


def descends(pairs: DataFrame, parents: DataFrame, by: str = "repo") -> DataFrame:
    """The distinct pairs (by, earlier, later) whose later commit descends from the earlier one; none descends from itself.

    pairs: (by, earlier, later), nulls descend from nothing; parents: (by, commit, parent). One group is the commits of
    one repository, as one process of git holds them; each later commit is walked from once for all its pairs.
    """

    def walk(left, right):
        above = {}
        for commit, parent in zip(right["commit"], right["parent"], strict=True):
            above.setdefault(commit, []).append(parent)
        keep = []
        for later, rows in left.groupby("later"):
            wanted, seen, todo = set(rows["earlier"]), set(), list(above.get(later, ()))
            while todo and not wanted <= seen:
                commit = todo.pop()
                if commit not in seen:
                    seen.add(commit)
                    todo += above.get(commit, ())
            keep.append(rows[rows["earlier"].isin(seen)])
        return pd.concat(keep) if keep else left

    asked = pairs.select(by, "earlier", "later").where("earlier is not null and later is not null and earlier <> later").distinct()
    known = parents.select(by, "commit", "parent").join(asked.select(by).distinct(), by, "left_semi")
    return asked.groupBy(by).cogroup(known.groupBy(by)).applyInPandas(walk, f"{by} string, earlier string, later string")
