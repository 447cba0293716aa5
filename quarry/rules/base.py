"""The findings table, and the tables that all rules of an audit read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import clamp01, content_id
from quarry.functions.storage import materialise
from quarry.operators import graph
from quarry.sources import paths
from quarry.sources.config import Config

EVIDENCE = "array<struct<type:string,value:string>>"
FINDINGS = f"repo string, rule string, category string, severity string, confidence double, risk double, path string, replacement string, evidence {EVIDENCE}, risks array<string>, recommendation string, id string"


def evidence(**values: Column) -> Column:
    """Evidence in the order given; values are JSON text. A null value leaves its entry out."""
    parts = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("type"), v.alias("value"))) for k, v in values.items()]
    return F.array_compact(F.array(*parts))


def js(value: Column | str | bool | int) -> Column:
    """JSON text of a scalar or array column, or of a Python constant."""
    import json

    if not isinstance(value, Column):
        return F.lit(json.dumps(value))
    return F.regexp_extract(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)


def findings(df: DataFrame, rule: str, category: str, severity: Column | str, confidence: Column, risk: Column, proof: Column, risks: Column, recommendation: Column | str, path: str = "path", replacement: Column | None = None) -> DataFrame:
    """Rows of ``df`` as findings: clamped, rounded to 3 digits, evidence and risks in order, with an id made of the content."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    out = df.select(
        "repo", F.lit(rule).alias("rule"), F.lit(category).alias("category"), lit(severity).alias("severity"), F.round(clamp01(confidence), 3).alias("confidence"), F.round(clamp01(risk), 3).alias("risk"),
        F.col(path).alias("path"), (replacement if replacement is not None else F.lit(None).cast("string")).alias("replacement"), F.array_sort(proof).alias("evidence"),
        F.array_sort(F.array_distinct(risks)).alias("risks"), lit(recommendation).alias("recommendation"),
    )
    return out.withColumn("id", content_id(F.col("rule"), F.col("repo"), F.col("path"), F.col("replacement"), F.to_json("evidence")))


@dataclass
class Audit:
    """Tables of one audit, all keyed by repo."""

    config: Config
    facts: DataFrame  # python_facts rows with module, aliases, category, dir, name
    edges: DataFrame  # repo, src, dst (modules)
    reachable: DataFrame  # repo, module
    roots: DataFrame  # repo, module
    changed: DataFrame | None  # repo, path
    migrations: DataFrame | None  # repo, path, removed, added
    births: DataFrame | None  # repo, path, commit, ts, seq
    log: DataFrame | None
    public: DataFrame  # repo, module
    doubts: DataFrame  # repo, kind ('packaging' or 'deployment'), source
    namespaces: DataFrame  # repo, root: folders declared to hold namespace packages
    import_roots: tuple[str, ...] = ()
    parents: DataFrame | None = None  # repo, commit, parent
    replaced: tuple[DataFrame, DataFrame] | None = None  # what stale.replacements found

    @property
    def sources(self) -> DataFrame:
        return self.facts.where("category = 'source' and parse_error is null")

    def with_changed(self, df: DataFrame, path: str = "path", out: str = "changed") -> DataFrame:
        if self.changed is None:
            return df.withColumn(out, F.lit(False))
        marks = self.changed.select("repo", F.col("path").alias(path), F.lit(True).alias(out)).distinct()
        return df.join(marks, ["repo", path], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def with_modules(facts: DataFrame, config: Config, import_roots: Sequence[str] = ()) -> DataFrame:
    """Facts with category, dir, name, module and aliases.

    A file takes its shortest spelling that no file before it in path order has as its first choice, else its full one.
    """
    names = paths.module_names(F.col("path"), [*config.import_roots, *import_roots])
    rows = facts.withColumns({"category": paths.category(F.col("path")), "dir": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "name": F.element_at(F.split("path", "/"), -1), "__names": names})
    first = rows.select("repo", F.explode("__names").alias("module"), "path", F.posexplode("__names").alias("rank", "m")).where("m = module").groupBy("repo", "module").agg(F.min(F.struct("rank", "path")).alias("own"))
    taken = first.select("repo", "module", F.col("own.path").alias("path")).groupBy("repo", "path").agg(F.collect_set("module").alias("__own"))
    rows = rows.join(taken, ["repo", "path"], "left")
    module = F.coalesce(F.element_at(F.filter("__names", lambda n: F.array_contains(F.coalesce(F.col("__own"), F.array().cast("array<string>")), n)), 1), F.element_at("__names", -1))
    return rows.withColumn("module", module).withColumn("aliases", F.col("__names")).drop("__names", "__own")


def module_edges(facts: DataFrame) -> DataFrame:
    """(repo, src, dst): resolved imports and literal dynamic imports."""
    spelled = F.flatten(F.transform("imports", lambda i: F.concat(F.array(i["module"]), F.transform(i["names"], lambda n: F.when(i["module"] == "", n).otherwise(F.concat_ws(".", i["module"], n))))))
    uses = facts.select("repo", F.col("module").alias("src"), F.explode(F.array_distinct(F.concat(spelled, "dynamic_refs"))).alias("spelling")).where("spelling <> ''")
    owners = facts.select("repo", F.explode(F.array_union("aliases", F.array("module"))).alias("alias"), F.col("module").alias("dst"))
    return graph.resolve(uses, owners, "spelling", "alias", "dst", by=["repo"]).select("repo", "src", "dst").distinct()


def module_roots(facts: DataFrame, config: Config, entrypoints: DataFrame) -> DataFrame:
    """(repo, module) that run by themselves. entrypoints: (repo, spelling) from settings, packaging and deployment."""
    own = F.col("main_guard") | (F.size("frameworks") > 0) | F.col("category").isin("test", "script") | F.col("name").isin("__init__.py", "__main__.py") | paths.matches(F.col("path"), config.entrypoint_paths)
    owners = facts.select("repo", F.explode(F.array_union("aliases", F.array("module"))).alias("alias"), F.col("module").alias("dst"))
    named = entrypoints
    if config.entrypoint_modules:
        wanted = F.explode(F.array(*map(F.lit, config.entrypoint_modules)))
        named = named.unionByName(facts.select("repo").distinct().select("repo", wanted.alias("spelling")))
    named = graph.resolve(named.distinct(), owners, "spelling", "alias", "dst", by=["repo"]).select("repo", F.col("dst").alias("module"))
    return facts.where(own).select("repo", "module").unionByName(named).distinct()


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    key = lambda c: F.struct("repo", F.col(c).alias("module"))
    found = graph.reachable(edges.select(key("src").alias("src"), key("dst").alias("dst")), roots.select(key("module").alias("node")))
    return materialise(found.select("node.repo", "node.module"), "reachable")
