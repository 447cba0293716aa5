"""Unused helpers and duplicate implementations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.rules.base import Audit, evidence, findings, js

LEAST_NODES, LEAST_LINES = 12, 4
OTHER_NAME_NODES, OTHER_NAME_LINES = 30, 8


def symbols(facts: DataFrame) -> DataFrame:
    """(repo, path, module, exported, symbol columns) of each top-level definition."""
    return facts.select("repo", "path", "module", "category", "exported", F.explode("symbols").alias("s")).select("repo", "path", "module", "category", "exported", "s.*")


def references(audit: Audit) -> tuple[DataFrame, DataFrame]:
    """((repo, module, name, user) of each symbol's use, (repo, module) imported with a wildcard).

    Uses are reads in the own file, imported names, attributes of imported modules, and strings equal to a
    symbol's name (which count for every module that has such a symbol).
    """
    facts = audit.facts.where("parse_error is null")
    known = symbols(audit.facts).select("repo", "module", "name").distinct()
    owners = audit.facts.select("repo", F.explode(F.array_union("aliases", F.array("module"))).alias("alias"), F.col("module").alias("target"))

    def resolved(rows: DataFrame) -> DataFrame:
        return graph.resolve(rows, owners, "spelling", "alias", "target", by=["repo"])

    local = facts.select("repo", "module", F.explode("local_uses").alias("name"), F.col("path").alias("user"))
    taken = facts.select("repo", F.col("path").alias("user"), F.explode("imports").alias("i")).select("repo", "user", F.col("i.module").alias("spelling"), F.explode("i.names").alias("name"))
    taken = resolved(taken.where("spelling <> ''")).select("repo", F.col("target").alias("module"), "name", "user")
    bound = resolved(facts.select("repo", F.col("path").alias("user"), F.explode("bindings").alias("b")).select("repo", "user", F.col("b.name").alias("prefix"), F.col("b.module").alias("spelling")))
    parts = F.split("chain", "\\.")
    chains = facts.select("repo", F.col("path").alias("user"), F.explode("attributes").alias("chain"))
    # each proper prefix of a chain with the name that follows it
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("prefix"), F.get(parts, n).alias("name")))
    steps = chains.select("repo", "user", F.explode(cuts).alias("c")).select("repo", "user", "c.*")
    through = steps.join(bound, ["repo", "user", "prefix"]).select("repo", F.col("target").alias("module"), "name", "user")
    texts = facts.select("repo", F.col("path").alias("user"), F.explode("string_constants").alias("name")).join(known, ["repo", "name"]).select("repo", "module", "name", "user")
    wild = taken.where("name = '*'").select("repo", "module").distinct()
    uses = local.unionByName(taken).unionByName(through).join(known, ["repo", "module", "name"], "left_semi").unionByName(texts)
    return uses.distinct(), wild


def unused_helpers(audit: Audit, uses: DataFrame, wild: DataFrame) -> DataFrame:
    own = symbols(audit.sources.join(audit.reachable, ["repo", "module"], "left_semi")).where("not decorated and not startswith(name, '__') and not array_contains(exported, name)")
    own = own.join(uses.select("repo", "module", "name").distinct(), ["repo", "module", "name"], "left_anti").join(wild, ["repo", "module"], "left_anti")
    rows = audit.with_changed(own).where("changed or private")
    private = F.col("private")
    conf = F.when(F.col("changed") & private, 0.78).when(private, 0.68).otherwise(0.62)
    why = F.array_compact(F.array(F.lit("dynamic_or_external_symbol_use_may_be_unknown"), F.when(~private, "public_symbol_may_be_external_api")))
    proof = evidence(symbol=js(F.col("name")), symbol_kind=js(F.col("kind")), definition_line=js(F.col("first")), static_reference_files=js([]), changed_in_iteration=js(F.col("changed")), private_symbol=js(private))
    return findings(rows, "orphan-helper", "repo-gc", "info", conf, F.when(private, 0.42).otherwise(0.78), proof, why, "review_only")


def _lines(p: str = "") -> Column:
    return F.col(f"{p}last") - F.col(f"{p}first") + 1


def duplicates(audit: Audit, uses: DataFrame) -> DataFrame:
    """Functions with the same shape in several files; the most used, reachable, unchanged, first one is canonical."""
    own = symbols(audit.sources).where(f"kind = 'function' and not decorated and not startswith(name, '__') and nodes >= {LEAST_NODES} and last - first + 1 >= {LEAST_LINES}")
    count = uses.groupBy("repo", "module", "name").agg(F.countDistinct("user").alias("users"))
    live = audit.reachable.withColumn("live", F.lit(True))
    rows = audit.with_changed(own.join(count, ["repo", "module", "name"], "left").join(live, ["repo", "module"], "left"))
    rank = F.struct((-F.coalesce("users", F.lit(0))).alias("a"), F.coalesce(~F.col("live"), F.lit(True)).alias("b"), F.col("changed").alias("c"), F.col("path").alias("d"), F.col("first").alias("e"), "name", "last", "nodes", "private")
    key = ["repo", "body", "params"]
    rows = rows.withColumn("rank", rank)
    first = rows.groupBy(*key).agg(F.min("rank").alias("m"), F.countDistinct("path").alias("files"))
    rest = rows.join(first.where("files >= 2"), key).where("rank <> m")
    canon = {"k_path": "m.d", "k_first": "m.e", "k_name": "m.name", "k_last": "m.last", "k_nodes": "m.nodes", "k_private": "m.private", "k_changed": "m.c"}
    rest = rest.withColumns({k: F.col(v) for k, v in canon.items()}).withColumn("same_name", F.ltrim(F.col("name"), F.lit("_")) == F.ltrim(F.col("k_name"), F.lit("_")))
    rest = rest.where(F.col("same_name") | ((F.least(_lines(), _lines("k_")) >= OTHER_NAME_LINES) & (F.least("nodes", "k_nodes") >= OTHER_NAME_NODES)))
    rest = rest.withColumn("related", F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(F.col("changed"), F.col("path")), F.when(F.col("k_changed"), F.col("k_path")))))))
    if audit.changed is not None:  # where nothing changed at all, nothing is left out
        any_change = audit.changed.select(F.col("repo").alias("repo")).distinct().withColumn("__any", F.lit(True))
        rest = rest.join(any_change, "repo", "left").where(F.col("__any").isNull() | (F.size("related") > 0))
    proof = evidence(
        duplicate_symbol=js(F.col("name")), canonical_symbol=js(F.col("k_name")), normalized_ast_sha256=js(F.col("body")), definition_lines=js(F.array("first", "last")),
        related_changed_paths=js(F.col("related")), exact_normalized_ast_match=js(True), same_symbol_name=js(F.col("same_name")),
    )
    why = F.array(F.lit("equivalent_code_can_serve_different_domain_contracts"), F.lit("public_callers_may_exist_outside_repository"))
    return findings(rest, "duplicate-implementation", "repo-gc", "warning", F.lit(0.88), F.when(~F.col("private") | ~F.col("k_private"), 0.78).otherwise(0.55), proof, why, "consolidation_review", "path", F.col("k_path"))


def without_duplicated(orphans: DataFrame, dups: DataFrame) -> DataFrame:
    """Unused helpers that are reported as duplicates already are left out."""
    value = lambda kind: F.element_at(F.filter("evidence", lambda e: e["type"] == kind), 1)["value"]
    return orphans.withColumn("__s", value("symbol")).join(dups.select("repo", "path", value("duplicate_symbol").alias("__s")).distinct(), ["repo", "path", "__s"], "left_anti").select(*orphans.columns)


