"""Superseded files and unreachable new files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import ancestors, family, jaccard, prefixes, stem
from quarry.functions.scores import recommendation, stale_confidence
from quarry.functions.storage import materialise
from quarry.operators.graph import descends
from quarry.operators.matching import similar_size
from quarry.operators.sequences import ratios
from quarry.rules.base import Audit, evidence, findings, js
from quarry.sources import paths

#: Symbol names that say nothing about a file.
COMMON = ("create", "get", "handle", "load", "main", "parse", "process", "run", "save", "set", "update")
FAMILY_BONUS, LEAST_STRUCTURE = 0.08, 0.55


def _informative(symbols: Column) -> Column:
    return F.array_except(symbols, F.array(*map(F.lit, COMMON)))


def _side(df: DataFrame, p: str) -> DataFrame:
    keep = ("path", "module", "aliases", "dir", "n_chars", "symbol_names", "structure", "tokens", "surface", "sha256", "fam")
    return df.select("repo", *[F.col(c).alias(f"{p}_{c}") for c in keep])


def replacements(audit: Audit) -> tuple[DataFrame, DataFrame]:
    """(best replacement of each unreachable source, unreachable sources).

    Files meet only through their family name or through two informative symbols of the same folder. Both rules of
    this module read the result, so it is stored and made once an audit.
    """
    if audit.replaced is not None:
        return audit.replaced
    files = audit.sources.withColumn("fam", family(stem(F.col("path"))))
    dead = files.join(audit.reachable, ["repo", "module"], "left_anti")
    live = files.join(audit.reachable, ["repo", "module"], "left_semi")
    by_name = dead.select("repo", "fam", F.col("module").alias("c_module")).join(live.select("repo", "fam", F.col("module").alias("r_module")), ["repo", "fam"]).select("repo", "c_module", "r_module")
    index = lambda df, m: df.select("repo", "dir", F.explode(_informative(F.col("symbol_names"))).alias("symbol"), F.col("module").alias(m))
    by_symbol = index(dead, "c_module").join(index(live, "r_module"), ["repo", "dir", "symbol"]).groupBy("repo", "c_module", "r_module").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    pairs = by_name.unionByName(by_symbol).distinct().join(_side(dead, "c"), ["repo", "c_module"]).join(_side(live, "r"), ["repo", "r_module"])
    shared = F.size(F.array_intersect(_informative(F.col("c_symbol_names")), _informative(F.col("r_symbol_names"))))
    union = F.size(F.array_union("c_symbol_names", "r_symbol_names"))
    same = F.col("c_fam") == F.col("r_fam")
    overlap = (F.col("c_dir") == F.col("r_dir")) & (shared >= 2) & (F.coalesce(shared / F.nullif(union, F.lit(0)), F.lit(0.0)) >= 0.4)
    pairs = pairs.withColumn("same_family", same).where(similar_size(F.col("c_n_chars"), F.col("r_n_chars")) & (same | overlap))
    # sequence ratios run in Python, on the pairs that are left
    scored = ratios(ratios(pairs, "c_structure", "r_structure", "ast"), "c_tokens", "r_tokens", "lexical").withColumn("symbols", jaccard(F.col("c_symbol_names"), F.col("r_symbol_names")))
    scored = scored.withColumn("overall", 0.5 * F.col("ast") + 0.25 * F.col("lexical") + 0.25 * F.col("symbols"))
    fit = scored.where((F.col("overall") >= audit.config.min_similarity - F.when(F.col("same_family"), FAMILY_BONUS).otherwise(0.0)) & (F.col("ast") >= LEAST_STRUCTURE))
    # ties go to the first module
    first = fit.groupBy("repo", "c_module").agg(F.min(F.struct((-F.col("overall")).alias("neg"), "r_module")).alias("m"))
    best = fit.join(first.select("repo", "c_module", F.col("m.r_module").alias("r_module")), ["repo", "c_module", "r_module"])
    audit.replaced = materialise(best, "replacements"), dead
    return audit.replaced


def package_marks(audit: Audit, df: DataFrame) -> DataFrame:
    """(repo, path, __in_package, __namespace) of the rows of ``df``, by joins on the folders above each file.

    A file is in a package if any folder above it holds an ``__init__.py``. It may belong to a namespace package if it
    lies in a folder of a declared namespace root, or if the folders above it (without a leading import root) are all
    identifiers and one of them holds no ``__init__.py``.
    """
    packages = audit.facts.where("name = '__init__.py'").select("repo", F.col("dir").alias("__dir")).distinct().withColumn("__is", F.lit(1))
    up = df.select("repo", "path").distinct().withColumn("__up", ancestors(F.col("path")))
    each = up.select("repo", "path", F.explode("__up").alias("__dir")).join(packages, ["repo", "__dir"], "left")
    parts = F.split("path", "/")
    lead = F.when(parts[0].isin("src", "lib", *audit.import_roots), 1).otherwise(0)
    inner = F.slice(parts, lead + 1, F.greatest(F.size(parts) - 1 - lead, F.lit(0)))
    depth = F.when(F.col("__dir") == "", 0).otherwise(F.size(F.split("__dir", "/")))
    counted = each.groupBy("repo", "path").agg(F.count("__is").alias("__packages"), F.count_if(F.col("__is").isNotNull() & (depth > lead)).alias("__inner"))
    implied = (F.size(inner) > 0) & F.forall(inner, lambda p: p.rlike("^[\\p{L}_][\\p{L}\\p{N}_]*$")) & (F.col("__inner") < F.size(inner))
    roots = audit.namespaces.select("repo", F.col("root").alias("__dir")).distinct()
    below = F.size(parts) - F.when(F.col("__dir") == "", 0).otherwise(F.size(F.split("__dir", "/")))
    declared = up.select("repo", "path", F.explode("__up").alias("__dir")).where(below >= 2).join(roots, ["repo", "__dir"], "left_semi").select("repo", "path").distinct().withColumn("__declared", F.lit(True))
    out = counted.join(declared, ["repo", "path"], "left")
    return out.select("repo", "path", (F.col("__packages") > 0).alias("__in_package"), (F.col("__declared").isNotNull() | implied).alias("__namespace"))


def risks(audit: Audit, df: DataFrame) -> DataFrame:
    """``df`` (rows of facts) with risk and risks: what speaks against deleting a file."""
    cfg, facts = audit.config, audit.facts
    users = lambda rows, kind: rows.groupBy("repo", "module").agg(F.array_sort(F.collect_set("user")).alias(kind))

    def referenced(refs: str, kind: str) -> DataFrame:
        """Files that name a module, in full or as a prefix."""
        used = facts.select("repo", F.col("path").alias("user"), F.explode(refs).alias("ref")).select("repo", "user", F.explode(prefixes(F.col("ref"))).alias("alias"))
        owned = facts.select("repo", "module", F.explode(F.array_union("aliases", F.array("module"))).alias("alias"))
        return users(used.join(owned, ["repo", "alias"]), kind)

    # each row meets the counts and the first three names of its repository only
    three = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, 3)
    broken, opaque = F.col("parse_error").isNotNull(), F.coalesce("opaque", F.lit(False))
    per_repo = facts.groupBy("repo").agg(three(F.when(broken, F.col("path"))).alias("__broken"), F.count_if(broken).alias("__n_broken"), three(F.when(opaque, F.col("path"))).alias("__opaque"))
    doubts = audit.doubts.groupBy("repo").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("source")))).alias(f"__{k}") for k in ("packaging", "deployment")])
    public = audit.public.select("repo", F.col("module").alias("__m")).distinct()
    public = df.select("repo", "path", F.explode(F.array_union("aliases", F.array("module"))).alias("__m")).join(public, ["repo", "__m"], "left_semi").select("repo", "path").distinct().withColumn("__public", F.lit(True))
    rows = df.join(per_repo, "repo", "left").join(doubts, "repo", "left").join(public, ["repo", "path"], "left").join(package_marks(audit, df), ["repo", "path"], "left")
    rows = rows.join(referenced("dynamic_refs", "__dynamic"), ["repo", "module"], "left").join(referenced("string_refs", "__strings"), ["repo", "module"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("__broken", "__opaque", "__packaging", "__deployment", "__dynamic", "__strings")})
    some = lambda c: F.size(c) > 0
    first = lambda c: F.array_join(F.slice(c, 1, 3), ",")
    packaged = F.coalesce("__public", F.lit(False))
    in_package = F.coalesce(F.col("__in_package") | F.col("__namespace"), F.lit(False)) & F.lit(not cfg.allow_delete_package_modules)
    external = ~packaged & ~F.col("declares_api") & in_package
    under_src = ~some("__deployment") & F.col("path").startswith("src/") & F.lit(not cfg.allow_delete_src)
    data_only = some("public_assignments") & ~some("symbols")
    kind = F.col("category").isin("generated", "migration", "vendor")
    protected = paths.matches(F.col("path"), cfg.protected)
    when = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    risk = F.greatest(
        when(some("__broken") | protected | kind | packaged | some("__packaging") | some("__deployment") | some("__opaque"), 1.0),
        when(some("__dynamic") | some("__strings"), 0.75), when(data_only, 0.55), when(~packaged & F.col("declares_api") | external, 0.45), when(under_src, 0.25),
    )
    why = F.array_compact(F.array(
        F.when(some("__broken"), F.concat(F.lit("repository_parse_errors:"), F.col("__n_broken").cast("string"), F.lit(":"), first("__broken"))),
        F.when(protected, "protected_path"), F.when(kind, F.col("category")), F.when(packaged, "packaged_public_module"), F.when(~packaged & F.col("declares_api"), "public_api_or_package_init"),
        F.when(external | under_src, "possible_external_package_module"), F.when(some("__packaging"), F.concat(F.lit("packaging_entrypoint_uncertainty:"), first("__packaging"))),
        F.when(some("__deployment"), F.concat(F.lit("deployment_runtime_uncertainty:"), first("__deployment"))), F.when(data_only, "data_or_config_module_requires_literal_review"),
        F.when(some("__opaque"), F.concat(F.lit("opaque_dynamic_module_discovery:"), first("__opaque"))), F.when(some("__dynamic"), F.concat(F.lit("dynamic_reference:"), first("__dynamic"))),
        F.when(some("__strings"), F.concat(F.lit("module_shaped_string:"), first("__strings"))),
    ))
    return rows.withColumns({"risk": risk, "risks": why}).select(*df.columns, "risk", "risks")


def call_sites(audit: Audit, best: DataFrame) -> DataFrame:
    """(repo, c_module, call_site): the first changed file that dropped the candidate and took up its replacement."""
    if audit.migrations is None:
        return best.select("repo", "c_module", F.lit(None).cast("string").alias("call_site"))
    taken = F.array_distinct(F.flatten(F.transform("added", lambda m: prefixes(m))))
    moves = audit.migrations.withColumn("c_name", F.explode("removed")).withColumn("r_name", F.explode(taken)).select("repo", F.col("path").alias("at"), "c_name", "r_name")
    named = best.select("repo", "c_module", F.explode("c_aliases").alias("c_name"), F.col("r_aliases")).withColumn("r_name", F.explode("r_aliases"))
    return named.join(moves, ["repo", "c_name", "r_name"]).groupBy("repo", "c_module").agg(F.min("at").alias("call_site"))


def stale_files(audit: Audit) -> DataFrame:
    best, dead = replacements(audit)
    scored = risks(audit, dead).select("repo", F.col("module").alias("c_module"), "risk", "risks")
    inbound = audit.edges.groupBy("repo", F.col("dst").alias("c_module")).agg(F.countDistinct("src").alias("inbound"))
    rows = best.join(scored, ["repo", "c_module"]).join(inbound, ["repo", "c_module"], "left").join(call_sites(audit, best), ["repo", "c_module"], "left")
    rows = audit.with_changed(rows, "c_path").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    if audit.births is not None:
        born = lambda p: audit.births.select("repo", F.col("path").alias(f"{p}_path"), F.col("commit").alias(f"{p}_commit"), F.col("seq").alias(f"{p}_seq"), F.col("ts").alias(f"{p}_ts"))
        rows = rows.join(born("c"), ["repo", "c_path"], "left").join(born("r"), ["repo", "r_path"], "left")
        if audit.parents is not None:
            # later means descended from; commits of two branches are in no order
            pairs = rows.select("repo", F.col("c_commit").alias("earlier"), F.col("r_commit").alias("later"))
            after = descends(pairs, audit.parents).select("repo", F.col("earlier").alias("c_commit"), F.col("later").alias("r_commit"), F.lit(True).alias("__after"))
            rows = rows.join(after, ["repo", "c_commit", "r_commit"], "left")
            newer = F.coalesce("__after", F.lit(False))
        else:
            # in one line of commits the later one has the smaller seq; the same commit is not later
            newer = F.coalesce((F.col("c_commit") != F.col("r_commit")) & (F.col("r_seq") < F.col("c_seq")), F.lit(False))
    else:
        newer = F.lit(False)
    moved = F.col("call_site").isNotNull()
    history = moved | newer
    missing = F.array_sort(F.array_except("c_symbol_names", "r_symbol_names"))
    lost = F.array_sort(F.array_except(F.map_keys("c_surface"), F.map_keys("r_surface")))
    changed_names = F.array_sort(F.filter(F.map_keys("c_surface"), lambda k: F.col("r_surface")[k].isNotNull() & (F.col("r_surface")[k] != F.col("c_surface")[k])))
    rows = rows.withColumns({"newer": newer, "history": history, "missing": missing, "lost": lost, "contract": changed_names})
    some = lambda c: F.size(c) > 0
    when = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    risk = F.greatest("risk", when(F.col("changed"), 0.75), when(some("lost"), 0.65), when(some("missing") | some("contract"), 0.55))
    why = F.concat("risks", F.array_compact(F.array(
        F.when(F.col("changed"), "candidate_changed_in_iteration"), F.when(some("missing"), "replacement_missing_symbols"),
        F.when(some("lost"), "replacement_missing_public_surface"), F.when(some("contract"), "replacement_changed_public_contract"),
    )))
    conf = stale_confidence(F.col("overall"), F.col("ast"), F.col("symbols"), F.lit(True), F.col("newer"), moved, F.col("history"), F.col("inbound"), F.col("same_family"))
    rows = rows.withColumns({"__risk": risk, "__conf": conf})
    num = lambda c: js(F.round(c, 3))
    proof = evidence(
        unreachable_from_entrypoints=js(True), inbound_imports=js(F.col("inbound")), ast_similarity=num("ast"), token_similarity=num("lexical"), symbol_overlap=num("symbols"),
        replacement_reachable=js(True), replacement_newer=js(F.col("newer")), iteration_naming=F.when(F.col("same_family"), js(True)), symbols_missing_from_replacement=F.when(some("missing"), js(F.col("missing"))),
        public_surface_missing_from_replacement=F.when(some("lost"), js(F.col("lost"))), public_contract_changed_in_replacement=F.when(some("contract"), js(F.col("contract"))),
        call_site_migration=F.when(moved, js(F.col("call_site"))), git_chronology=F.when(~moved & F.col("history"), js(True)),
        candidate_sha256=js(F.col("c_sha256")), replacement_sha256=js(F.col("r_sha256")),
    )
    return findings(rows, "stale-file", "repo-gc", F.when(F.col("__conf") >= 0.85, "warning").otherwise("info"), F.col("__conf"), F.col("__risk"), proof, why, recommendation(F.col("__conf"), F.col("__risk")), "c_path", F.col("r_path"))


def orphan_files(audit: Audit) -> DataFrame:
    """Changed, unreachable, never imported, without a replacement."""
    best, dead = replacements(audit)
    alone = dead.join(best.select("repo", F.col("c_module").alias("module")), ["repo", "module"], "left_anti")
    used = audit.edges.select("repo", F.col("dst").alias("module")).distinct()
    new = audit.with_changed(alone.join(used, ["repo", "module"], "left_anti")).where("changed and name <> '__init__.py'")
    rows = risks(audit, new)
    proof = evidence(unreachable_from_entrypoints=js(True), inbound_imports=js(0), changed_in_iteration=js(True), replacement_candidate=js(False))
    return findings(rows, "orphan-file", "repo-gc", "info", F.lit(0.68), F.greatest(F.lit(0.35), F.col("risk")), proof, F.concat("risks", F.array(F.lit("framework_or_dynamic_entrypoint_may_be_unknown"))), "review_only")
