"""Overloaded folders: pair affinities, clusters, structural pressure and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import jaccard
from quarry.operators.clusters import average_link
from quarry.operators.grouping import label_scores
from quarry.operators.stats import weighted_mean
from quarry.rules.base import Audit, findings, js

# Module names without a topic, and words that name none.
GENERIC = ("base", "common", "core", "helper", "helpers", "manager", "service", "services", "util", "utils")
STOP = (*GENERIC, "add", "build", "create", "delete", "find", "get", "handle", "load", "main", "parse", "process", "remove", "run", "save", "set", "update")
SIGNALS = ("import", "vocabulary", "cochange")
#: Fixed value: weight of joint commits in an affinity.
COCHANGE = 0.35


def _words(column):
    return F.array_except(column, F.array(*map(F.lit, STOP)))


def affinities(audit: Audit, coupling: DataFrame | None = None) -> DataFrame:
    """(repo, dir, a, b, import, vocabulary, cochange, affinity) of the pairs of modules of a folder.

    All pairs of a folder meet: the operator's subject is one folder's direct modules.
    """
    roots = audit.roots.select("repo", "module", F.lit(True).alias("root"))
    own = audit.sources.join(roots, ["repo", "module"], "left").select("repo", "dir", "module", "path", _words(F.col("vocabulary")).alias("words"), F.coalesce("root", F.lit(False)).alias("root"))
    side = lambda p: own.select("repo", "dir", *[F.col(c).alias(f"{p}_{c}") for c in ("module", "path", "words", "root")])
    pairs = side("a").join(side("b"), ["repo", "dir"]).where("a_module < b_module")
    ties = audit.edges.select("repo", F.least("src", "dst").alias("a_module"), F.greatest("src", "dst").alias("b_module"), F.lit(1.0).alias("tie")).where("a_module <> b_module").distinct()
    pairs = pairs.join(ties, ["repo", "a_module", "b_module"], "left")
    if coupling is not None:
        both = coupling.select("repo", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), F.col("affinity").alias("cochange"))
        pairs = pairs.withColumns({"p": F.least("a_path", "b_path"), "q": F.greatest("a_path", "b_path")}).join(both, ["repo", "p", "q"], "left")
    else:
        pairs = pairs.withColumn("cochange", F.lit(None).cast("double"))
    pairs = pairs.withColumns({
        "import": F.when(F.col("a_root") | F.col("b_root"), 0.0).otherwise(F.coalesce("tie", F.lit(0.0))),
        "vocabulary": jaccard(F.col("a_words"), F.col("b_words")), "cochange": F.coalesce("cochange", F.lit(0.0)),
    })
    mixed = F.least(F.lit(1.0), 0.55 * F.col("import") + 0.25 * F.col("vocabulary") + COCHANGE * F.col("cochange"))
    return pairs.select("repo", "dir", F.col("a_module").alias("a"), F.col("b_module").alias("b"), "a_root", "b_root", *SIGNALS, mixed.alias("affinity"))


def clusters(audit: Audit, pairs: DataFrame) -> DataFrame:
    """(repo, dir, cluster, label, files, modules, affinity, signals) of each credible cluster."""
    roots = audit.roots.select("repo", "module")
    inner = audit.sources.join(roots, ["repo", "module"], "left_anti")
    size = audit.sources.groupBy("repo", "dir").agg(F.count("*").alias("total"))
    key = F.concat_ws("\x1f", "repo", "dir")
    found = average_link(inner.select(key.alias("g"), F.col("module").alias("member")), pairs.where("not a_root and not b_root").select(key.alias("g"), "a", "b", "affinity"), "g", "member", largest=1.0)
    found = found.select(F.split("g", "\x1f")[0].alias("repo"), F.split("g", "\x1f")[1].alias("dir"), "cluster", F.col("member").alias("module"))
    count = found.groupBy("repo", "dir", "cluster").agg(F.count("*").alias("n")).join(size, ["repo", "dir"]).where(F.col("n") <= F.greatest(F.lit(3), F.floor(F.col("total") * 0.6)))
    found = found.join(count.select("repo", "dir", "cluster"), ["repo", "dir", "cluster"], "left_semi")
    rows = found.join(audit.sources.select("repo", "dir", "module", "path", "vocabulary"), ["repo", "dir", "module"])
    last = F.element_at(F.split("module", "\\."), -1)
    own = _words(F.filter(F.split(F.lower(F.regexp_replace(last, "([a-z0-9])([A-Z])", "$1_$2")), "_"), lambda w: F.length(w) > 2))
    rows = rows.withColumns({"own": own, "words": _words(F.col("vocabulary"))}).withColumn("tail", F.when(F.size("own") > 1, F.slice("own", -1, 1)).otherwise(F.array().cast("array<string>")))
    label = label_scores(rows, ["repo", "dir", "cluster"], [(F.col("own"), 3), (F.col("tail"), 2), (F.col("words"), 1)]).drop("score")
    files = rows.groupBy("repo", "dir", "cluster").agg(F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.collect_set("module")).alias("modules"))
    member = lambda m: found.select("repo", "dir", "cluster", F.col("module").alias(m))
    means = pairs.join(member("a"), ["repo", "dir", "a"]).join(member("b"), ["repo", "dir", "b", "cluster"]).groupBy("repo", "dir", "cluster").agg(*[F.round(F.avg(c), 3).alias(c) for c in (*SIGNALS, "affinity")])
    return files.join(label, ["repo", "dir", "cluster"], "left").join(means, ["repo", "dir", "cluster"]).withColumn("label", F.coalesce("label", F.lit("domain")))


def plans(audit: Audit, found: DataFrame) -> DataFrame:
    """(repo, dir, steps, n_plans, importers, moves): a proposed sub-folder for each cluster, with what its moves touch."""
    order = Window.partitionBy("repo", "dir", "slug").orderBy("files")
    slug = F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    named = found.withColumn("slug", F.when(slug == "", "domain").otherwise(slug)).withColumn("nth", F.row_number().over(order))
    named = named.withColumn("folder", F.concat_ws("/", F.nullif("dir", F.lit("")), F.when(F.col("nth") > 1, F.concat_ws("-", "slug", "nth")).otherwise(F.col("slug"))))
    moves = named.select("repo", "dir", "folder", F.explode("files").alias("path")).withColumn("target", F.concat_ws("/", "folder", F.element_at(F.split("path", "/"), -1)))
    taken = audit.facts.select("repo", F.col("path").alias("target"), F.lit(True).alias("collides"))
    links = audit.edges.join(audit.facts.select("repo", F.col("module").alias("dst"), "path"), ["repo", "dst"]).join(audit.facts.select("repo", F.col("module").alias("src"), F.col("path").alias("importer")), ["repo", "src"])
    links = links.select("repo", "path", "importer")
    who = links.groupBy("repo", "path").agg(F.array_sort(F.collect_set("importer")).alias("importers"))
    beside = moves.select("repo", "folder", F.col("path").alias("importer"))  # these move along
    outside = moves.select("repo", "folder", "path").join(links, ["repo", "path"]).join(beside, ["repo", "folder", "importer"], "left_anti")
    outside = outside.groupBy("repo", "folder").agg(F.array_sort(F.collect_set("importer")).alias("external_importers"))
    rows = moves.join(taken, ["repo", "target"], "left").join(who, ["repo", "path"], "left")
    move = F.struct(F.col("path").alias("from"), F.col("target").alias("to"), F.coalesce("importers", F.array().cast("array<string>")).alias("importers"), F.coalesce("collides", F.lit(False)).alias("collides"))
    steps = rows.groupBy("repo", "dir", "folder").agg(F.array_sort(F.collect_list(move)).alias("moves"), F.sum(F.coalesce(F.size("importers"), F.lit(0))).alias("importers"), F.count("*").alias("n"))
    package = audit.facts.select("repo", F.col("path").alias("init"), F.lit(True).alias("package"))
    steps = steps.withColumn("init", F.concat_ws("/", "folder", F.lit("__init__.py"))).join(package, ["repo", "init"], "left").join(outside, ["repo", "folder"], "left")
    steps = steps.withColumn("external_importers", F.coalesce("external_importers", F.array().cast("array<string>")))
    risk = F.when(F.exists("moves", lambda m: m["collides"]), "high").when((F.col("importers") > 8) | F.col("package").isNull(), "medium").otherwise("low")
    steps = steps.withColumn("risk", risk)
    return steps.groupBy("repo", "dir").agg(F.array_sort(F.collect_list(F.struct("folder", "risk", "external_importers", "moves"))).alias("steps"), F.count("*").alias("n_plans"), F.sum("importers").alias("importers"), F.sum("n").alias("moves"))


def pressure(audit: Audit, found: DataFrame, proposed: DataFrame) -> DataFrame:
    """(repo, dir, n, factors, score, after) of each folder."""
    limit = float(audit.config.flat_directory_threshold)
    roots = audit.roots.select("repo", "module", F.lit(True).alias("root"))
    own = audit.sources.join(roots, ["repo", "module"], "left")
    stem = F.lower(F.regexp_replace("name", "\\.py$", ""))
    size = own.groupBy("repo", "dir").agg(F.count("*").alias("n"), F.count_if(F.col("root").isNull()).alias("inner"), F.avg(stem.isin(*GENERIC).cast("double")).alias("generic"), F.array_sort(F.collect_set(F.when(stem.isin(*GENERIC), F.col("path")))).alias("generic_files"))
    free = own.where("root is null").select("repo", "dir", "module")
    ties = audit.edges.join(free.withColumnRenamed("module", "src"), ["repo", "src"]).join(free.withColumnRenamed("module", "dst"), ["repo", "dst", "dir"]).where("src <> dst").groupBy("repo", "dir").agg(F.count("*").alias("ties"))
    rows = size.join(ties, ["repo", "dir"], "left").join(found.groupBy("repo", "dir").agg(F.count("*").alias("k")), ["repo", "dir"], "left").join(proposed, ["repo", "dir"], "left")
    rows = rows.fillna(0, ["ties", "k", "n_plans", "importers", "moves"])
    one = F.lit(1.0)
    rows = rows.withColumns({
        "flatness": F.least(one, F.col("n") / limit), "load": F.least(one, F.col("n") / 25.0),
        "cohesion": F.when(F.col("inner") <= 1, 0.0).otherwise(1.0 - F.least(one, F.col("ties") / (F.col("inner") * (F.col("inner") - 1)) * 4.0)), "fragments": F.least(one, F.col("k") / 4.0),
    })
    score = 100 * (0.25 * F.col("flatness") + 0.25 * F.col("load") + 0.20 * F.col("cohesion") + 0.15 * F.col("generic") + 0.15 * F.col("fragments"))
    gain = F.least(F.lit(30.0), 5.0 * F.col("n_plans") + 1.5 * F.col("moves"))
    return rows.withColumn("score", F.round(score, 1)).withColumn("after", F.round(F.greatest(F.lit(0.0), F.col("score") - gain), 1))


def analyse(audit: Audit, coupling: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings of overloaded folders, one row of structure score for each repository)."""
    pairs = affinities(audit, coupling)
    found = clusters(audit, pairs)
    proposed = plans(audit, found)
    rows = pressure(audit, found, proposed)
    limit = audit.config.flat_directory_threshold
    shown = found.groupBy("repo", "dir").agg(F.array_sort(F.collect_list(F.struct("label", "files", "affinity", F.struct("import", F.col("cochange").alias("change_coupling"), "vocabulary").alias("signals")))).alias("clusters"))
    flat = rows.where(F.col("n") >= limit).join(shown, ["repo", "dir"], "left")
    parted = (F.col("k") >= 2) & (F.col("n_plans") > 0)
    conf = F.when(parted, F.least(F.lit(0.92), 0.65 + 0.02 * (F.col("n") - limit + 1) + 0.025 * F.col("k"))).otherwise(0.60)
    metric = F.to_json(F.struct(F.col("dir").alias("path"), F.col("n").alias("modules"), "score", *[F.round(c, 3).alias(c) for c in ("flatness", "load", "cohesion", "generic", "fragments")], F.col("after").alias("estimated_after_proposals")))
    s = lambda t, v: F.struct(F.lit(t).alias("type"), F.coalesce(v, F.lit("[]")).alias("value"))
    proof = F.array(s("direct_python_modules", F.col("n").cast("string")), s("structure_entropy", metric), s("probable_clusters", F.to_json("clusters")), s("migration_plan", F.to_json("steps")), s("generic_modules", js(F.col("generic_files"))), s("cluster_proposal_available", parted.cast("string")))
    why = F.array(*map(F.lit, ("module_moves_require_import_rewrites", "string_module_paths_may_break", "entropy_delta_is_an_estimate_not_a_refactor_guarantee")))
    flat = flat.withColumn("path", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")))
    out = findings(flat, "flat-directory", "structure", F.when(parted, "warning").otherwise("info"), conf, F.lit(0.55), proof, why, F.when(parted, "proposal_only").otherwise("review_directory_load"))
    return out, weighted_mean(rows, "score", "n", ["repo"]).select("repo", F.round("weighted_mean", 1).alias("score"))
