"""Declared dependencies that nothing imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import prefixes
from quarry.rules.base import Audit, evidence, findings, js

# Import names that differ from the distribution's, tools that are only run, shared namespaces.
IMPORT_NAMES = {
    "attrs": ("attr", "attrs"), "beautifulsoup4": ("bs4",), "opencv-python": ("cv2",), "opencv-python-headless": ("cv2",), "pillow": ("PIL",), "protobuf": ("google.protobuf",),
    "pyjwt": ("jwt",), "pyyaml": ("yaml",), "python-dateutil": ("dateutil",), "python-dotenv": ("dotenv",), "scikit-image": ("skimage",), "scikit-learn": ("sklearn",), "setuptools": ("pkg_resources", "setuptools"),
}
COMMANDS = ("black", "coverage", "flake8", "gunicorn", "mypy", "nox", "pre-commit", "pytest", "ruff", "tox")
NAMESPACES = ("azure-", "google-cloud-", "opentelemetry-", "sphinxcontrib-", "zope-")


def leftovers(audit: Audit, declared: DataFrame) -> DataFrame:
    """declared: (repo, name, source)."""
    known = F.create_map(*[x for k, v in IMPORT_NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = declared.withColumn("dist", F.lower(F.regexp_replace("name", "[-_.]+", "-"))).where(~F.col("dist").isin(*COMMANDS))
    rows = rows.groupBy("repo", "dist").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("source")).alias("sources"))
    rows = rows.withColumn("candidates", F.coalesce(known[F.col("dist")], F.array(F.replace("dist", F.lit("-"), F.lit("_")))))
    used = F.concat(F.transform("imports", lambda i: i["module"]), "dynamic_refs", "string_refs")
    imported = audit.facts.select("repo", F.explode(F.flatten(F.transform(used, lambda m: prefixes(m)))).alias("c")).distinct()
    hit = rows.select("repo", "dist", F.explode("candidates").alias("c")).join(imported, ["repo", "c"], "left_semi").select("repo", "dist").distinct()
    rows = rows.join(hit, ["repo", "dist"], "left_anti")
    none = F.array().cast("array<string>")
    if audit.changed is not None:
        touched = audit.changed.groupBy("repo").agg(F.collect_set("path").alias("paths"))
        gone = audit.migrations.select("repo", F.explode("removed").alias("m")).groupBy("repo").agg(F.collect_set(F.substring_index("m", ".", 1)).alias("gone")) if audit.migrations is not None else touched.select("repo", none.alias("gone"))
        rows = rows.join(touched, "repo", "left").join(gone, "repo", "left").withColumns({"paths": F.coalesce("paths", none), "gone": F.coalesce("gone", none)})
    else:
        rows = rows.withColumns({"paths": none, "gone": none})
    rows = rows.withColumns({"manifests": F.array_sort(F.array_intersect("sources", "paths")), "removed": F.array_sort(F.array_intersect("candidates", "gone"))})
    rows = rows.where((F.size("paths") == 0) | (F.size("manifests") > 0) | (F.size("removed") > 0))
    python = F.filter("paths", lambda p: p.endswith(".py"))
    related = F.slice(F.array_sort(F.array_distinct(F.when(F.size("removed") > 0, F.concat("manifests", python)).otherwise(F.col("manifests")))), 1, 20)
    shared = F.lit(False)
    for n in NAMESPACES:
        shared = shared | F.col("dist").startswith(n)
    why = F.array_compact(F.array(F.lit("dependency_can_be_used_via_cli_plugin_or_runtime_metadata"), F.lit("distribution_name_may_not_equal_import_name"), F.when(shared, "namespace_distribution_import_is_ambiguous")))
    proof = evidence(dependency=js(F.col("name")), declared_in=js(F.col("sources")), import_candidates=js(F.col("candidates")), static_imports_found=js([]), removed_imports=js(F.col("removed")), related_changed_paths=js(related))
    rows = rows.withColumn("path", F.col("sources")[0])
    return findings(rows, "dependency-leftover", "repo-gc", "info", F.when(shared, 0.58).otherwise(0.68), F.lit(0.88), proof, why, "review_only")
