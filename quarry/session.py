"""One audit, from files to a report."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import ancestors
from quarry.functions.storage import materialise
from quarry.rules import base, dependencies, stale, structure, style, symbols
from quarry.sources import files, history, manifests, python_facts
from quarry.sources import config as settings

COMMANDS = ("scan", "stale", "diff", "structure", "style")
_EMPTY = {"entrypoints": "repo string, spelling string", "public": "repo string, module string", "doubts": "repo string, kind string, source string", "declared": "repo string, name string, source string", "namespaces": "repo string, root string"}


class AuditSession:
    """``report(command)`` over tables of any number of repositories.

    Tables: files (repo, path, source); optional log (``history.COMMITS``), parents (``history.PARENTS``), changed (repo, path), before (files at
    the base, for import migrations), configs (repo, path, source, length), entrypoints, public, doubts, declared, namespaces (repo, root).
    ``from_directory`` fills them from one working tree.
    """

    def __init__(self, spark: SparkSession, sources: DataFrame, config: settings.Config | None = None, *, log: DataFrame | None = None, parents: DataFrame | None = None, changed: DataFrame | None = None, before: DataFrame | None = None, configs: DataFrame | None = None, import_roots: tuple[str, ...] = (), base_ref: str | None = None, cache: str | None = None, **tables: DataFrame):
        self.spark, self.config, self.log, self.changed, self.base_ref = spark, config or settings.Config(), log, changed, base_ref
        self.tables = {k: tables.get(k) or spark.createDataFrame([], v) for k, v in _EMPTY.items()}
        self.before, self.parents = before, parents
        self.import_roots = tuple(r.strip("/") for r in (*self.config.import_roots, *import_roots) if r.strip("/"))
        if configs is not None:
            refs, doubt = manifests.deployment(configs)
            self.tables["entrypoints"] = self.tables["entrypoints"].unionByName(refs.select("repo", F.col("module").alias("spelling")))
            self.tables["doubts"] = self.tables["doubts"].unionByName(doubt.select("repo", F.lit("deployment").alias("kind"), "source"))
        facts = cached_facts(sources, cache) if cache else python_facts.extract(sources)
        self.facts = materialise(base.with_modules(facts, self.config, import_roots), "facts")

    @classmethod
    def from_directory(cls, spark: SparkSession, root: str | Path, config: settings.Config | None = None, base_ref: str | None = None, **more) -> AuditSession:
        root = Path(root)
        config, repo = config or settings.load(root), root.resolve().name
        pack = manifests.packaging(root)
        known = files.list_files(root, config.exclude)
        rows = [(repo, p, files.decode((root / p).read_bytes()) if (root / p).stat().st_size <= manifests.LARGEST else None, (root / p).stat().st_size) for p in known if not p.endswith(".py")]
        table = lambda k, values: spark.createDataFrame([(repo, *v) for v in values], _EMPTY[k])
        has_log = files.git(root, "rev-parse", "HEAD")
        log = history.read_log(spark, root, repo) if has_log else None
        parents = history.read_parents(spark, root, repo) if has_log else None
        changed = before = None
        if base_ref:
            changed = history.changed_paths(spark, root, base_ref, repo)
            before = files.snapshot(spark, root, base_ref, repo).join(changed, ["repo", "path"], "left_semi")
        return cls(
            spark, files.scan_repository(spark, root, repo, config.exclude), config, log=log, parents=parents, changed=changed, before=before, base_ref=base_ref, import_roots=tuple(pack["roots"]),
            configs=spark.createDataFrame(rows, "repo string, path string, source string, length long"), entrypoints=table("entrypoints", [(m,) for m in pack["entrypoints"]]),
            public=table("public", [(m,) for m in pack["public"]]), doubts=table("doubts", [("packaging", s) for s in pack["doubts"]]), declared=table("declared", manifests.dependencies(root)), namespaces=table("namespaces", [(r,) for r in pack["namespaces"]]), **more,
        )

    def audit(self) -> base.Audit:
        facts = self.facts
        edges = materialise(base.module_edges(facts), "edges")
        roots = materialise(base.module_roots(facts, self.config, self.tables["entrypoints"]), "roots")
        migrations = None
        if self.changed is not None:
            none = self.spark.createDataFrame([], files.FILES)
            old = python_facts.extract(self.before if self.before is not None else none)
            migrations = materialise(history.import_migrations(old, facts.join(self.changed, ["repo", "path"], "left_semi")), "migrations")
        births = materialise(history.births(self.log), "births") if self.log is not None else None
        return base.Audit(self.config, facts, edges, base.reach(edges, roots), roots, self.changed, migrations, births, self.log, self.tables["public"], self.tables["doubts"], self.tables["namespaces"], self.import_roots, self.parents)

    def findings(self, command: str = "scan", experimental: bool = False, baseline: DataFrame | None = None) -> DataFrame:
        """Findings in report order. baseline: files of an earlier time, for the style rule."""
        if command not in COMMANDS:
            raise ValueError(f"command must be one of {', '.join(COMMANDS)}")
        if command == "diff" and self.changed is None:
            raise ValueError("diff needs the changed paths")
        audit, out = self.audit(), []
        if command in ("scan", "diff", "stale"):
            out += [stale.stale_files(audit), stale.orphan_files(audit)]
        if command in ("scan", "diff"):
            uses, wild = symbols.references(audit)
            uses, wild = materialise(uses, "uses"), materialise(wild, "wild")
            dups = symbols.duplicates(audit, uses)
            out += [dups, symbols.without_duplicated(symbols.unused_helpers(audit, uses, wild), dups), dependencies.leftovers(audit, self.tables["declared"])]
        if command == "structure" or experimental and command in ("scan", "diff"):
            out.append(structure.analyse(audit, history.coupling(self.log) if self.log is not None else None)[0])
        if command == "style" or experimental and command in ("scan", "diff"):
            before = base.with_modules(python_facts.extract(baseline), self.config) if baseline is not None else None
            out.append(style.drift(audit, before))
        rows = out[0]
        for more in out[1:]:
            rows = rows.unionByName(more)
        if command == "diff":
            rows = in_diff(rows, self.changed)
        return rows.orderBy(F.desc("confidence"), "rule", "path", "id")

    def metrics(self, command: str = "scan") -> DataFrame:
        """One row of counts for each repository."""
        audit = self.audit()
        reached = audit.reachable.groupBy("repo").agg(F.count("*").alias("reachable_modules"))
        roots = audit.roots.groupBy("repo").agg(F.count("*").alias("entrypoints"))
        own = audit.facts.groupBy("repo").agg(
            F.count("*").alias("python_files"), F.count_if(F.col("category") == "source").alias("source_files"), F.count_if(F.size("frameworks") > 0).alias("framework_entrypoints"),
            F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"), F.array_sort(F.collect_set(F.when(F.col("parse_error").isNotNull(), F.col("path")))).alias("parse_error_files"),
        )
        out = own.join(reached, "repo", "left").join(roots, "repo", "left").fillna(0, ["reachable_modules", "entrypoints"]).withColumn("command", F.lit(command))
        if self.changed is not None:
            out = out.join(self.changed.groupBy("repo").agg(F.count("*").alias("changed_files")), "repo", "left")
        return out


def in_diff(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed paths, on folders above them, or that name them as related."""
    related = F.flatten(F.transform(F.filter("evidence", lambda e: e["type"].isin("related_changed_paths")), lambda e: F.from_json(e["value"], "array<string>")))
    moved = F.exists("evidence", lambda e: e["type"].isin("call_site_migration"))
    # the paths by which a finding can be hit, each met by equality; the root folder is '.' in findings
    marks = changed.select("repo", F.col("path").alias("__on"), F.lit("file").alias("__as")).unionByName(
        changed.select("repo", F.explode(ancestors(F.col("path"))).alias("__on"), F.lit("folder").alias("__as"))
    )
    folder = F.when(F.col("rule") == "flat-directory", F.when(F.col("path") == ".", "").otherwise(F.col("path")))
    own = F.concat(F.array("path"), F.coalesce(related, F.array().cast("array<string>")))
    ask = F.concat(F.transform(own, lambda p: F.struct(p.alias("on"), F.lit("file").alias("as"))), F.array(F.struct(folder.alias("on"), F.lit("folder").alias("as"))))
    asked = rows.select("repo", "id", moved.alias("__moved"), F.explode(ask).alias("__a")).select("repo", "id", "__moved", F.col("__a.on").alias("__on"), F.col("__a.as").alias("__as"))
    hits = asked.join(marks.distinct(), ["repo", "__on", "__as"], "left_semi").select("repo", "id")
    # a moved call site is a change of this diff wherever its finding lies
    told = asked.where("__moved").select("repo", "id").join(changed.select("repo").distinct(), "repo", "left_semi")
    return rows.join(hits.unionByName(told).distinct(), ["repo", "id"], "left_semi").select(*rows.columns)


def cached_facts(sources: DataFrame, cache: str) -> DataFrame:
    """Facts by content: files whose path and source are in the Parquet cache are not parsed again; new ones are added to it."""
    spark = sources.sparkSession
    rows = sources.where("source is not null").withColumn("cache_key", F.sha2(F.concat_ws("\x1f", F.lit(python_facts.SCHEMA), "path", "source"), 256))
    schema = "cache_key string, " + python_facts.SCHEMA
    try:
        known = spark.read.schema(schema).parquet(cache)
        known.limit(0).collect()
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], schema)
    new = rows.join(known.select("cache_key").distinct(), "cache_key", "left_anti")
    key = new.select("repo", "path", "cache_key")
    added = materialise(python_facts.extract(new).join(key, ["repo", "path"]).select("cache_key", *[c for c in known.columns if c != "cache_key"]), "facts")
    own = rows.select("cache_key", F.col("repo").alias("__repo"))
    old = materialise(known.dropDuplicates(["cache_key"]).join(own, "cache_key").withColumn("repo", F.col("__repo")).select(*added.columns), "facts")
    added.write.mode("append").parquet(cache)
    return old.unionByName(added).drop("cache_key")
