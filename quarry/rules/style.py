"""Files whose style differs from their peers'."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.rules.base import EVIDENCE, Audit, findings

LEAST_PEERS = 5
# feature = (value, support, least support, effect, rare threshold, least scale). f, l, t: functions,
# lines and top-level functions (1 at least).
FEATURES = {
    "docstring_lines_per_function": ("docstring_lines / f", "functions", 1, 3.0, 5.0, 0.25),
    "narration_comments_per_100_loc": ("narration_comments * 100 / l", "loc", 1, 1.0, 2.0, 0.35),
    "broad_exceptions_per_function": ("broad_exceptions / f", "functions", 1, 0.25, 0.25, 0.25),
    "print_calls_per_function": ("print_calls / f", "functions", 1, 0.5, 0.5, 0.25),
    "nested_dicts_per_function": ("nested_dicts / f", "functions", 1, 0.25, 0.25, 0.25),
    "temporary_names_per_100_loc": ("temporary_names * 100 / l", "loc", 1, 2.0, 3.0, 0.35),
    "annotation_density": ("annotations / f", "functions", 1, 1.0, 2.0, 0.25),
    "median_function_loc": ("function_median_loc", "functions", 1, 30.0, 35.0, 1.0),
    "builtin_generic_ratio": ("builtin_generic_annotations / greatest(builtin_generic_annotations + legacy_generic_annotations, 1)", "builtin_generic_annotations + legacy_generic_annotations", 2, 0.35, 0.75, 0.10),
    "legacy_typing_per_100_loc": ("legacy_generic_annotations * 100 / l", "loc", 1, 1.0, 2.0, 0.35),
    "pep604_union_ratio": ("pep604_unions / greatest(pep604_unions + legacy_optional_unions, 1)", "pep604_unions + legacy_optional_unions", 2, 0.35, 0.75, 0.10),
    "legacy_union_per_100_loc": ("legacy_optional_unions * 100 / l", "loc", 1, 0.5, 1.0, 0.35),
    "pathlib_ratio": ("pathlib_uses / greatest(pathlib_uses + os_path_uses, 1)", "pathlib_uses + os_path_uses", 3, 0.35, 0.75, 0.10),
    "os_path_calls_per_100_loc": ("os_path_uses * 100 / l", "loc", 1, 0.5, 1.0, 0.35),
    "comprehension_ratio": ("comprehensions / greatest(comprehensions + for_loops, 1)", "comprehensions + for_loops", 3, 0.35, 0.75, 0.10),
    "manual_loops_per_function": ("for_loops / f", "functions", 1, 0.5, 1.0, 0.25),
    "structured_model_ratio": ("structured_models / greatest(structured_models + bare_dict_annotations, 1)", "structured_models + bare_dict_annotations", 2, 0.35, 0.75, 0.10),
    "bare_dict_models_per_function": ("bare_dict_annotations / f", "functions", 1, 0.5, 0.5, 0.25),
    "print_share_of_output_calls": ("print_calls / greatest(print_calls + logging_calls, 1)", "print_calls + logging_calls", 3, 0.35, 0.75, 0.10),
    "branch_points_per_function": ("branch_points / f", "functions", 1, 2.0, 5.0, 0.25),
    "mean_cyclomatic_complexity": ("cyclomatic_complexity / f", "functions", 1, 2.0, 6.0, 1.0),
    "high_complexity_function_ratio": ("high_complexity_functions / f", "functions", 1, 0.3, 0.4, 0.10),
    "private_helper_ratio": ("private_helpers / t", "top_level_functions", 3, 0.4, 0.75, 0.10),
    "snake_case_function_ratio": ("snake_case_functions / f", "functions", 3, 0.35, 0.75, 0.10),
    "function_name_words_mean": ("function_name_words / f", "functions", 1, 1.5, 4.0, 0.5),
    "defensive_guards_per_function": ("defensive_guards / f", "functions", 1, 0.5, 0.5, 0.25),
    "single_use_tiny_helper_ratio": ("single_use_tiny_helpers / t", "top_level_functions", 3, 0.4, 0.75, 0.10),
    "wrapper_function_ratio": ("wrapper_functions / f", "functions", 3, 0.4, 0.75, 0.10),
    "log_then_reraise_per_function": ("log_then_reraise_handlers / f", "functions", 1, 0.25, 0.25, 0.25),
    "redundant_temp_returns_per_function": ("redundant_temp_returns / f", "functions", 1, 0.5, 0.5, 0.25),
    "mapping_get_calls_per_function": ("mapping_get_calls / f", "functions", 1, 1.0, 2.0, 0.25),
    "narration_logging_per_100_loc": ("narration_logging_calls * 100 / l", "loc", 1, 0.75, 1.0, 0.35),
}
STRONG = ("docstring_lines_per_function", "narration_comments_per_100_loc", "broad_exceptions_per_function", "nested_dicts_per_function", "mean_cyclomatic_complexity")


def long(facts: DataFrame) -> DataFrame:
    """(repo, path, dir, feature, value, support) of each source file with two lines or more."""
    rows = facts.where("category = 'source' and parse_error is null").select("repo", "path", "dir", "name", "main_guard", "style.*").where("loc >= 2")
    rows = rows.withColumns({"f": F.expr("greatest(functions, 1)"), "l": F.expr("greatest(loc, 1)"), "t": F.expr("greatest(top_level_functions, 1)")})
    each = [F.struct(F.lit(k).alias("feature"), F.expr(v).cast("double").alias("value"), F.expr(s).cast("double").alias("support"), F.lit(float(n)).alias("least")) for k, (v, s, n, *_) in FEATURES.items()]
    usable = (F.col("loc") >= 5) & (F.col("functions") > 0) & ~F.col("name").isin("__init__.py", "__main__.py")
    quiet = F.col("main_guard") | (F.lower("name") == "cli.py")
    return rows.select("repo", "path", "dir", usable.alias("usable"), quiet.alias("quiet"), F.explode(F.array(*each)).alias("x")).select("repo", "path", "dir", "usable", "quiet", "x.*")


def _without(s: np.ndarray, i: int) -> float:
    """Median of sorted values without the i-th."""
    n = len(s) - 1
    at = lambda k: s[k] if k < i else s[k + 1]
    return float(at(n // 2)) if n % 2 else float(at(n // 2 - 1) + at(n // 2)) / 2


class _Pool:
    """Median and median distance of some values, with or without one of them."""

    def __init__(self, values: np.ndarray):
        self.s, self.distances = np.sort(values), {}

    def stats(self, own: float | None) -> tuple[float, float, float, int]:
        s = self.s
        med = float(np.median(s)) if own is None else _without(s, int(np.searchsorted(s, own)))
        if med not in self.distances:
            self.distances[med] = np.sort(np.abs(s - med))
        d = self.distances[med]
        mad = float(np.median(d)) if own is None else _without(d, int(np.searchsorted(d, abs(own - med))))
        positive, n = float((s > 0).sum()), len(s)
        if own is not None:
            positive, n = positive - (own > 0), n - 1
        return med, mad, positive / n if n else 0.0, n


UNUSUAL = "repo string, path string, peers long, mode string, feature string, value double, median double, z double, support double, supported long"


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One feature of one repository: each usable file against its peers (its folder's, if they are enough)."""
    feature = pdf.feature.iloc[0]
    _, _, least, effect, rare, scale = FEATURES[feature]
    base = pdf[pdf.baseline]
    mode = "pre-ai-git" if len(base) else "repository-peers"
    pool = base if len(base) else pdf
    enough = pool.support >= least
    sizes = pool.groupby("dir").size()
    folders = {d: _Pool(g.value.to_numpy()) for d, g in pool[enough].groupby("dir")}
    all_ = _Pool(pool[enough].value.to_numpy())
    out = []
    for r in pdf[pdf.usable & ~pdf.baseline & (pdf.support >= least)].itertuples():
        if feature == "print_calls_per_function" and r.quiet:
            continue
        mine = 0 if len(base) else 1
        near = sizes.get(r.dir, 0) - mine
        peers = near if near >= LEAST_PEERS else len(pool) - mine
        chosen = folders.get(r.dir) if near >= LEAST_PEERS else all_
        if peers < LEAST_PEERS or chosen is None or len(chosen.s) - mine < LEAST_PEERS:
            continue
        med, mad, share, n = chosen.stats(r.value if mine else None)
        z = abs(r.value - med) / max(1.4826 * mad, scale, 0.15 * abs(med))
        if z >= 3.5 and abs(r.value - med) >= effect or r.value > rare and med == 0 and share <= 0.2:
            out.append((r.repo, r.path, peers, mode, feature, r.value, med, z, r.support, n))
    return pd.DataFrame(out, columns=[c.split()[0] for c in UNUSUAL.split(", ")])


def unusual(facts: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    rows = long(facts).withColumn("baseline", F.lit(False))
    if baseline is not None:
        rows = rows.unionByName(long(baseline).withColumn("baseline", F.lit(True)))
    return rows.groupBy("repo", "feature").applyInPandas(_judge, UNUSUAL)


def drift(audit: Audit, baseline: DataFrame | None = None) -> DataFrame:
    rows = unusual(audit.facts, baseline)
    item = F.struct(F.col("feature").alias("type"), F.to_json(F.struct(
        F.round("median", 3).alias("baseline_median"), F.col("supported").alias("baseline_supported_files"), F.round("z", 2).alias("robust_z"), F.col("support").cast("long").alias("support"), F.round("value", 3).alias("value"),
    )).alias("value"))
    strong = F.col("feature").isin(*STRONG).cast("int")
    each = rows.groupBy("repo", "path").agg(F.max("peers").alias("peers"), F.max("mode").alias("mode"), F.count("*").alias("n"), F.max(strong).alias("strong"), F.sum(F.least(F.lit(8.0), F.round("z", 2))).alias("strength"), F.collect_list(item).alias("items"))
    each = each.where("n >= 2 or strong = 1")
    conf = F.least(F.lit(0.95), 0.50 + 0.08 * F.col("n") + 0.012 * F.col("strength"))
    conf = F.when(F.col("peers") < 8, F.least(conf, F.lit(0.64))).when(F.col("peers") < 20, F.least(conf, F.lit(0.84))).otherwise(conf)
    s = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    proof = F.concat("items", F.array(s("baseline_files", F.col("peers").cast("string")), s("baseline_mode", F.concat(F.lit('"'), "mode", F.lit('"'))), s("ai_authorship_proof", F.lit("false")))).cast(EVIDENCE)
    return findings(each, "style-drift", "style", F.when(conf >= 0.85, "warning").otherwise("info"), conf, F.lit(0.35), proof, F.array(F.lit("repository_style_can_vary_by_domain")), "agent_review")
