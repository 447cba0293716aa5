"""Column expressions shared by rules and queries; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.85, 0.65


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def tier(confidence: Column) -> Column:
    """high from .85, medium from .65, else low."""
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def words(text: Column, longer_than: int = 2) -> Column:
    """Sorted distinct lower-case words; camel case and snake case are split."""
    split = F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2")), "[^\\p{L}0-9]+")
    return F.array_sort(F.array_distinct(F.filter(split, lambda w: F.length(w) > longer_than)))


def prefixes(dotted: Column, sep: str = ".") -> Column:
    """a.b.c -> [a, a.b, a.b.c]; the empty string has none."""
    parts = F.split(dotted, "\\" + sep)
    return F.when(F.length(dotted) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    )


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), "(?<=.)\\.[^.]*$", "")


def ancestors(path: Column) -> Column:
    """All folders above a path, the root as the empty string."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.concat(F.array(F.lit("")), F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


#: End of a file stem that marks an iteration of another file.
ITERATION_SUFFIX = r"(?i)(?:_(?:old|new|final|fixed|backup|copy\d*|v\d+)|\.(?:old|bak))$"


def family(stem_: Column) -> Column:
    """A stem without its iteration suffixes, lower case."""
    out = stem_
    for _ in range(3):
        out = F.regexp_replace(out, ITERATION_SUFFIX, "")
    return F.lower(out)


def content_id(rule: str | Column, *parts: Column) -> Column:
    """rule:first 12 hex digits of the sha256 of the parts; nulls count as empty."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.concat(rule, F.lit(":"), F.substring(F.sha2(F.concat_ws("|", rule, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 12))


def any_prefix(path: Column, starts: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | path.startswith(s)
    return out
