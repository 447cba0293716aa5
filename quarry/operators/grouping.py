"""Groups of equal rows, their canonical member, and co-occurrence counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.storage import materialise


def duplicate_groups(df: DataFrame, key: Sequence[str | Column], member: str, at_least: int = 2) -> DataFrame:
    """(key.., members, first) of the keys that ``at_least`` distinct members share; partial counts run before the shuffle."""
    return df.groupBy(*key).agg(F.countDistinct(member).alias("members"), F.min(member).alias("first")).where(F.col("members") >= at_least)


def canonical(df: DataFrame, key: Sequence[str], order: Sequence[Column], carry: Sequence[str], at_least: int = 2) -> DataFrame:
    """Rows that are not their group's first by ``order``, with the first one's ``carry`` as canonical_*.

    The first is a minimum over structs, not a window: a group of any size is never sorted in one task.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    ranked = df.withColumn("__rank", rank)
    first = ranked.groupBy(*key).agg(F.min("__rank").alias("__first"), F.count("*").alias("__n")).where(F.col("__n") >= at_least)
    rest = ranked.join(first, list(key)).where(F.col("__rank") != F.col("__first"))
    return rest.select(*df.columns, *[F.col(f"__first.c{i}").alias(f"canonical_{c}") for i, c in enumerate(carry)])


def cochange(df: DataFrame, event: str, item: str, max_items: int = 100, min_pair: int = 2) -> DataFrame:
    """(a, b, pair_count, affinity): pairs of items that occur in the same events, a < b.

    Events of more than ``max_items`` items are dropped, so a pair join makes at most max_items**2 / 2 rows an
    event. affinity = pair count / the smaller item count, to 3 digits.
    """
    rows = df.select(F.col(event).alias("e"), F.col(item).alias("i")).where("e is not null and i is not null").distinct()
    small = rows.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") <= max_items).select("e")
    rows = rows.join(small, "e")
    each = rows.groupBy("i").agg(F.count("*").alias("n"))
    pairs = rows.select("e", F.col("i").alias("a")).join(rows.select("e", F.col("i").alias("b")), "e").where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("pair_count")).where(F.col("pair_count") >= min_pair)
    both = pairs.join(each.withColumnsRenamed({"i": "a", "n": "na"}), "a").join(each.withColumnsRenamed({"i": "b", "n": "nb"}), "b")
    return both.where(F.least("na", "nb") >= 2).select("a", "b", "pair_count", F.round(F.col("pair_count") / F.least("na", "nb"), 3).alias("affinity"))


def cochange_within(df: DataFrame, event: str, item: str, groups: DataFrame, group: str, max_items: int = 100, min_pair: int = 2) -> DataFrame:
    """(group, a, b, pair_count, affinity): as ``cochange``, of pairs of items of the same group of ``groups`` (item, group) alone.

    Only events that hold two items of a group are gathered; those are found by a hash of the group, which may let others through.
    """
    rows = df.select(F.col(event).alias("e"), F.col(item).alias("i")).where("e is not null and i is not null")
    known = groups.select(F.col(item).alias("i"), F.col(group).alias("g")).where("i is not null and g is not null")
    met = rows.join(known.select("i", F.xxhash64("g").alias("h")), "i").groupBy("e", "h").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo < hi")
    met = materialise(met.select("e").distinct(), "met")
    fits = lambda items: F.size(F.array_distinct(F.transform(items, lambda x: x["i"]))) <= max_items
    events = rows.join(met, "e", "left_semi").join(known, "i").groupBy("e").agg(F.collect_set(F.struct("g", "i")).alias("items")).where(fits(F.col("items")))
    first = events.select("items", F.explode("items").alias("x")).select("x", F.explode(F.filter("items", lambda y: (y["g"] == F.col("x.g")) & (y["i"] > F.col("x.i")))).alias("y"))
    pairs = first.groupBy(F.col("x.g").alias(group), F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.count("*").alias("pair_count")).where(F.col("pair_count") >= min_pair)
    pairs = materialise(pairs, "cochange")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct()
    uses = materialise(rows.join(paired, "i", "left_semi").distinct(), "uses")
    large = rows.join(uses.select("e").distinct(), "e", "left_semi").join(known, "i", "left_semi").groupBy("e").agg(F.countDistinct("i").alias("n")).where(F.col("n") > max_items).select("e")
    each = uses.join(large, "e", "left_anti").groupBy("i").agg(F.count("*").alias("n"))
    both = pairs.join(each.withColumnsRenamed({"i": "a", "n": "na"}), "a").join(each.withColumnsRenamed({"i": "b", "n": "nb"}), "b")
    return both.where(F.least("na", "nb") >= 2).select(group, "a", "b", "pair_count", F.round(F.col("pair_count") / F.least("na", "nb"), 3).alias("affinity"))


def inbound(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """(node, inbound): distinct sources of each node, 0 where there is none."""
    counts = edges.groupBy(F.col(dst).alias(node)).agg(F.countDistinct(src).alias("inbound"))
    return nodes.select(node).join(counts, node, "left").select(node, F.coalesce("inbound", F.lit(0)).alias("inbound"))


def label_scores(df: DataFrame, group: Sequence[str], weighted: Sequence[tuple[Column, int]]) -> DataFrame:
    """(group.., label, score): each group's word of greatest weight; ties go to the first word.

    ``weighted``: (array of words, weight of each).
    """

    def weigh(k: int):
        return lambda w: F.struct(w.alias("word"), F.lit(k).alias("k"))

    parts = F.concat(*[F.transform(words, weigh(k)) for words, k in weighted])
    each = df.select(*group, F.explode(parts).alias("p")).groupBy(*group, F.col("p.word").alias("word")).agg(F.sum("p.k").alias("score"))
    best = each.groupBy(*group).agg(F.min(F.struct((-F.col("score")).alias("neg"), "word")).alias("best"))
    return best.select(*group, F.col("best.word").alias("label"), (-F.col("best.neg")).alias("score"))
