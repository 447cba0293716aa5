"""Greedy average-link clustering within small groups (folders); the order of merges matters, so one group is one task's row set."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRONG, AVERAGE, COHESION, LARGEST = 0.42, 0.18, 0.30, 0.60
#: Copies of affinity 1 merge before all else if no other affinity reaches this.
APART = 0.999


def _merged(total: np.ndarray, top: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """The final clusters, as lists of indexes. Clusters come in order of their greatest member; ``total`` and ``top`` are symmetric.

    Of two disjoint clusters that may join a third, the one with the greater greatest member makes the greater reversed
    member list, so ties go to the pair with the greatest members, compared first by the greater one.
    """
    n = len(size)
    held, alive = [[i] for i in range(n)], np.ones(n, bool)
    # the best partner of each cluster among those before it
    mean, most, low = np.full(n, -1.0), np.full(n, -1.0), np.full(n, -1)

    def look(i: int) -> None:
        means = total[i, :i] / (size[i] * size[:i])
        fits = alive[:i] & (top[i, :i] >= STRONG) & (means >= AVERAGE)
        mean[i] = most[i] = low[i] = -1
        if fits.any():
            means = np.where(fits, means, -1.0)
            mean[i] = means.max()
            tops = np.where(means == mean[i], top[i, :i], -1.0)
            most[i] = tops.max()
            low[i] = np.flatnonzero(tops == most[i])[-1]

    for i in range(n):
        look(i)
    while n and (best := mean.max()) >= 0:
        tied = np.where(mean == best, most, -1.0)
        hi = int(np.flatnonzero(tied == tied.max())[-1])
        lo = int(low[hi])
        total[hi] += total[lo]
        total[:, hi] = total[hi]
        top[hi] = np.maximum(top[hi], top[lo])
        top[:, hi] = top[hi]
        size[hi] += size[lo]
        held[hi] += held[lo]
        alive[lo], mean[lo], low[lo] = False, -1.0, -1
        stale = alive & ((low == lo) | (low == hi))
        # for later clusters, the merged one may have become the best partner
        rest = np.flatnonzero(alive[hi + 1 :] & ~stale[hi + 1 :]) + hi + 1
        means = total[rest, hi] / (size[rest] * size[hi])
        fits = (top[rest, hi] >= STRONG) & (means >= AVERAGE)
        stale[rest[fits & (means >= mean[rest])]] = True
        stale[hi] = True
        for i in np.flatnonzero(stale):
            look(i)
    return [held[i] for i in np.flatnonzero(alive)]


def _mean(values: np.ndarray, counts: np.ndarray | None) -> float:
    """Mean of values that occur ``counts`` times (once where None)."""
    if counts is None:
        return sum(values.tolist()) / len(values)
    each, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, weights=counts).astype(np.int64).tolist()
    return float(sum(Fraction(v) * k for v, k in zip(each.tolist(), n, strict=True))) / sum(n)


def agglomerate(members: list, affinity: dict[tuple, float], largest: float = LARGEST, copy_of: dict | None = None, more: dict[tuple, float] | None = None) -> list[tuple[list, float]]:
    """(members, mean affinity) of the credible clusters of one group.

    The pair of clusters with the greatest mean (then strongest, then reversed member list) merges while its
    strongest pair reaches STRONG and its mean AVERAGE. Clusters of 2 to max(3, ``largest`` of all) members whose mean
    affinity reaches COHESION are credible.

    ``copy_of`` names a member's class where that is not the member itself; ``affinity`` is then that of classes,
    (c, c) that of the members of a class among each other. Classes of affinity 1 to themselves and less to all
    others would merge first, each in descending order of its members, so they are merged to begin with.

    ``more`` is added to the affinity of single pairs of members, whatever their classes, up to 1 in all.
    """
    copy_of = copy_of or {}
    members = sorted(set(members))
    kinds: dict = {}
    for m in members:
        kinds.setdefault(copy_of.get(m, m), []).append(m)
    cross = {(x, y): v for (x, y), v in affinity.items() if x != y and x in kinds and y in kinds}
    kind = {m: k for k, own in kinds.items() for m in own}
    base = lambda x, y: affinity.get((x, y), affinity.get((y, x), 0.0))
    raised = {}  # pair of members: affinity without and with more
    for (a, b), v in (more or {}).items():
        if a != b and a in kind and b in kind and v > 0 and (was := base(kind[a], kind[b])) < 1.0:
            raised[a, b] = (was, min(1.0, was + v))
    apart = all(v < APART for v in cross.values()) and all(v < APART for (a, b), (_, v) in raised.items() if kind[a] != kind[b])
    # what has no strong pair stays alone
    tied = {k for pair, v in cross.items() if v >= STRONG for k in pair} | {k for k, own in kinds.items() if len(own) > 1 and affinity.get((k, k), 0.0) >= STRONG}
    tied |= {kind[m] for pair, (_, v) in raised.items() if v >= STRONG for m in pair}
    parts = sorted(((k, part) for k in tied for part in ([kinds[k]] if apart and affinity.get((k, k)) == 1.0 else [[m] for m in kinds[k]])), key=lambda x: x[1][-1])
    at: dict = {}
    for i, (k, _) in enumerate(parts):
        at.setdefault(k, []).append(i)
    n = len(parts)
    one = np.zeros((n, n))  # affinity of a member of either part
    for (x, y), v in affinity.items():
        if x in at and y in at:
            i, j = np.ix_(at[x], at[y])
            one[i, j] = v
            one[j.T, i.T] = v
    size = np.array([len(p) for _, p in parts], np.int64)
    total = one.copy()
    for i in range(n):  # added up one by one, as single members that merge would be: the earlier part first
        for j in np.flatnonzero(one[i, :i] * ((size[i] > 1) | (size[:i] > 1))):
            x = np.cumsum(np.full(size[i], one[i, j]))[-1]
            total[i, j] = total[j, i] = np.cumsum(np.full(size[j], x))[-1]
    top, place = one.copy(), {m: i for i, (_, own) in enumerate(parts) for m in own}
    lifted: dict[tuple[int, int], list] = {}
    for (a, b), (was, v) in raised.items():
        if a in place and b in place:
            i, j = place[a], place[b]
            lifted.setdefault((min(i, j), max(i, j)), []).append((was, v))
    for (i, j), changes in lifted.items():
        total[i, j] = changes[0][1] if size[i] == size[j] == 1 else total[i, j] + sum(v - was for was, v in changes)
        top[i, j] = max(top[i, j], *(v for _, v in changes))
        total[j, i], top[j, i] = total[i, j], top[i, j]
    most = max(3, int(len(members) * largest))
    out = []
    for c in _merged(total, top, size.copy()):
        own = sorted(m for i in c for m in parts[i][1])
        if 2 <= len(own) <= most:
            c = sorted(c, key=lambda i: parts[i][1][0])
            i, j = np.triu_indices(len(c), 1)
            i, j = np.array(c, np.int64)[i], np.array(c, np.int64)[j]
            inside = set(c)
            changes = [x for (p, q), found in lifted.items() if p in inside and q in inside for x in found]
            if (size[c] == 1).all() and not changes:
                mean = _mean(one[i, j], None)
            else:
                within = size[c] * (size[c] - 1) // 2
                was, now = np.array(changes, float).reshape(-1, 2).T
                n = np.concatenate([size[i] * size[j], within, np.full(len(was), -1), np.full(len(now), 1)])
                mean = _mean(np.concatenate([one[i, j], one[c, c], was, now]), n)
            if mean >= COHESION:
                out.append((own, mean))
    return sorted(out)


def average_link(members: DataFrame, pairs: DataFrame, group: str, member: str, largest: float = LARGEST, copy_of: str | None = None, more: DataFrame | None = None) -> DataFrame:
    """(group, cluster, member, cohesion); cluster is its least member. pairs: (group, a, b, affinity), a < b.

    With ``copy_of``, a column of ``members`` with the class of each, pairs are of classes, and a = b those of the members of one class.
    ``more``: (group, a, b, affinity) of pairs of members, added to theirs, each pair once.
    """
    kind, key = members.schema[member].dataType.simpleString(), members.schema[group].dataType.simpleString()
    own = members.where(F.col(member).isNotNull()).select(group, F.col(member).alias("a"), F.col(copy_of or member).alias("b"), F.lit(None).cast("double").alias("affinity"), F.lit(False).alias("more"))
    rows = own.unionByName(pairs.where("affinity is not null").select(group, "a", "b", "affinity", F.lit(False).alias("more")))
    if more is not None:
        rows = rows.unionByName(more.where("affinity is not null").select(group, "a", "b", "affinity", F.lit(True).alias("more")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf.affinity.isna()], pdf[pdf.affinity.notna()]
        table = lambda x: dict(zip(zip(x.a.tolist(), x.b.tolist(), strict=True), x.affinity.tolist(), strict=True))
        found = agglomerate(own.a.tolist(), table(links[~links.more]), largest, dict(zip(own.a.tolist(), own.b.tolist(), strict=True)), table(links[links.more]))
        out = [(pdf[group].iloc[0], c[0], m, mean) for c, mean in found for m in c]
        return pd.DataFrame(out, columns=[group, "cluster", "member", "cohesion"])

    return rows.groupBy(group).applyInPandas(run, f"{group} {key}, cluster {kind}, member {kind}, cohesion double")
