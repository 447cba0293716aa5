"""Blocked pair search: only rows that share a block key meet."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import jaccard


def block_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: str, right_tokens: str, by: Sequence[str] = (), at_least: int = 2) -> DataFrame:
    """(left_id, right_id, shared): pairs that share ``at_least`` tokens (and ``by``), through an inverted index."""
    a = left.select(*by, F.col(left_id), F.explode(F.array_distinct(left_tokens)).alias("__t"))
    b = right.select(*by, F.col(right_id), F.explode(F.array_distinct(right_tokens)).alias("__t"))
    return a.join(b, [*by, "__t"]).groupBy(left_id, right_id).agg(F.count("*").alias("shared")).where(F.col("shared") >= at_least)


def best_match(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: str, right_tokens: str, at_least: float = 0.0) -> DataFrame:
    """(left_id, right_id, similarity): each left row's most similar partner by Jaccard; ties go to the least id."""
    rows = pairs.join(left.select(left_id, F.col(left_tokens).alias("__a")), left_id).join(right.select(right_id, F.col(right_tokens).alias("__b")), right_id)
    scored = rows.withColumn("similarity", jaccard(F.col("__a"), F.col("__b"))).where(F.col("similarity") >= at_least)
    best = scored.groupBy(left_id).agg(F.min(F.struct((-F.col("similarity")).alias("neg"), F.col(right_id).alias("id"))).alias("best"))
    return best.select(left_id, F.col("best.id").alias(right_id), (-F.col("best.neg")).alias("similarity"))


def pairs_within(df: DataFrame, by: Sequence[str], member: str, carry: Sequence[str], with_self: bool = False) -> DataFrame:
    """All unordered pairs of members of the same (small) group: a, b, and both sides' carried columns; on request a member with itself too."""
    a = df.select(*by, F.col(member).alias("a"), *[F.col(c).alias(f"a_{c}") for c in carry])
    b = df.select(*by, F.col(member).alias("b"), *[F.col(c).alias(f"b_{c}") for c in carry])
    return a.join(b, list(by)).where("a <= b" if with_self else "a < b")


def similarities_within(df: DataFrame, by: Sequence[str], member: str, tokens: str, digits: int, at_once: int = 256, empty: float = 0.0) -> DataFrame:
    """(a, b, similarity) of all unordered pairs of members of the same group: Jaccard of their tokens, rounded; ``empty`` where both are empty.

    Null tokens count as none; the similarity is null where those of ``a`` are null.

    Members with the same tokens are compared with others once, ``at_once`` of them in a row. The ids are sorted: both sides
    of the join are made apart, and rows from a shuffle come to each in another order.
    """
    kinds = df.select(*by, F.col(member).alias("id"), F.col(tokens).alias("w")).groupBy(*by, "w").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("ids"), F.lit(1)), F.lit(at_once))
    rows = kinds.select(*by, "w", "ids", F.explode(starts).alias("part")).withColumn("ids", F.slice("ids", F.col("part"), F.lit(at_once))).where(F.size("ids") > 0)
    rows = rows.withColumn("first", F.col("ids")[0])  # orders rows by itself where ids are unique
    a, b = (rows.select(*by, *[F.col(c).alias(f"{c}_{x}") for c in ("w", "ids", "part", "first")]) for x in "ab")
    full = lambda x: F.struct(f"w_{x}", f"part_{x}")
    ordered = (F.col("first_a") < F.col("first_b")) | ((F.col("first_a") == F.col("first_b")) & (full("a") <= full("b")))
    none = F.array().cast("array<string>")
    own, other = F.coalesce("w_a", none), F.coalesce("w_b", none)
    share = F.when((F.size(own) == 0) & (F.size(other) == 0), F.lit(float(empty))).otherwise(F.round(jaccard(own, other), digits))
    pairs = a.join(b, list(by)).where(ordered).select(
        "ids_a", "ids_b", F.col("w_a").isNull().alias("null_a"), F.col("w_b").isNull().alias("null_b"), share.alias("similarity"), ((F.col("first_a") == F.col("first_b")) & (full("a") == full("b"))).alias("self")
    )
    carry = ("null_a", "null_b", "similarity", "self")
    each = pairs.select(F.explode("ids_a").alias("x"), "ids_b", *carry).select("x", F.explode("ids_b").alias("y"), *carry)
    each = each.where((F.col("x") < F.col("y")) | (~F.col("self") & (F.col("x") != F.col("y"))))
    known = ~F.when(F.col("x") < F.col("y"), F.col("null_a")).otherwise(F.col("null_b"))
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(known, F.col("similarity")).alias("similarity"))


LEAST_SIZE, MOST_SIZE = 0.35, 2.85
#: Pairs and word occurrences that are compared at once.
CELLS, POSTINGS = 1_000_000, 4_000_000


def best_of_group(ids: np.ndarray, words: list[np.ndarray | None], size: np.ndarray, empty: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(best, rank) of each row: the id, other than its own, of the most similar row of similar size (-1: none), and its similarity.

    Rank is 2 for NaN and -1 for null words of the row itself. Rows of the same words and size are one kind; two ids of
    each are enough, as a row leaves out only its own. Where all sizes are similar, they make no kinds.
    """
    if size.min() / size.max() >= LEAST_SIZE and size.max() / size.min() <= MOST_SIZE:
        size = np.ones(len(size))
    families: dict = {}
    family = np.array([families.setdefault(None if w is None else w.tobytes(), len(families)) for w in words])
    sets: list = [None] * len(families)
    for f, w in zip(family.tolist(), words, strict=True):
        sets[f] = w
    null = np.array([w is None for w in sets])
    n = np.array([0 if w is None else len(w) for w in sets])
    order = np.lexsort((ids, size, family))
    new = np.append(True, (family[order][1:] != family[order][:-1]) | (size[order][1:] != size[order][:-1]))
    kind = np.empty(len(ids), np.int64)
    kind[order] = np.cumsum(new) - 1
    other = np.append(True, new[1:] | (ids[order][1:] != ids[order][:-1]))  # each id once in a kind
    at, own = ids[order][other], np.flatnonzero(new[other])
    many = np.diff(np.append(own, len(at))) > 1
    first, second = at[own], np.where(many, at[np.minimum(own + 1, len(at) - 1)], -1)
    of, s = family[order][new], size[order][new]
    # columns in order of their least id, so that the first of equal ones wins
    col = np.argsort(first, kind="stable")
    lo, hi, of_col, s_col = first[col], second[col], of[col], s[col]
    repeated = bool((lo[1:] == lo[:-1]).any())
    code = np.concatenate([w for w in sets if w is not None and len(w)] or [np.empty(0, np.int64)])
    holder = np.repeat(np.arange(len(sets)), n)
    by_word = np.argsort(code, kind="stable")
    held, count = holder[by_word], np.bincount(code)
    start = np.cumsum(count) - count
    begin = np.cumsum(n) - n
    work = np.bincount(holder, weights=count[code], minlength=len(sets)) if len(code) else np.zeros(len(sets))
    step = int(max(1, min(CELLS // len(of), POSTINGS // max(1, work.max()))))
    partner, rank, next_partner, next_rank = (np.full(len(of), v) for v in (-1, -2.0, -1, -2.0))
    for x in range(0, len(of), step):  # kinds are in order of their families
        rows = np.arange(x, min(x + step, len(of)))
        f, row = np.unique(of[rows], return_inverse=True)
        w = np.concatenate([code[begin[i] : begin[i] + n[i]] for i in f])
        k = count[w]
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[w], k)
        shared = np.bincount(np.repeat(np.repeat(np.arange(len(f)), n[f]), k) * len(sets) + held[j], minlength=len(f) * len(sets)).reshape(len(f), -1)
        union = n[f][:, None] + n[None, :] - shared
        sim = np.where(union > 0, shared / np.maximum(union, 1), 2.0 if empty != empty else empty)
        sim[null[f]] = -1.0
        r = sim[:, of_col][row]
        if s_col[0] != 1.0 or (s_col != 1.0).any():
            share = s[rows][:, None] / s_col[None, :]
            r[(share < LEAST_SIZE) | (share > MOST_SIZE)] = -2.0
        i, line = r.argmax(1), np.arange(len(rows))
        partner[rows], rank[rows] = lo[i], r[line, i]
        if repeated:  # an id may be the least of several kinds
            b, low = np.full(len(rows), -2.0), np.full(len(rows), -1)
            for y in line:
                same = np.arange(np.searchsorted(lo, lo[i[y]]), np.searchsorted(lo, lo[i[y]], "right"))
                left = same[hi[same] >= 0]
                if len(left):
                    z = left[np.lexsort((hi[left], -r[y, left]))[0]]
                    b[y], low[y] = r[y, z], hi[z]
                r[y, same] = -2.0
        else:
            low = hi[i]
            b = np.where(low >= 0, r[line, i], -2.0)
            r[line, i] = -2.0
        i = r.argmax(1)
        a, up = r[line, i], lo[i]
        mine = (b > a) | ((b == a) & (low < up))
        next_partner[rows], next_rank[rows] = np.where(mine, low, up), np.where(mine, b, a)
    itself = ids == partner[kind]
    best, value = np.where(itself, next_partner[kind], partner[kind]), np.where(itself, next_rank[kind], rank[kind])
    return np.where(value > -2.0, best, -1), value


def best_within(df: DataFrame, by: Sequence[str], member: str, tokens: str, size: str, empty: float = 0.0) -> DataFrame:
    """(a, b, similarity): each member's most similar other member of its group with a similar size, by Jaccard of their tokens; ties go to the least.

    A group is one call of ``best_of_group``. ``empty`` is the similarity of two empty sets, greatest of all if NaN. Null
    tokens count as none; the similarity is null where those of ``a`` are null, and the least member is taken.
    """
    by = list(by)
    rows = df.where(F.col(member).isNotNull() & (F.col(size) > 0) & ~F.isnan(size) & (F.col(size) < float("inf"))).dropna(subset=by)
    rows = rows.select(*by, F.col(tokens).alias("w"), F.col(size).cast("double").alias("size"), F.col(member).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        names = pc.unique(t["id"]).take(pc.sort_indices(pc.unique(t["id"])))
        ids = pc.index_in(t["id"], names).to_numpy().astype(np.int64)
        lists = t["w"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64).tolist()
        code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = [code[i:j] if ok else None for i, j, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
        best, rank = best_of_group(ids, words, t["size"].to_numpy(), empty)
        found = np.flatnonzero(best >= 0)
        best, rank = best[found], rank[found]
        value = pa.array(np.where(rank == 2.0, np.nan, rank), pa.float64(), mask=rank == -1.0)
        return pa.table({"a": t["id"].take(found), "b": names.take(best), "neg": -rank, "similarity": value})

    found = rows.groupBy(*by).applyInArrow(run, f"a {kind}, b {kind}, neg double, similarity double")
    found = found.groupBy("a").agg(F.min(F.struct("neg", "b", "similarity")).alias("m"))  # ids may repeat
    return found.select("a", F.col("m.b").alias("b"), F.col("m.similarity").alias("similarity"))


def similar_size(a: Column, b: Column) -> Column:
    return (a > 0) & (b > 0) & (a / b).between(LEAST_SIZE, MOST_SIZE)
