"""Suffix dedup by bucket-pointer refinement (operator 6).

Removed is each byte covered by a string of ``length`` bytes that starts anywhere else as well. Bucket-pointer
refinement puts suffixes into buckets by their first q bytes and refines a bucket by the bucket identifiers
that its members have at later offsets; refined identifiers serve all further refinements, so the depth to
which suffixes are told apart doubles each time. Suffixes alone in their bucket are done.

An identifier is a name (a 64-bit hash) instead of a rank, as only equality matters here and names are the same
on all machines: the bucket of depth 8 is the first 8 bytes themselves, and the bucket of depth d + k is the
name of the pair of buckets of depth d at offsets 0 and k <= d (:class:`Buckets`). Sorting a bucket's members
on the identifiers at later offsets is Spark's exchange and aggregation by them. Depth stops at ``length``.

Not all suffixes are refined one by one:

1. Of each window of ``length`` bytes the leftmost suffix of least bucket at depth q is its anchor: equal windows
   have equal anchors, and there are about 2 / (length - q + 2) anchors a byte. Anchors alone in their bucket
   are dropped with all their windows.
2. The windows of the anchors that are left are refined in groups of neighbouring offsets, of ``widths[0]`` first.
   A group's core (the bytes that all its windows share) is refined by the identifiers further on to its union
   (the bytes that any of them has). Groups alone in their core's bucket are done, none of their windows is
   repeated. Groups with a union that another one has are done, all are; one of them goes on for the others.
3. What is left (where repeated passages end) is cut into groups of the next width and refined again, down to
   single windows, whose core and union are the window.

From step 2 on only texts with repeated anchors are looked at; cores, unions and windows of a text share its
identifiers. Windows are told apart by 128 bits. Equal texts go through the steps once; a text held by several
rows is repeated as a whole. No bucket is gathered: steps are aggregations with partial results and joins back,
each with an exchange of its own, so that Spark can split a hot bucket.

Results for odd input: null texts are empty texts; texts shorter than ``length`` are repeated nowhere; ids may
be null or repeat (each row counts as a document); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, store, whole

LENGTH = 400
Q = 200
#: Neighbouring windows that are refined together, from round to round.
WIDTHS = (25, 5, 1)
#: Windows looked at at once; bounds the memory that a long text takes.
CHUNK = 1 << 20
POS_BITS = np.uint64(24)

#: Bytes of the first buckets, which are named by themselves.
FIRST = 8
MIX = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9), (0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class Buckets:
    """Bucket identifiers of all suffixes of some bytes (at least FIRST), by depth; each depth is refined once and reused."""

    def __init__(self, raw: np.ndarray, seed: int = 0):
        self.mix = [np.uint64(x) for x in MIX[seed]]
        first = np.lib.stride_tricks.as_strided(np.ascontiguousarray(raw).view(np.uint8), (len(raw) - FIRST + 1, FIRST), (1, 1))
        self.at_depth = {FIRST: np.ascontiguousarray(first).view("<u8").ravel()}

    def _named(self, own: np.ndarray, later: np.ndarray) -> np.ndarray:
        """Names of pairs of identifiers."""
        x, y, z = self.mix
        name = own * x
        name ^= name >> np.uint64(32)
        name += later * y
        name ^= name >> np.uint64(29)
        name *= z
        name ^= name >> np.uint64(32)
        return name

    def refined(self, depth: int) -> np.ndarray:
        """Identifiers of the suffixes' first ``depth`` bytes: a refinement by those at a later offset."""
        if depth not in self.at_depth:
            half = FIRST
            while 2 * half < depth:
                half *= 2
            ids = self.refined(half)
            self.at_depth[depth] = self._named(ids[: len(ids) - (depth - half)], ids[depth - half :])
            for d in [d for d in self.at_depth if d < half]:  # no further refinement goes back to those
                del self.at_depth[d]
        return self.at_depth[depth]

    def union(self, start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """Identifiers of the bytes from ``start`` to ``depth`` bytes after ``end``, which is less than ``depth`` further on."""
        ids = self.refined(depth)
        return np.where(start == end, ids[start], self._named(ids[start], ids[end]))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours (two passes of running minima in blocks of w)."""
    n = len(x) - w + 1
    pad = -len(x) % w
    grid = np.concatenate([x, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, position, first window start, last window start) of each anchor, in order."""
    out = []
    for lo in range(0, max(len(raw) - length + 1, 0), CHUNK):
        part = raw[lo : lo + CHUNK + length - 1]
        gram = Buckets(part).refined(q)
        at = np.arange(len(gram))
        key = gram & ~np.uint64((1 << int(POS_BITS)) - 1) | at.astype(np.uint64)  # least hash, then leftmost
        own = (_sliding_min(key, length - q + 1) & np.uint64((1 << int(POS_BITS)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(own) - 1]])
        out.append((gram[own[first]], own[first] + lo, first + lo, last + lo))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].alias("id"), whole(text_col).alias("text"))
    return rows.withColumns({"th1": F.xxhash64(F.lit(1), "text"), "th2": F.xxhash64(F.lit(2), "text")})


def _anchor_table(keyed: DataFrame, length: int, q: int) -> DataFrame:
    """(th1, th2, rep, n, gram, mark) of each distinct text long enough; arrays run over its anchors.

    A mark packs an anchor's position with its least and greatest offset in its windows.
    """

    def run(batches):
        for batch in batches:
            got = [anchors(np.frombuffer(t.encode(), np.uint8), length, q) for t in batch.column("text").to_pylist()]
            gram = [g.view(np.int64) for g, *_ in got]
            mark = [at << 24 | (at - hi) << 12 | (at - lo) for _, at, lo, hi in got]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("th1", "th2", "id")], _lists(gram, pa.int64()), _lists(mark, pa.int64())], ["th1", "th2", "id", "gram", "mark"])

    kind = keyed.schema["id"].dataType.simpleString()
    rows = keyed.where(F.octet_length("text") >= length).select("th1", "th2", "id", "text").mapInArrow(run, f"th1 long, th2 long, id {kind}, gram array<long>, mark array<long>")
    return store(rows.groupBy("th1", "th2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("gram").alias("gram"), F.first("mark").alias("mark")), "anchors")


def _texts(keyed: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(th1, th2, text) of the texts with repeated anchors, and (th1, th2, groups) of those anchors' windows, stored."""
    marks = table.select("th1", "th2", F.explode(F.arrays_zip("gram", "mark")).alias("m")).select("th1", "th2", "m.gram", "m.mark")
    grams = store(marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    least, most = F.shiftright("mark", 12).bitwiseAND(4095).cast("int"), F.col("mark").bitwiseAND(4095).cast("int")
    group = F.struct(F.shiftright("mark", 24).cast("int").alias("at"), least.alias("a"), most.alias("b"))
    live = store(marks.join(grams, "gram", "left_semi").groupBy("th1", "th2").agg(F.collect_list(group).alias("groups")), "live")
    named = live.select("th1", "th2").join(table.select("th1", "th2", "rep"), ["th1", "th2"]).withColumnsRenamed({"th1": "t1", "th2": "t2"})
    # the representative's id is part of the key, so copies of a text do not meet in one task
    own = keyed.join(named, [F.col("id").eqNullSafe(F.col("rep")), F.col("th1") == F.col("t1"), F.col("th2") == F.col("t2")])
    texts = store(own.select("th1", "th2", "text").dropDuplicates(["th1", "th2"]), "texts")
    drop(grams)
    return texts, live


def _members(texts: DataFrame, groups: DataFrame, length: int, width: int) -> DataFrame:
    """(th1, th2, at, a, b, t, core, u1, u2): group t of ``width`` offsets has its windows a to b before anchor ``at``. groups: (th1, th2, groups)."""

    def named(raw: np.ndarray, at: np.ndarray, o1: np.ndarray, o2: np.ndarray) -> list[np.ndarray]:
        one, two = (Buckets(raw, seed) for seed in (0, 1))
        n = o2 // width - o1 // width + 1
        own = np.repeat(np.arange(len(at)), n)
        t = o1[own] // width + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        a, b, at = np.maximum(t * width, o1[own]), np.minimum(t * width + width - 1, o2[own]), at[own]
        core = one.refined(length - width + 1)[at - t * width]
        # the offsets that the group has of its anchor are part of the union's identity
        u1, u2 = (x.union(at - b, at - a, length) ^ (a * 4096 + b).astype(np.uint64) for x in (one, two))
        return [at, a, b, t, core, u1, u2]

    def run(batches):
        for batch in batches:
            for th1, th2, text, held in zip(*[batch.column(c).to_pylist() for c in ("th1", "th2", "text", "groups")], strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                at, o1, o2 = np.array([(g["at"], g["a"], g["b"]) for g in held], np.int64).T
                for c in np.unique(at // CHUNK):
                    mine, lo = at // CHUNK == c, max(0, int(c) * CHUNK - length)
                    x = named(raw[lo : (int(c) + 1) * CHUNK + 2 * length], at[mine] - lo, o1[mine], o2[mine])
                    x[0] += lo
                    m = len(x[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, th1)), pa.array(np.full(m, th2)), *[pa.array(y, pa.int32()) for y in x[:4]], *[pa.array(y.view(np.int64)) for y in x[4:]]],
                        ["th1", "th2", "at", "a", "b", "t", "core", "u1", "u2"],
                    )

    return store(texts.join(groups, ["th1", "th2"]).mapInArrow(run, "th1 long, th2 long, at int, a int, b int, t int, core long, u1 long, u2 long"), "members")


def repeated(docs: DataFrame, length: int = LENGTH, q: int = Q, widths: tuple[int, ...] = WIDTHS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((th1, th2) of the texts that several rows hold, (th1, th2, text, spans) of those that hold repeated strings).

    Spans are structs [s, e) in order; they may touch and overlap.
    """
    if length - q >= 4096 or widths[0] > length - q or widths[-1] != 1 or q < FIRST:
        raise ValueError(f"q must be at least {FIRST}, length - q lie between the first width and 4095, the last width be 1")
    keyed = _keyed(docs, id_col, text_col)
    table = _anchor_table(keyed, length, q)
    copied = store(table.where("n > 1").select("th1", "th2"), "copied")
    texts, groups = _texts(keyed, table)
    drop(table)
    found = []
    for width in widths:
        members = _members(texts, groups, length, width)
        drop(groups)
        unions = store(members.groupBy("t", "core", "u1", "u2").agg(F.count("*").alias("n"), F.min(F.struct("th1", "th2", "at", "a", "b")).alias("rep")), "unions")
        same = members.join(unions.where("n > 1").select("t", "core", "u1", "u2"), ["t", "core", "u1", "u2"], "left_semi")
        found.append(store(same.select("th1", "th2", F.struct((F.col("at") - F.col("b")).alias("s"), (F.col("at") - F.col("a") + length).alias("e")).alias("span")), "spans"))
        drop(members)
        if width > 1:
            mixed = store(unions.groupBy("t", "core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("t", "core"), "mixed")
            left = unions.join(mixed, ["t", "core"], "left_semi").select("rep.*")
            groups = store(left.groupBy("th1", "th2").agg(F.collect_list(F.struct("at", "a", "b")).alias("groups")), "groups")
            drop(mixed)
        drop(unions)
    spans = reduce(DataFrame.unionByName, found).groupBy("th1", "th2").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    out = store(texts.join(spans, ["th1", "th2"]), "spans")
    drop(texts, *found)
    return copied, out


def cut(docs: DataFrame, length: int = LENGTH, q: int = Q, widths: tuple[int, ...] = WIDTHS, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_bytes`` the remaining bytes as ``kept``)."""

    def run(batches):
        for batch in batches:
            removed, count, sha, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, runs = text.encode(), []
                for s in spans:
                    if runs and s["s"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["e"])
                    else:
                        runs.append([s["s"], s["e"]])
                cuts = [0, *[x for r in runs for x in r], len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                removed.append(len(raw) - len(rest))
                count.append(len(runs))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_bytes else None)
            yield pa.RecordBatch.from_arrays([batch.column("th1"), batch.column("th2"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["th1", "th2", "removed", "spans", "sha", "kept"])

    copied, found = repeated(docs, length, q, widths, id_col, text_col)
    # one row a text: a text that several rows hold goes as a whole, whatever its spans
    some = found.join(copied, ["th1", "th2"], "left_anti").mapInArrow(run, "th1 long, th2 long, removed long, spans long, sha string, kept binary")
    empty = hashlib.sha256(b"").hexdigest()
    all_ = copied.select("th1", "th2", F.lit(-1).cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(empty).alias("sha"), F.lit(b"").alias("kept"))
    cuts = store(some.unionByName(all_), "cuts")
    drop(copied, found)
    size = F.octet_length("text").cast("long")
    rows = _keyed(docs, id_col, text_col).select("id", "th1", "th2", size.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own"), *[F.col("text").cast("binary").alias("raw")] * with_bytes)
    rows = rows.join(cuts, ["th1", "th2"], "left")
    removed = F.when(F.col("removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0)))
    out = [F.col("id").alias(id_col), "n_bytes", removed.alias("n_removed"), F.coalesce("spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256")]
    return rows.select(*out, *[F.coalesce("kept", "raw").alias("kept")] * with_bytes)
