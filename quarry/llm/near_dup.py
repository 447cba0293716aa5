"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles (operator 7).

Shingles are runs of ``SHINGLE`` words (a shorter text is one shingle); a shingle's weight is its count in
the text times the mean idf of its words. Document frequencies of words are counted over all texts in
``2**DF_BITS`` hashed counters: the table has the same size whatever the data, and what other words add to
a counter is a share of the texts that does not grow with them.

Equal texts form a class. Each class has ``BANDS * ROWS`` consistent weighted samples; classes that share a
band meet in a bucket. A bucket compares its members with a pivot, the member with the most bucket mates
(for copies of one original that is the original); pairs are verified by exact weighted Jaccard similarity
over the whole texts. After two rounds of pivots, each member that has not met all members of its bucket in
other components (the second pivot, those that joined it, and lone open ones as well) meets them, unless their sample sketches or a bound rule it out: shingles that no other
text of these buckets has are in no intersection, so a text with own weight u of W shares at most W - u with
any other. No bucket has a cap, and only pairs that could join components are ever emitted.

Results for odd input: null texts and texts without a word link with nothing; rows with null id link with
nothing and are kept; repeated rows share their class (all rows of the kept id are kept); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, slices, store
from quarry.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 14
ROWS = 4
DF_BITS = 16
MEMO = 250_000
BLOCK = 16_000
WORD = re.compile(r"\w+")
#: A pair with true similarity THRESHOLD shares fewer of its 56 sampled bytes with a probability below 1e-5.
SKETCH_MIN = 0.55


class Shingles:
    """Distinct shingle hashes and weights of a text."""

    def __init__(self, idf: np.ndarray | None):
        self.idf, self.memo = idf, {}
        rng = np.random.default_rng(5)
        self.mult = rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words in order."""
        return self._hashed(WORD.findall(text.lower()))

    def vocabulary(self, text: str) -> np.ndarray:
        """Hashes of the distinct words."""
        return self._hashed(set(WORD.findall(text.lower())))

    def _hashed(self, words: list[str] | set[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            raw = w.encode()
            memo[w] = (zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x9E3779B9)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def bucket(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - DF_BITS)).astype(np.int64)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        w = self.words(text)
        if not len(w):
            return np.zeros(0, np.uint64), np.zeros(0)
        idf = self.idf[self.bucket(w)]
        k = min(SHINGLE, len(w))
        n = len(w) - k + 1
        h, weight = np.zeros(n, np.uint64), np.zeros(n)
        for i in range(k):
            x = w[i : i + n] * self.mult[i]
            h += x ^ (x >> np.uint64(29))
            weight += idf[i : i + n]
        ids, first, count = np.unique(h, return_index=True, return_counts=True)
        return ids, weight[first] / k * count


def idf_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """idf of each hashed word counter: log((1 + texts) / (1 + texts with a word of the counter)) + 0.1."""

    def count(batches):
        make, held, n = Shingles(None), np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held[np.unique(make.bucket(make.vocabulary(text)))] += 1
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["n", "held"])

    def add(batches):
        held, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += np.frombuffer(raw, np.int64)
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["n", "held"])

    sums = docs.select(text_col).mapInArrow(count, "n long, held binary")
    # tables of one fixed size, summed in two levels; 16 of them come to the driver
    rows = sums.repartition(256).mapInArrow(add, "n long, held binary").repartition(16).mapInArrow(add, "n long, held binary").collect()
    n = sum(r["n"] for r in rows)
    held = sum((np.frombuffer(r["held"], np.int64) for r in rows), np.zeros(1 << DF_BITS, np.int64))
    return np.log((1 + n) / (1 + held)) + 0.1


class Sampler:
    """Improved consistent weighted sampling. The random draws of a shingle for hash k come from pools, picked by its mixed hash."""

    POOL = 12

    def __init__(self):
        rng = np.random.default_rng(3)
        size = 1 << self.POOL
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.inv = (1 / self.r).astype(np.float32)
        self.lnc = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.seed = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

    def __call__(self, ids: np.ndarray, weights: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """uint32 samples, one row per text; texts are ids[ptr[i]:ptr[i + 1]], none of them empty.

        All steps write into the same few arrays, which stay in the processor's cache for up to about BLOCK shingles.
        """
        n, low, at = len(ids), np.uint64((1 << self.POOL) - 1), ptr[:-1]
        lns = np.log(weights).astype(np.float32)
        out = np.empty((len(at), BANDS * ROWS), np.uint32)
        h, x = np.empty(n, np.uint64), np.empty(n, np.uint64)
        pick, high = x.view(np.int64), h.view("<u4")[1::2]
        a, b, c, t = (np.empty(n, np.float32) for _ in range(4))
        sign, step, key = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, "<i8")
        order, name, steps = key.view("<i4")[1::2], key.view("<u4")[::2], step.view(np.uint32)

        def mixed(shift: int) -> None:
            np.right_shift(h, np.uint64(shift), out=x)
            np.bitwise_xor(h, x, out=h)

        def drawn(shift: int) -> None:
            np.right_shift(h, np.uint64(shift), out=x)
            np.bitwise_and(x, low, out=x)

        for k, seed in enumerate(self.seed):
            np.multiply(ids, seed, out=h)
            mixed(32)
            np.multiply(h, np.uint64(0xD6E8FEB86659FD93), out=h)
            mixed(29)
            drawn(0)
            np.take(self.inv, pick, out=t, mode="clip")
            np.take(self.r, pick, out=a, mode="clip")
            drawn(self.POOL)
            np.take(self.lnc, pick, out=b, mode="clip")
            drawn(2 * self.POOL)
            np.take(self.beta, pick, out=c, mode="clip")
            np.multiply(lns, t, out=t)
            np.add(t, c, out=t)
            np.floor(t, out=t)
            np.subtract(t, c, out=c)
            np.add(c, np.float32(1), out=c)
            np.multiply(a, c, out=a)
            np.subtract(b, a, out=b)  # ln a = ln c - r (t - beta + 1)
            # as integers in the same order: the bits of a negative one but for its sign are turned
            bits = b.view(np.int32)
            np.right_shift(bits, 31, out=sign)
            np.bitwise_and(sign, 0x7FFFFFFF, out=sign)
            np.bitwise_xor(bits, sign, out=order)
            step[:] = t
            np.multiply(steps, np.uint32(0x9E3779B1), out=steps)
            np.add(steps, high, out=name)
            out[:, k] = np.minimum.reduceat(key, at).astype(np.uint32)
        return out


def _bands(samples: np.ndarray) -> np.ndarray:
    """int64 bucket keys, one column per band."""
    s = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(samples), BANDS)).copy()
    for i in range(ROWS):
        h = (h ^ s[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col("text")
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumns({"th1": F.xxhash64(F.lit(1), text), "th2": F.xxhash64(F.lit(2), text)})


def signatures(docs: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """(id, th1, th2, bands, sketch) of every row with a word and an id, stored; narrow."""

    def run(batches):
        make, sample = Shingles(idf.value), Sampler()
        for batch in slices(batches, 2048):
            texts = batch.column("text").to_pylist()
            bands, sketch, at = [], [], []
            held, held_at, size = [], [], 0
            for k in range(len(texts) + 1):
                if k < len(texts):
                    got = make(texts[k])
                    if len(got[0]):
                        held.append(got)
                        held_at.append(k)
                        size += len(got[0])
                if held and (size > BLOCK or k == len(texts)):
                    ptr = np.concatenate([[0], np.cumsum([len(i) for i, _ in held])])
                    s = sample(np.concatenate([i for i, _ in held]), np.concatenate([w for _, w in held]), ptr)
                    bands.append(_bands(s))
                    sketch += [x.tobytes() for x in s.astype(np.uint8)]
                    at += held_at
                    held, held_at, size = [], [], 0
            keys = np.concatenate(bands) if bands else np.zeros((0, BANDS), np.int64)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(rows) for c in ("id", "th1", "th2")], pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())), pa.array(sketch, pa.binary())],
                ["id", "th1", "th2", "bands", "sketch"],
            )

    rows = _keyed(docs, id_col, text_col).where("id is not null and text is not null").select("id", "th1", "th2", "text")
    return store(rows.mapInArrow(run, "id long, th1 long, th2 long, bands array<long>, sketch binary"), "signatures")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least) if len(common) else 0.0


def verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the threshold. texts: (cid, text)."""

    def run(batches):
        make, memo = Shingles(idf.value), {}
        for batch in slices(batches):
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if a not in memo:
                    if len(memo) > 64:
                        memo.clear()
                    memo[a] = make(ta)
                keep.append(weighted_jaccard(memo[a], make(tb)) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _stars(tied: DataFrame) -> DataFrame:
    return tied.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _placed(members: DataFrame, tied: DataFrame) -> DataFrame:
    """``members`` with comp, the component of each (itself where it links with nothing)."""
    return members.join(tied.withColumnsRenamed({"node": "cid", "component": "comp"}), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _outside(members: DataFrame, pivot: DataFrame, tied: DataFrame) -> DataFrame:
    """The members outside the component of their bucket's pivot, with comp and first, the pivot's component."""
    piv = _placed(pivot.withColumnRenamed("pivot", "cid"), tied).select("key", F.col("comp").alias("first"))
    return _placed(members, tied).join(piv, "key").where("comp <> first")


def _unmet(mates: DataFrame, outside: DataFrame, pivot: DataFrame, tied: DataFrame) -> DataFrame:
    """(key, cid) of ``outside`` that have not met all members of their bucket in other components.

    All of them have met the first pivot and, where there is one, the second; that one has met all but members
    of the first pivot's component.
    """
    outside = store(outside.select("key", "cid", "comp", "first"), "outside")
    held = _placed(mates.join(outside.select("key").distinct(), "key", "left_semi"), tied).groupBy("key", "comp").agg(F.count("*").alias("n"))
    held = store(held, "held")
    total = held.groupBy("key").agg(F.sum("n").alias("total"))
    second = _placed(pivot.withColumnRenamed("pivot", "cid"), tied).select("key", F.col("cid").alias("pivot"), F.col("comp").alias("second"))
    rows = outside.join(held, ["key", "comp"]).join(held.select("key", F.col("comp").alias("first"), F.col("n").alias("n_first")), ["key", "first"])
    rows = rows.join(total, "key").join(second, "key", "left")
    both = F.coalesce((F.col("second") != F.col("comp")).cast("int"), F.lit(0))
    left = F.when(F.col("cid") == F.col("pivot"), F.col("n_first") - 1).otherwise(F.col("total") - F.col("n") - 1 - both)
    return rows.where(left > 0).select("key", "cid")


def _bounds(texts: DataFrame, idf) -> DataFrame:
    """(cid, total, own): weight of each text's shingles, and of those that no other of these texts has."""

    def run(batches):
        make = Shingles(idf.value)
        for batch in batches:
            for cid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, w = make(text)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cid)), pa.array(ids.view(np.int64)), pa.array(w)], ["cid", "h", "w"])

    each = store(texts.select("cid", "text").mapInArrow(run, "cid long, h long, w double"), "shingles")
    alone = each.groupBy("h").agg(F.count("*").alias("n"), F.min("cid").alias("cid"), F.min("w").alias("w")).where("n = 1").groupBy("cid").agg(F.sum("w").alias("own"))
    return store(each.groupBy("cid").agg(F.sum("w").alias("total")).join(alone, "cid", "left").select("cid", "total", F.coalesce("own", F.lit(0.0)).alias("own")), "bounds")


def link(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(th1, th2, component, reps) of every class of texts that links with another text or is held by several rows."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(docs, text_col))
    rows = signatures(docs, idf, id_col, text_col)
    each = rows.groupBy("th1", "th2", "id").agg(F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # reps: rows that repeat the class's least id
    classes = store(each.groupBy("th1", "th2").agg(F.min("id").alias("cid"), F.sum("n").alias("n"), F.min_by("n", "id").alias("reps"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    drop(rows)
    # different texts may share a class's least id where ids repeat; the least text then stands for the id
    member = classes.select("cid", F.explode("bands").alias("key"))
    # stored, so that the joins on keys have exchanges of their own, which Spark can split where a key is hot
    size = store(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    mates = store(member.join(size, "key"), "buckets")
    degree = store(mates.groupBy("cid").agg(F.sum("size").alias("degree")), "degrees")
    mates2 = store(mates.join(degree, "cid").select("key", "cid", "degree"), "buckets")
    drop(mates)
    # the texts of all classes that share a bucket, one row a class
    wanted = degree.select("cid").join(classes.select("cid", "th1", "th2"), "cid")
    keyed = _keyed(docs, id_col, text_col)
    texts = store(keyed.join(wanted, (keyed["id"] == wanted["cid"]) & (keyed["th1"] == wanted["th1"]) & (keyed["th2"] == wanted["th2"])).select("cid", "text").dropDuplicates(["cid"]), "texts")
    open_, tied, pivots, met = mates2, None, [], None
    for _ in range(2):
        pivot = open_.groupBy("key").agg(F.max_by("cid", F.struct("degree", -F.col("cid"))).alias("pivot"), F.count("*").alias("m")).where("m > 1").select("key", "pivot")
        pivot = store(pivot, "pivots")
        pivots.append(pivot)
        pairs = open_.join(pivot, "key").where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
        pairs = store(pairs, "pairs")
        found = verify(pairs, texts, idf, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        # earlier links are passed on as the stars of their components, which settle in fewer rounds
        tied = store(components(found if tied is None else found.unionByName(_stars(tied))), "components")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = pairs if met is None else met.unionByName(pairs)
        if len(pivots) == 1:  # members outside their pivot's component stay open for another pivot
            open_ = store(_outside(open_, pivot, tied).select("key", "cid", "degree"), "open")
    # what joined neither pivot's component, and what joined the second one's, still meets every member of its bucket in another component
    open_ = store(_unmet(mates2, _outside(open_, pivots[0], tied), pivots[1], tied), "open")
    all_ = _placed(mates2, tied).select("key", "cid", "comp")
    all_ = store(all_.join(open_.select("key").distinct(), "key", "left_semi"), "buckets")
    weights = _bounds(texts.join(all_.select("cid").distinct(), "cid", "left_semi"), idf)
    all_ = all_.join(classes.select("cid", "sketch", "bands").join(weights, "cid"), "cid")
    seen = open_.groupBy("cid").agg(F.collect_set("key").alias("keys"))  # BANDS at most
    # alone, a text shares at most 1 - u / W of any union
    left = open_.select("key", "cid").join(all_, ["key", "cid"]).where((F.col("total") - F.col("own")) >= (threshold - 1e-9) * F.col("total"))
    left = left.join(seen, "cid").select("key", *[F.col(c).alias(f"{c}_a") for c in ("cid", "comp", "sketch", "total", "own", "keys")])
    right = all_.select("key", *[F.col(c).alias(f"{c}_b") for c in ("cid", "comp", "sketch", "total", "own", "bands")])
    once = F.array_min(F.array_intersect("keys_a", "bands_b")) == left["key"]  # a pair is made in one of its buckets only
    same = sum((F.substring("sketch_a", i + 1, 1) == F.substring("sketch_b", i + 1, 1)).cast("int") for i in range(BANDS * ROWS))
    most = F.least(F.col("total_a") - F.col("own_a"), F.col("total_b") - F.col("own_b"))
    could = most >= (threshold - 1e-9) * (F.col("total_a") + F.col("total_b") - most)
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("comp_a") != F.col("comp_b")) & could & (same >= int(SKETCH_MIN * BANDS * ROWS)) & once)
    pairs = pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    more = store(verify(pairs, texts, idf, threshold), "links")
    if more.head(1):
        tied = store(components(more.unionByName(_stars(tied))), "components")
    out = classes.select("th1", "th2", "cid", "n", "reps").join(tied.withColumnRenamed("node", "cid"), "cid", "left").where("n > 1 or component is not null")
    return out.select("th1", "th2", F.coalesce("component", "cid").alias("component"), "reps"), [mates2, texts]


def groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id, kept) of every row: component_id is the least id reachable by links."""
    tied, used = link(docs, threshold, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col).select("id", "th1", "th2")
    out = store(keyed.join(tied, ["th1", "th2"], "left").select("id", F.coalesce("component", "id").alias("component_id")), "groups")
    drop(*used)
    return out.select(F.col("id").alias(id_col), "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that of its least id; all columns as they came.

    Rows that repeat the kept id and its text count once; rows with the kept id and another text all stay.
    """
    tied, used = link(docs, threshold, id_col, text_col)
    tied = store(tied.withColumnsRenamed({"th1": "__th1", "th2": "__th2", "component": "__component", "reps": "__reps"}), "groups")
    drop(*used)
    text, own = F.col(text_col), F.col(id_col)
    keyed = docs.withColumns({"__th1": F.xxhash64(F.lit(1), text), "__th2": F.xxhash64(F.lit(2), text)})
    first = F.col("__component").isNull() | own.isNull() | (own.cast("long") == F.col("__component"))
    out = keyed.join(tied, ["__th1", "__th2"], "left").where(first)
    if tied.where("__reps > 1").head(1):
        twice = F.coalesce(F.col("__reps") > 1, F.lit(False)) & own.isNotNull()
        out = out.where(~twice).unionByName(out.where(twice).dropDuplicates(["__th1", "__th2"]))
    return out.select(*docs.columns)
