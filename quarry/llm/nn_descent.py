"""Embedding near-dedup by NN-descent (operator 3).

Equal vectors form one node. The neighbour graph starts from neighbours in several orders by random
hyperplane codes and is refined by local joins: the neighbours of a node, forward and reverse, are compared
with each other, and a pair replaces the worst neighbour of either end if it is closer. Rounds go on until
no list gains a pair above the threshold. Lists hold ``k`` neighbours; a node whose list is full of pairs
above the threshold is saturated. The lists of saturated nodes are enlarged ``GROWTH`` times and, with the pairs of
the orders once more, refined again, up to ``widest`` neighbours. A pair that local joins discard has two saturated
ends, so nodes that are still saturated then are compared across the components that result, in blocks, and
components that link are merged. Recall is audited against brute force for up to ``audit`` nodes, as the mean of the nodes' own
shares; below ``recall`` all lists start from twice the size, and where that does not help either after
``tries`` times, all nodes are compared across components in blocks, which misses nothing.

Links are then counted within components, in double precision. Two vectors at angles p and q to a centre of
their component are surely linked if p + q is no more than the threshold's angle, and surely not if p and q
differ by more; components are cut into shells by that angle, and only pairs of shells of which neither holds
are compared, in blocks. Copies with some noise thus cost a count however many they are.

Nodes' lists are bounded; top-k filters run before the shuffles; nothing but the audit's nodes is broadcast.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components, and rows
with null id, link with nothing (component: themselves); vectors of different lengths never link; equal
vectors link with each other; repeated ids count as so many vectors; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import drop, store
from quarry.llm.graph import components

THRESHOLD = 0.95
K = 8
WIDEST = 32
GROWTH = 4
TRIES = 2
ORDERS = 12
NEXT = 3
#: Single-precision products this far below the threshold are looked at again in double precision.
SLACK = 1e-4
BLOCK = 512
#: Saturated nodes in a block of the search across components.
WIDE_BLOCK = 2048
#: Shells within the threshold's angle; angles this close to a bound are looked at pair by pair.
SHELLS = 8
MARGIN = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of float32."""
    n = len(column)
    if not n:
        return np.zeros((0, 1), np.float32)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(n, -1)


def nodes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(node, n, vec) of each distinct usable vector, stored; node is its least id."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    good = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return store(rows.where(good).groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("n")), "nodes")


def _units(table: DataFrame) -> DataFrame:
    """(node, unit: float32 bytes, c0.. codes)."""

    def run(batches):
        for batch in batches:
            vecs = batch.column("vec")
            x = vecs.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            x = x / np.abs(x).max(axis=1, keepdims=True)  # against over- and underflow
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = []
            for t in range(ORDERS):
                planes = np.random.default_rng(100 + t).normal(size=(x.shape[1], 60))
                codes.append(pa.array((x @ planes > 0) @ (np.int64(1) << np.arange(60, dtype=np.int64)[::-1])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), *codes], ["node", "unit", *[f"c{t}" for t in range(ORDERS)]])

    return store(table.select("node", "vec").mapInArrow(run, "node long, unit binary, " + ", ".join(f"c{t} long" for t in range(ORDERS))), "units")


EDGES = "u long, v long, sim float"


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float32())], ["u", "v", "sim"])


def _start(units: DataFrame) -> DataFrame:
    """Each node with the ``NEXT`` ones after it in each order; one shuffle, dealt evenly whatever the codes."""

    def run(batches):
        t, ids, x = np.zeros(0, np.int32), np.zeros(0, np.int64), None
        for batch in batches:
            y = _matrix(batch.column("unit"))
            t, ids = np.concatenate([t[-NEXT:], batch.column("t").to_numpy()]), np.concatenate([ids[-NEXT:], batch.column("node").to_numpy()])
            x = y if x is None else np.concatenate([x[-NEXT:], y])
            for j in range(1, NEXT + 1):
                if len(ids) > j:
                    same = t[:-j] == t[j:]
                    a, b, sim = ids[:-j][same], ids[j:][same], np.einsum("ij,ij->i", x[:-j], x[j:])[same]
                    yield _edges(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim]))

    orders = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"c{t}").alias("code")) for t in range(ORDERS)]))
    rows = units.select("node", "unit", orders.alias("o")).select("o.t", "o.code", "node", "unit")
    return rows.repartitionByRange("t", "code", "node").sortWithinPartitions("t", "code", "node").select("t", "node", "unit").mapInArrow(run, EDGES)


def _top(edges: DataFrame, k: int, wide: DataFrame | None = None, most: int = 0) -> DataFrame:
    """The closest neighbours of each node: k, or what ``wide`` (u, room) says, ``most`` at most; Spark limits the groups before the shuffle as well."""
    return _closest(edges.groupBy("u", "v").agg(F.max("sim").alias("sim")), k, wide, most)


def _closest(best: DataFrame, k: int, wide: DataFrame | None, most: int) -> DataFrame:
    """``_top`` of pairs that are distinct already."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    out = best.withColumn("rank", rank).where(F.col("rank") <= max(k, most))
    if wide is not None:
        out = out.join(wide, "u", "left").where(F.col("rank") <= F.coalesce("room", F.lit(k))).drop("room")
    return out.drop("rank")


def _room(graph: DataFrame, k: int, wide: DataFrame | None) -> DataFrame:
    """(u, m, worst, room): the length of each list, its least similarity and its room."""
    size = graph.groupBy("u").agg(F.count("*").alias("m"), F.min("sim").alias("worst"))
    return size.withColumn("room", F.lit(k)) if wide is None else size.join(wide, "u", "left").withColumn("room", F.coalesce("room", F.lit(k)))


def _saturated(graph: DataFrame, k: int, wide: DataFrame | None, threshold: float) -> DataFrame:
    """(u, room) of the nodes whose lists are full of pairs above the threshold."""
    return _room(graph, k, wide).where((F.col("m") >= F.col("room")) & (F.col("worst") >= threshold - SLACK)).select("u", "room")


def _local_join(batches):
    """Rows (u, v, unit, least) sorted by u: pairs of one u's neighbours that beat the least similarity of either end."""

    def group(vs, xs, least):
        s = xs @ xs.T
        i, j = np.triu_indices(len(vs), 1)
        sim = s[i, j]
        a, b = sim > least[i], sim > least[j]
        return np.concatenate([vs[i[a]], vs[j[b]]]), np.concatenate([vs[j[a]], vs[i[b]]]), np.concatenate([sim[a], sim[b]])

    held = None
    done = False
    batches = iter(batches)
    while not done:
        batch = next(batches, None)
        done = batch is None
        if not done:
            now = (batch.column("u").to_numpy(), batch.column("v").to_numpy(), _matrix(batch.column("unit")), batch.column("least").to_numpy())
            held = now if held is None or not len(held[0]) else tuple(np.concatenate(p) for p in zip(held, now, strict=True))
        if held is None or not len(held[0]):
            continue
        us = held[0]
        cuts = np.concatenate([[0], np.flatnonzero(us[1:] != us[:-1]) + 1, [len(us)]])
        if not done:  # the last group may go on in the next batch
            cuts = cuts[:-1]
        out = [group(held[1][a:b], held[2][a:b], held[3][a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))
        held = tuple(h[cuts[-1] :] for h in held)


def _refine(graph: DataFrame, units: DataFrame, k: int, wide: DataFrame | None = None, most: int = 0) -> DataFrame:
    turned = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
    near = graph.unionByName(_closest(turned, k, wide, most)).select("u", "v").distinct()
    near = near.unionByName(units.select(F.col("node").alias("u"), F.col("node").alias("v")))
    none = F.lit(-2.0).cast("float")
    worst = _room(graph, k, wide).select(F.col("u").alias("node"), F.when(F.col("m") >= F.col("room"), F.col("worst")).otherwise(none).alias("least"))
    known = units.select("node", "unit").join(worst, "node", "left").select(F.col("node").alias("v"), "unit", F.coalesce("least", none).alias("least"))
    rows = near.join(known, "v").select("u", "v", "unit", "least").repartition("u").sortWithinPartitions("u")
    return _top(graph.unionByName(rows.mapInArrow(_local_join, EDGES)), k, wide, most)


def _check(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose cosine in double precision reaches the threshold."""
    left = pairs.join(table.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a")
    both = left.join(table.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("va", "vb"))
                yield batch.select(["a", "b"]).filter(pa.array(cosine(x, y) >= threshold))

    return both.mapInArrow(run, "a long, b long")


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", _scaled(x), _scaled(y))


def _pairs(graph: DataFrame, threshold: float) -> DataFrame:
    return graph.where(F.col("sim") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _across(full: DataFrame, tied: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(a, b): for each two components with a link between nodes of ``full`` one such link, by exact comparison in blocks."""
    placed = store(full.join(tied.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "saturated")
    nb = -(-placed.count() // WIDE_BLOCK)
    rows = placed.join(table.select("node", "vec"), "node").withColumn("blk", F.pmod(F.xxhash64("node"), F.lit(max(nb, 1))).cast("int"))
    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(nb, 1) - 1))))
    sent = sent.select(F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node", "component", "vec")

    def run(table: pa.Table) -> pa.Table:
        x = _scaled(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1))
        blk, node, own = (table.column(c).to_numpy() for c in ("blk", "node", "component"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        p, q = np.nonzero((x[left] @ x[right].T >= threshold) & (own[left][:, None] != own[right][None, :]))
        a, b = left[p], right[q]
        _, first = np.unique(np.stack([np.minimum(own[a], own[b]), np.maximum(own[a], own[b])], axis=1), axis=0, return_index=True)
        a, b = node[a[first]], node[b[first]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return sent.groupBy("i", "j").applyInArrow(run, "a long, b long").distinct()


def _shells(tied: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(component, node, n, vec, shell), stored: shell by the angle to the component's mean, in units of the threshold's angle / SHELLS."""
    rows = tied.select("node", "component").join(table, "node")

    def add(batches):
        for batch in batches:
            if batch.num_rows:
                x = _scaled(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                own, at = np.unique(batch.column("component").to_numpy(), return_inverse=True)
                sums = np.zeros((len(own), x.shape[1]))
                np.add.at(sums, at, x)
                d = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, d)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(own))), pa.array(sums.ravel())], ["component", "i", "x"])

    sums = rows.select("component", "vec").mapInArrow(add, "component long, i int, x double").groupBy("component", "i").agg(F.sum("x").alias("x"))
    centre = store(sums.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("component", F.col("c.x").alias("centre")), "centres")

    def place(batches):
        step = np.arccos(threshold) / SHELLS
        for batch in batches:
            shell = np.zeros(0, np.int32)
            if batch.num_rows:
                x, c = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in ("vec", "centre"))
                c = np.where(np.abs(c).max(axis=1, keepdims=True) > 0, c, 1.0)  # any centre will do
                shell = (np.arccos(np.clip(cosine(x, c), -1, 1)) / step).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("component", "node", "n", "vec")], pa.array(shell)], ["component", "node", "n", "vec", "shell"])

    out = store(rows.join(centre, "component").select("component", "node", "n", "vec", "centre").mapInArrow(place, "component long, node long, n long, vec array<double>, shell int"), "shells")
    drop(centre)
    return out


def _closed(tied: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(node, links): linked vectors of each node of the components, counted or compared shell by shell."""
    rows = _shells(tied, table, threshold)
    size = store(rows.groupBy("component", "shell").agg(F.count("*").alias("m"), F.sum("n").alias("n")), "sizes")  # some SHELLS * 10 rows a component
    slack = MARGIN / np.arccos(threshold) * SHELLS
    sure = F.col("p") + F.col("q") + 2 <= SHELLS - slack  # the shells' outer bounds
    never = F.abs(F.col("p") - F.col("q")) - 1 >= SHELLS + slack
    pairs = size.select("component", F.col("shell").alias("p"), F.col("m").alias("mp")).join(size.select("component", F.col("shell").alias("q"), F.col("m").alias("mq"), F.col("n").alias("nq")), "component").where(~never).withColumn("sure", sure)
    pairs = store(pairs, "shell-pairs")
    counted = pairs.where("sure").groupBy("component", "p").agg(F.sum("nq").alias("links"), F.max((F.col("p") == F.col("q")).cast("int")).alias("itself"))
    by_count = rows.join(counted, (rows["component"] == counted["component"]) & (rows["shell"] == counted["p"])).select("node", (F.col("links") - F.col("itself") * F.col("n")).alias("links"))
    # blocks by hash within a shell; each pair of blocks is one task's work of bounded size, however large the component
    open_ = pairs.where("not sure").select(F.col("component").alias("c"), "p", "q", F.ceil(F.col("mp") / BLOCK).cast("int").alias("np"), F.ceil(F.col("mq") / BLOCK).cast("int").alias("nq"))
    sent = rows.join(open_, (rows["component"] == open_["c"]) & (rows["shell"] == open_["p"]))
    blk = F.pmod(F.xxhash64("node"), F.col("np")).cast("int")
    sent = sent.withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    here, there = F.struct(F.col("p").alias("shell"), F.col("blk").alias("blk")), F.struct(F.col("q").alias("shell"), F.col("other").alias("blk"))
    sent = sent.select("component", F.least(here, there).alias("i"), F.greatest(here, there).alias("j"), (here <= there).alias("low"), (here >= there).alias("high"), "node", "n", "vec")

    def run(table: pa.Table) -> pa.Table:
        x = _scaled(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1))
        node, n = (table.column(c).to_numpy() for c in ("node", "n"))
        left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("low", "high"))
        hit = x[left] @ x[right].T >= threshold
        hit &= node[left][:, None] != node[right][None, :]
        out = [(node[left], hit @ n[right])]
        if table.column("i")[0] != table.column("j")[0]:
            out.append((node[right], n[left] @ hit))
        ids, links = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"node": pa.array(ids, pa.int64()), "links": pa.array(links.astype(np.int64))})

    compared = sent.groupBy("component", "i", "j").applyInArrow(run, "node long, links long")
    return by_count.unionByName(compared).groupBy("node").agg(F.sum("links").alias("links"))


def recall_of(table: DataFrame, tied: DataFrame, threshold: float, audit: int) -> float:
    """Mean share of a node's links, by brute force for up to ``audit`` nodes, that lie within the components found."""
    spark, total = table.sparkSession, table.count()
    if not total:
        return 1.0
    picked = table.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 30)) < int(min(1.0, audit / total) * (1 << 30))).limit(2 * audit).collect()
    if not picked:
        return 1.0
    sent = spark.sparkContext.broadcast((np.array([r["node"] for r in picked]), np.array([r["vec"] for r in picked])))

    def run(batches):
        ids, q = sent.value
        q = _scaled(q)
        for batch in batches:
            if batch.num_rows:
                node = batch.column("node").to_numpy()
                i, j = np.nonzero(_scaled(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) @ q.T >= threshold)
                other = node[i] != ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(node[i][other]), pa.array(ids[j][other])], ["a", "b"])

    true = table.select("node", "vec").mapInArrow(run, "a long, b long")
    own = tied.select("node", "component")
    got = true.join(own.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(own.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
    share = got.groupBy("b").agg((F.count_if(F.col("ca") == F.col("cb")) / F.count("*")).alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, rounds: int = 8, audit: int = 1000, recall: float = 0.99, widest: int = WIDEST, tries: int = TRIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    table = nodes(vectors, id_col, vec_col)
    sizes = sorted(r[0] for r in table.select(F.size("vec")).distinct().collect())
    parts = [_one_size(table.where(F.size("vec") == s) if len(sizes) > 1 else table, threshold, k, rounds, audit, recall, widest, tries) for s in sizes]
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("vec"))
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    known = table.join(found, "node", "left").where("n > 1 or component is not null").select("vec", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    # rows with null id stay alone
    own = rows.join(known, (rows["vec"] == known["vec"]) & rows["id"].isNotNull(), "left")
    out = store(own.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vectors")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def _merged(pairs: DataFrame, tied: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and components with the links in ``more``."""
    if not more.head(1):
        return pairs, tied
    stars = tied.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(more), store(components(more.unionByName(stars)), "components")


def _one_size(table: DataFrame, threshold: float, k: int, rounds: int, audit: int, recall: float, widest: int, tries: int) -> DataFrame:
    """(node, component, links) of the nodes that link with others."""
    units, start = _units(table), k
    while True:
        graph, wide, most = store(_top(_start(units), k), "graph"), None, k
        while True:
            met = -1
            for _ in range(rounds):
                new = store(_refine(graph, units, k, wide, most), "graph")
                drop(graph)
                graph = new
                n = graph.where(F.col("sim") >= threshold - SLACK).count()  # grows when a list that is not saturated gains a pair
                if n == met:
                    break
                met = n
            full = store(_saturated(graph, k, wide, threshold), "saturated")
            if most * GROWTH > widest or not full.head(1):
                break
            more = full.select("u", (F.col("room") * GROWTH).alias("room"))
            wide, most = store(more if wide is None else more.unionByName(wide.join(full, "u", "left_anti")), "rooms"), most * GROWTH
            new = store(_top(graph.unionByName(_start(units)), k, wide, most), "graph")
            drop(graph)
            graph = new
        pairs = store(_check(_pairs(graph, threshold), table, threshold), "pairs")
        tied = store(components(pairs), "components")
        more = store(_across(full.select(F.col("u").alias("node")), tied, table, threshold), "across")
        pairs, tied = _merged(pairs, tied, more)
        if recall_of(table, tied, threshold, audit) >= recall:
            break
        if k >= start << tries:
            more = store(_across(table.select("node"), tied, table, threshold), "across")
            pairs, tied = _merged(pairs, tied, more)
            break
        drop(graph)
        k *= 2
    drop(graph, units)
    size = tied.groupBy("component").agg(F.count("*").alias("m"))
    large = tied.join(size.where("m > 2").select("component"), "component")
    two = pairs.join(tied.withColumnRenamed("node", "a").join(size.where("m = 2").select("component"), "component", "left_semi"), "a").select("a", "b")
    count = table.select("node", "n")
    small = two.join(count.withColumnsRenamed({"node": "b", "n": "links"}), "b").select(F.col("a").alias("node"), "links").unionByName(two.join(count.withColumnsRenamed({"node": "a", "n": "links"}), "a").select(F.col("b").alias("node"), "links"))
    links = small.unionByName(_closed(large.select("node", "component"), table, threshold))
    return tied.join(links, "node", "left").select("node", "component", F.coalesce("links", F.lit(0)).alias("links"))
