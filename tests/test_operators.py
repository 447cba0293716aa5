"""Operators on small tables, odd ones included."""

import statistics
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import clusters, graph, grouping, matching, relational, sequences, stats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_cochange_drops_large_events_and_rare_pairs(spark):
    data = [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c2", "b"), ("c3", "a"), ("c3", "c"), (None, "a")] + [("big", f"f{i}") for i in range(5)] + [("big2", f"f{i}") for i in range(5)]
    df = spark.createDataFrame(data, "e string, i string")
    assert rows(grouping.cochange(df, "e", "i", max_items=4)) == [("a", "b", 2, 1.0)]


def test_canonical_and_groups(spark):
    df = spark.createDataFrame([("x", 3, 1), ("x", 1, 2), ("x", 1, 1), ("y", 5, 0)], "k string, id int, o int")
    out = grouping.canonical(df, ["k"], [F.col("o"), F.col("id")], ["id"])
    assert rows(out.select("id", "o", "canonical_id")) == [(1, 2, 1), (3, 1, 1)]
    assert rows(grouping.duplicate_groups(df, ["k"], "id")) == [("x", 2, 1)]


def test_label_scores(spark):
    df = spark.createDataFrame([("g", ["a", "b"]), ("g", ["b"]), ("h", ["z", "y"])], "g string, w array<string>")
    assert rows(grouping.label_scores(df, ["g"], [(F.col("w"), 3)])) == [("g", "b", 6), ("h", "y", 3)]


def test_reachability_with_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    assert rows(graph.reachable(e, spark.createDataFrame([(1,), (None,)], "node int"))) == [(1,), (2,), (3,)]
    assert rows(graph.reachable(e, spark.createDataFrame([], "node int"))) == []


def test_resolve_keeps_ambiguity_and_takes_the_longest(spark):
    s = spark.createDataFrame([("a.b.c",), ("x",), ("q.r",)], "spelling string")
    a = spark.createDataFrame([("a", "A"), ("a.b", "AB"), ("a.b", "src.AB"), ("x", "X")], "alias string, owner string")
    assert rows(graph.resolve(s, a, "spelling", "alias", "owner")) == [("a.b.c", "AB"), ("a.b.c", "src.AB"), ("x", "X")]


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 10), (3, "v", 1)], "id int, u string, t int")
    right = spark.createDataFrame([("u", 5, "a"), ("u", 7, "b")], "u string, t int, x string")
    assert rows(relational.asof_latest(left, right, "u", "t", "id", ["x"]).select("id", "asof_x")) == [(1, None), (2, "b"), (3, None)]


def test_ledger_partition(spark):
    f = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    ledger = spark.createDataFrame([("a",), ("z",), ("a",)], "id string")
    left, taken = relational.partition_accepted(f, ledger, "id")
    assert rows(left) == [("b",), (None,)] and rows(taken) == [("a",)]
    assert rows(relational.unmatched(ledger, f, "id")) == [("z",)]


def test_median_mad(spark):
    values = [1.0, 2.0, 2.0, 7.0, 100.0, 3.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = stats.median_mad(df, ["g"], "v").first()
    med = statistics.median(values)
    assert (got["median"], got["mad"], got["prevalence"]) == (med, statistics.median(abs(v - med) for v in values), 1.0)


def test_confusion_without_positives(spark):
    df = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    assert tuple(stats.confusion(df, "t", "p").first()) == (0, 0, 0, 1, None, None)


def test_weighted_mean_of_nothing(spark):
    assert stats.weighted_mean(spark.createDataFrame([("a", 1.0, 0)], "g string, v double, w int"), "v", "w", ["g"]).first()["weighted_mean"] == 0.0


def test_sequence_ratio_matches_difflib(spark):
    a, b = ["x", "y", "z", "y"], ["y", "z", "x"]
    df = spark.createDataFrame([(a, b), ([], b), (None, b)], "a array<string>, b array<string>")
    got = [r["r"] for r in sequences.ratios(df, "a", "b", "r").collect()]
    assert got == [SequenceMatcher(None, a, b, autojunk=False).ratio(), 0.0, 0.0]


def test_block_pairs_meet_only_through_blocks(spark):
    left = spark.createDataFrame([(i, [f"w{i}", f"v{i}"]) for i in range(300)], "l int, w array<string>")
    right = spark.createDataFrame([(i, [f"w{i}", f"v{i}", "q"]) for i in range(0, 300, 30)], "r int, w array<string>")
    assert matching.block_pairs(left, right, "l", "r", "w", "w").count() < 20


def test_bridge_does_not_merge_clusters():
    parts = {(a, b): 0.9 for g in ("abc", "def") for i, a in enumerate(g) for b in g[i + 1 :]}
    got = clusters.agglomerate(list("abcdef"), parts | {("c", "d"): 0.55})
    assert [m for m, _ in got] == [list("abc"), list("def")]
    assert clusters.agglomerate([], {}) == []


def test_columns(spark):
    df = spark.createDataFrame([("a/b/c_v2.py", "x.y.z", "HTTPServerName get_it")], "p string, d string, t string")
    got = df.select(C.prefixes(F.col("d")), C.ancestors(F.col("p")), C.stem(F.col("p")), C.family(C.stem(F.col("p"))), C.words(F.col("t")), C.parent(F.col("p"))).first()
    assert got[0] == ["x", "x.y", "x.y.z"] and got[1] == ["", "a", "a/b"] and got[2] == "c_v2" and got[3] == "c" and "name" in got[4] and got[5] == "a/b"


def test_streaming_lifecycle(spark, tmp_path):
    from quarry.streaming.lifecycle import lifecycle, windowed_counts

    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:20:00", "a")], "ts string, k string")
    assert sorted(r["n"] for r in windowed_counts(events, "ts", "k").collect()) == [1, 2]
    spark.createDataFrame([("f", 1, True), ("f", 2, True), ("f", 3, False), ("g", 1, False)], "id string, scan long, present boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, scan long, present boolean").parquet(str(tmp_path / "in"))
    q = lifecycle(stream).writeStream.format("memory").queryName("life").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["scan"], r["state"]) for r in spark.sql("select * from life").collect()) == [(1, "new"), (2, "persisting"), (3, "resolved")]


def test_clusters_of_copies_equal_those_of_all_members(spark):
    import random

    pick, want, members, pairs = random.Random(3), [], [], []
    for g in range(12):
        ids = pick.sample(range(100), 14)
        of = {m: pick.randrange(5) for m in ids}
        sim = {(x, y): 1.0 if x == y and x < 4 else pick.choice([0.0, 0.2, 0.5]) for x in range(5) for y in range(x, 5)} | {(4, 4): 0.0}
        least = {k: min(m for m in ids if of[m] == k) for k in set(of.values())}
        every = {(a, b): sim[tuple(sorted((of[a], of[b])))] for a in ids for b in ids if a < b}
        want += [(g, c[0], m, round(mean, 12)) for c, mean in clusters.agglomerate(ids, every) for m in c]
        members += [(g, m, least[of[m]]) for m in ids]
        pairs += [(g, *sorted((least[x], least[y])), v) for (x, y), v in sim.items() if x in least and y in least]
    m, p = spark.createDataFrame(members, "g int, m int, c int"), spark.createDataFrame(pairs, "g int, a int, b int, affinity double")
    got = clusters.average_link(m, p, "g", "m", copy_of="c")
    assert want and sorted((r[0], r[1], r[2], round(r[3], 12)) for r in got.collect()) == sorted(want)


def test_clusters_count_joint_orders_of_single_members(spark):
    import random

    pick, moved = random.Random(8), 0
    for _ in range(40):
        ids = pick.sample(range(100), 12)
        of = {m: pick.randrange(5) for m in ids}
        sim = {(x, y): 1.0 if x == y and x < 4 else pick.choice([0.0, 0.2, 0.375, 0.5]) for x in range(5) for y in range(x, 5)} | {(4, 4): 0.0}
        least = {k: min(m for m in ids if of[m] == k) for k in set(of.values())}
        words = {(a, b): sim[tuple(sorted((of[a], of[b])))] for a in ids for b in ids if a < b}
        more = {p: pick.choice([0.125, 0.25, 0.35]) for p in pick.sample(sorted(words), 8)}
        every = {p: min(1.0, v + more.get(p, 0.0)) for p, v in words.items()}
        classes = {tuple(sorted((least[x], least[y]))): v for (x, y), v in sim.items() if x in least and y in least}
        got = clusters.agglomerate(ids, classes, copy_of={m: least[of[m]] for m in ids}, more=more)
        tidy = lambda found: [(c, round(mean, 12)) for c, mean in found]
        assert tidy(got) == tidy(clusters.agglomerate(ids, every))
        moved += got != clusters.agglomerate(ids, words)
    assert moved > 10


def test_avg_link_clusters_depend_on_joint_orders(spark, tmp_path):
    from quarry import queries as core

    parts = [(1, "red bolt steel"), (2, "red gear brass"), (3, "old pipe"), (4, "new wire"), (5, "dry cork"), (6, "dim lamp"), (7, "big door")]
    spark.createDataFrame([(k, n, "B", "T", 1) for k, n in parts], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, k) for o in range(4) for k in (1, 2)] + [(9, 3), (9, 4)] + [(20, k) for k in (*range(100, 200), 3, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = core.QUERIES["avg_link_clusters"](spark, str(tmp_path)).collect()
    assert sorted((r["cluster"], r["member"], round(r["cohesion"], 6)) for r in got) == [(1, 1, 0.55), (1, 2, 0.55)]  # one word of five, and every order


def test_cochange_within_equals_cochange_of_pairs_inside_groups(spark):
    rows = [(e, i) for e in range(30) for i in range(20) if (e * 7 + i * i) % 5 < 2] * 2 + [(50, i) for i in range(200)] + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, "e int, i int")
    groups = spark.createDataFrame([(i, i % 3) for i in range(200)] + [(None, 1), (1, None)], "i int, g int")
    want = [(r["a"] % 3, r["a"], r["b"], r["pair_count"], r["affinity"]) for r in grouping.cochange(df, "e", "i").collect() if r["a"] % 3 == r["b"] % 3]
    got = [tuple(r) for r in grouping.cochange_within(df, "e", "i", groups, "g").collect()]
    assert want and sorted(got) == sorted(want)


def test_similarities_are_made_once_for_members_with_the_same_words(spark):
    from itertools import combinations

    data = [(i % 2, i, ["a", "b"] if i < 14 else ["a", "c", str(i % 3)]) for i in range(20)] + [(0, 40, []), (0, 42, []), (0, 4, ["c"]), (0, 4, ["a", "b"]), (None, 50, ["a"]), (None, 51, ["a"]), (0, None, ["a"])]
    df = spark.createDataFrame(data, "g int, id int, w array<string>")
    got = matching.similarities_within(df, ["g"], "id", "w", 6, at_once=3)
    share = lambda x, y: round(len(x & y) / len(x | y), 6) if x | y else 0.0
    known = [(g, i, set(w)) for g, i, w in data if g is not None and i is not None]
    want = [(*sorted((i, j)), share(x, y)) for (g, i, x), (h, j, y) in combinations(known, 2) if g == h and i != j]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    # the arrays are compared before copies are expanded
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(ids_b") < plan.index("array_intersect")


def test_similarities_do_not_depend_on_the_order_of_rows(spark):
    df = spark.createDataFrame([(1, i, ["a"] if i % 2 else ["b"]) for i in range(40)], "g int, id int, w array<string>")
    got = matching.similarities_within(df, ["g"], "id", "w", 6, at_once=3)
    # each side of the join collects the ids of a kind by itself, in the order in which its rows come
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(id") == 2 and plan.count("array_sort(collect_list(id") == 2
    assert got.select("a", "b").distinct().count() == got.count() == 40 * 39 // 2


PARTS = [
    (1, "red bolt", "LARGE"), (2, "Red Bolt", "large"), (3, "redBolt", "LARGE"), (4, None, "LARGE"), (5, "red gear", None), (6, "a b", "c"), (7, "x", "y"),
    (8, "blue gear", "SMALL"), (9, "blue gear", "SMALL"),
]


@pytest.fixture()
def odd_parts(spark, tmp_path):
    rows = [(k, n, "B", ty, 1, float(k)) for k, n, ty in PARTS] + [(20, "red bolt", "B", "LARGE", 2, -3.0), (21, "red bolt", "B", "LARGE", 2, -4.0), (22, "red bolt", "B", "SMALL", 2, 3.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, k) for k in (1, 2, 4, 6, 8, 9, 21) for o in range(k)] + [(0, 8), (7, 8), (0, 1), (None, 2), (3, None), (3, None), (99, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select id as o_orderkey, timestamp_ntz'2020-01-01' + make_dt_interval(cast(id as int)) as o_orderdate from range(30) union all select 8, timestamp_ntz'2021-01-01' union all select null, timestamp_ntz'2022-01-01'").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def _same_as_sql(spark, folder, name):
    import duckdb

    from quarry import queries as core

    duck = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        duck.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = duck.sql(core.ORACLES[name])
    got = core.QUERIES[name](spark, folder)
    order = [got.columns.index(c) for c in want.columns]
    value = lambda v: "nan" if v is not None and v != v else round(float(v), 5) if isinstance(v, float | Decimal) else v
    plain = lambda rows: sorted(str([value(v) for v in r]) for r in rows)
    assert plain(tuple(r[i] for i in order) for r in got.collect()) == plain(want.fetchall())


def test_vocab_jaccard_pairs_of_odd_parts_equal_the_sql(spark, odd_parts):
    _same_as_sql(spark, odd_parts, "vocab_jaccard_pairs")


def test_stale_score_of_odd_parts_equals_the_sql(spark, odd_parts):
    _same_as_sql(spark, odd_parts, "stale_score")


def test_best_of_group_in_small_pieces_equals_all_pairs(monkeypatch):
    import random

    import numpy as np

    pick = random.Random(2)
    for cells in (1, 50, 10**6):
        monkeypatch.setattr(matching, "CELLS", cells)
        for sizes in ([900.0, 950.0], [1.0, 2.0, 2.9, 9.0]):
            rows = [(pick.choice([i, i, pick.randrange(60)]), tuple(sorted(pick.sample(range(6), pick.randrange(4)))), pick.choice(sizes)) for i in range(60)]
            best, rank = matching.best_of_group(np.array([r[0] for r in rows]), [np.array(r[1], np.int64) for r in rows], np.array([r[2] for r in rows]))
            for (i, x, p), b, v in zip(rows, best, rank, strict=True):
                share = lambda y, x=x: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0
                want = min([(-share(y), j) for j, y, q in rows if j != i and 0.35 <= p / q <= 2.85], default=(2.0, -1))
                assert (-v, b) == want


def test_best_within_makes_no_row_of_a_pair(spark):
    df = spark.createDataFrame([(i % 3, i, ["a", str(i)], 900.0 + i) for i in range(30)], "g int, id int, w array<string>, s double")
    plan = matching.best_within(df, ["g"], "id", "w", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "array_intersect" not in plan


def test_best_within_equals_all_pairs_whatever_the_sizes(spark):
    import random

    pick = random.Random(5)
    data = [(pick.randrange(3), i, pick.choice([["a", "b"], ["a", "c"], ["a", "b", "c"], [], ["z"]]), pick.choice([1.0, 2.0, 2.9, 5.0, 9.0, 30.0, 0.0, None, -1.0, float("nan")])) for i in range(120)]
    data += [(0, 7, ["a", "b"], 2.0), (1, 7, ["q"], 2.0), (None, 900, ["a"], 1.0), (None, 901, ["a"], 1.0), (9, 902, ["a"], 1.0)]
    df = spark.createDataFrame(data, "g int, id int, w array<string>, s double")
    fit = lambda x, y: x is not None and y is not None and x > 0 and y > 0 and 0.35 <= x / y <= 2.85
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0
    want = {}
    for g, i, x, p in data:
        for h, j, y, q in data:
            if g is not None and g == h and i != j and fit(p, q):
                want[i] = min(want.get(i, (9, 9)), (-share(x, y), j))
    got = matching.best_within(df, ["g"], "id", "w", "s")
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, j, -neg) for i, (neg, j) in want.items())
