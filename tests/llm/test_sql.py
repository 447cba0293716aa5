"""Operators that SQL can express equal DuckDB's answer, also where the driver's small tables hold no such case."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarry.llm import nn_descent, suffix_dedup
from quarry.llm.queries import ORACLES


def answer(name, table, frame):
    con = duckdb.connect()
    con.register("given", frame)
    con.sql(f"create table {table} as select * from given")
    return con.sql(ORACLES[name]).df()


def same(got, want, key):
    got, want = (f.sort_values(key).reset_index(drop=True)[sorted(f.columns)] for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_links_of_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for centre in rng.normal(size=(30, 32)):  # groups around the threshold: chains, copies, pairs just below
        rows += [centre + rng.normal(size=32) * s for s in rng.choice([0.0, 0.1, 0.2, 0.25, 0.3], size=10)]
    values = [[float(x) for x in r] for r in rows] + [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31]
    table = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<float>").repartition(4)
    got = nn_descent.near_duplicates(table).toPandas()
    stored = pd.DataFrame({"vec_id": range(len(values)), "embedding": [v and [x if x is None else float(np.float32(x)) for x in v] if v is not None else None for v in values]})
    want = answer("op3_nn_descent", "embeddings", stored)
    assert (want["n_links"] > 0).sum() > 100 and (want["n_links"] == 0).sum() > 20
    same(got, want, "vec_id")


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_of_texts(spark, seed):
    rng = np.random.default_rng(seed)
    words = ["alpha", "bêta", "γάμμα", "delta", "語", "zeta\n", "eta", "theta"]
    make = lambda n: " ".join(words[i] + str(rng.integers(1000)) for i in rng.integers(0, len(words), n))
    shared = [make(60) for _ in range(4)]
    texts = [make(20) + shared[rng.integers(4)] + make(int(rng.integers(0, 40))) for _ in range(60)]
    texts += [texts[0], None, "", "a" * 399, "b" * 401, "c" * 1000, "xy" * 300, texts[1][:-1], shared[0] + "|" + shared[0]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = suffix_dedup.cut(table, with_bytes=False).toPandas()
    want = answer("op6_suffix_dedup", "documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert (want["n_removed"] > 0).sum() > 40 and (want["n_spans"] > 0).any()
    same(got, want, "doc_id")
