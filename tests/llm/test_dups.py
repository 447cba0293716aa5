"""Operators 3, 6, 7 and 8 against brute force on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import line_templates, near_dup, nn_descent, suffix_dedup
from quarry.llm.common import store
from quarry.llm.graph import components

from .conftest import ODD, prose, words


def closure(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103), (102, 103), (7, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == closure({x for e in links for x in e}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- operator 3 ---------------------------------------------------------------------------------
VECS = "vec_id long, embedding array<float>, label int, node int, n int"


def _vectors():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for group in (1,) * 60 + (2,) * 10 + (5, 30):
        center = rng.normal(size=16)
        for _ in range(group):
            rows.append([i, (center + rng.normal(size=16) * 0.08 * (group > 1)).astype(np.float32).tolist()])
            i += 1
    rows += [[i, rows[0][1]], [i + 1, [x * 2 for x in rows[0][1]]], [i + 2, None], [i + 3, []], [i + 4, [0.0] * 16], [i + 5, [float("nan")] + [1.0] * 15], [i + 6, [None] + [1.0] * 15], [i + 7, [1.0] * 15], [i + 8, [float("inf")] + [1.0] * 15], [None, rows[0][1]], [3, rows[3][1]]]
    return rows


def test_nn_descent_equals_brute_force(spark):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], VECS)
    got = nn_descent.near_duplicates(df, k=6).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, count = [], Counter()
    for x, (a, u) in enumerate(good):
        for b, w in good[x + 1 :]:
            if len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.95:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    want = closure({i for i, _ in rows if i is not None}, links)
    for r in got:
        i = r["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        elif i == 3:  # two rows, each linked with the other
            assert r["component_id"] == want[3] and r["n_links"] >= 1
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (count[i], want[i], want[i] == i)


def test_nn_descent_links_saturated_groups(spark):
    rng = np.random.default_rng(4)
    a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    centers = [a, 0.96 * a + (1 - 0.96**2) ** 0.5 * b]
    vecs = np.array([c + rng.normal(size=16) * 0.0005 for c in centers for _ in range(14)])
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    assert (unit @ unit.T >= 0.951).all()  # all are linked, but the 8 closest are of a node's own group
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, 2) for i, v in enumerate(vecs)], VECS)
    for widest in (8, 32):  # by comparison across components, or by enlarged lists; without the audit's help
        got = nn_descent.near_duplicates(df, recall=0.0, widest=widest).collect()
        assert {(r["n_links"], r["component_id"]) for r in got} == {(27, 0)}


def test_nn_descent_counts_links_by_shells(spark):
    rng = np.random.default_rng(6)
    center, rows = rng.normal(size=24), []
    for spread in (0.01,) * 700 + (0.05,) * 120 + (0.06, 0.07, 0.08) * 40:  # a dense core of more than a block, and a rim
        rows.append(center + rng.normal(size=24) * spread * np.linalg.norm(center))
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    want = closure(range(len(rows)), np.argwhere(np.triu(hit, 1)).tolist())
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, 2) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, node int, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(df).collect()}
    assert got == {i: (int(hit[i].sum()) - 1, want[i]) for i in range(len(rows))} and hit.sum() < hit.size


def test_nn_descent_ends_by_exact_comparison(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(nn_descent, "recall_of", lambda *args: calls.append(1) or 0.0)
    rows = _vectors()[:100]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], VECS)
    got = {r["vec_id"]: r["component_id"] for r in nn_descent.near_duplicates(df, k=4, tries=1).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = closure(range(100), np.argwhere(np.triu(x @ x.T >= 0.95, 1)).tolist())
    assert got == want and len(calls) == 2


def test_nn_descent_of_nothing(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], VECS)).count() == 0
    one = nn_descent.near_duplicates(spark.createDataFrame([(5, None, 0, 0, 0)], VECS)).first()
    assert tuple(one) == (5, 0, 5, True)


# -- operator 6 ---------------------------------------------------------------------------------
def brute_cut(texts, length):
    starts = defaultdict(list)
    raws = [(t or "").encode() for t in texts]
    for k, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            starts[raw[p : p + length]].append((k, p))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in starts.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + length] = True
    out = []
    for raw, g in zip(raws, gone, strict=True):
        kept = np.frombuffer(raw, np.uint8)[~g].tobytes()
        out.append((len(raw), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix_dedup_equals_brute_force(spark, frame, rng):
    passages = [prose(rng, n=30) for _ in range(3)]
    texts = []
    for i in range(40):
        t = prose(rng, rng.choice(["en", "fr"]), rng.randint(5, 80))
        for p in rng.sample(passages, rng.randint(0, 2)):
            a, b = sorted(rng.sample(range(len(p)), 2))
            cut = rng.randrange(len(t))
            t = t[:cut] + p[a:b] + t[cut:]
        texts.append(t)
    texts += [texts[0], texts[0], "ab" * 90, "a" * 150, "xab" + "ab" * 60, "é" * 100, "word " * 40]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + ODD
    got = suffix_dedup.cut(frame(rows), length=40, q=20, widths=(6, 1)).collect()
    want = brute_cut([t for _, t, _ in rows], 40)
    key = lambda r: str((r[0], r[1], r[4]))
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got], key=key) == sorted([(i, *w) for (i, _, _), w in zip(rows, want, strict=True)], key=key)


def test_buckets_tell_strings_apart(rng):
    raw = np.frombuffer(("ab" * 60 + prose(rng, n=60) + "x" * 90).encode() * 2, np.uint8)
    ids = suffix_dedup.Buckets(raw)
    for depth in (8, 9, 16, 20, 37, 64, 100):
        got, want = ids.refined(depth), [raw[p : p + depth].tobytes() for p in range(len(raw) - depth + 1)]
        assert len(got) == len(want) and len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))


def test_suffix_dedup_at_production_size(spark, frame, rng):
    passages = [prose(rng, n=n) for n in (40, 90, 150)]
    rows = [(i, prose(rng, n=rng.randint(20, 200)) + passages[i % 3][: rng.randint(200, 900)] + prose(rng, n=50), "en") for i in range(60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.cut(frame(rows), with_bytes=False).collect()}
    assert got == {i: w[:4] for (i, *_), w in zip(rows, brute_cut([t for _, t, _ in rows], 400), strict=True)} and any(r[1] for r in got.values())


def test_suffix_dedup_in_chunks(monkeypatch, rng):
    raw = np.frombuffer(prose(rng, n=900).encode(), np.uint8)
    whole = suffix_dedup.anchors(raw, 40, 20)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    parts = suffix_dedup.anchors(raw, 40, 20)
    cover = lambda x: {(int(a), p) for a, lo, hi in zip(*x[1:], strict=True) for p in range(lo, hi + 1)}
    assert cover(whole) == cover(parts)
    assert len(suffix_dedup.anchors(raw[:39], 40, 20)[0]) == 0


def test_suffix_dedup_of_long_texts(spark, frame, rng, monkeypatch):
    real, text = suffix_dedup._members, prose(rng, n=2500)

    def in_chunks(texts, groups, length, width):  # CHUNK travels with the function that runs on the executors
        monkeypatch.setitem(real.__globals__, "CHUNK", 2000)
        return real(texts, groups, length, width)

    monkeypatch.setattr(suffix_dedup, "_members", in_chunks)
    rows = [(0, text, "en"), (1, text[900:1950] + "x" + text[3000:7100] + "y" + text[3500:5000], "en")]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.cut(frame(rows), length=100, q=50, with_bytes=False).collect()}
    assert got == {i: w[:4] for (i, *_), w in zip(rows, brute_cut([t for _, t, _ in rows], 100), strict=True)}


def test_suffix_dedup_of_nothing(spark, frame):
    assert suffix_dedup.cut(frame([])).count() == 0


# -- operator 7 ---------------------------------------------------------------------------------
def _near(rng):
    texts = {}
    for i in range(60):
        texts[i] = prose(rng, rng.choice(["en", "fr", "de"]), rng.randint(3, 200))
    n = 100
    for base in range(12):  # groups of near copies, the last one large
        w = prose(rng, n=300).split(" ")
        for _ in range(2 if base < 11 else 40):
            c = list(w)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = "changed" + str(rng.randrange(9**9))
            texts[n] = " ".join(c)
            n += 1
    texts[n], texts[n + 1] = texts[0], texts[0]
    return texts


def test_near_dup_equals_brute_force(spark, frame, rng):
    texts = _near(rng)
    rows = [(i, t, "en") for i, t in texts.items()] + ODD
    df = frame(rows)
    idf = near_dup.idf_table(df)
    make = near_dup.Shingles(idf)
    own = {i: make(t) for i, t in texts.items()}
    ids = sorted(texts)
    links, near = [], []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s = near_dup.weighted_jaccard(own[a], own[b])
            if s >= 0.8:
                links.append((a, b))
    want = closure(ids, links)
    got = near_dup.groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        if i in want:
            assert (r["component_id"], r["kept"]) == (want[i], want[i] == i)
        else:
            assert r["component_id"] == i and r["kept"]
    del near
    kept = near_dup.keep_one(df).collect()
    assert kept[0].asDict().keys() == dict.fromkeys(df.columns).keys()
    names = Counter(r["doc_id"] for r in kept)
    assert set(names) == set(want.values()) | {i for i, _, _ in ODD} and names[904] == 1 and max(names.values()) == 1


def test_weighted_samples_estimate_similarity(rng):
    sample = near_dup.Sampler()
    ids = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = np.random.default_rng(1).gamma(2, 1, 4000)
    hits = []
    for k in range(40):
        a, b = slice(k * 100, k * 100 + 90), slice(k * 100 + 10, k * 100 + 100)
        x, y = (np.sort(ids[s]) for s in (a, b))
        s = sample(np.concatenate([ids[a], ids[b]]), np.concatenate([w[a], w[b]]), np.array([0, 90, 180]))
        true = w[k * 100 + 10 : k * 100 + 90].sum() / w[k * 100 : k * 100 + 100].sum()
        hits.append((s[0] == s[1]).mean() - true)
        del x, y
    assert abs(np.mean(hits)) < 0.03


def test_near_dup_compares_what_the_pivots_leave_open(spark, frame, rng, monkeypatch):
    def chain():
        w = prose(rng, n=300).split(" ")
        out = []
        for step in range(4):  # 0.87 to the next one, below 0.8 to the one after
            out.append(" ".join(w))
            for i in range(4):
                w[10 + 20 * i + 90 * (step % 3)] = f"changed{step}x{i}"
        return out

    lone, second, joined = chain(), chain(), chain()
    texts = {10: lone[0], 11: lone[1], 12: lone[2]}  # one open member after the first pivot, 10
    texts |= {20: second[0], 21: second[1], 22: second[2], 23: prose(rng, n=300)}  # 22 is the second pivot
    texts |= {30: joined[0], 31: joined[3], 32: joined[1], 33: joined[2]}  # 33 joins the second pivot, 31
    df = frame([(i, t, "en") for i, t in texts.items()])
    make = near_dup.Shingles(near_dup.idf_table(df))
    sim = lambda a, b: near_dup.weighted_jaccard(make(a), make(b))
    for c in (lone, second, joined):
        assert min(sim(c[k], c[k + 1]) for k in range(3)) >= 0.8 > max(sim(c[k], c[k + 2]) for k in range(2))
    real = near_dup.signatures
    monkeypatch.setattr(near_dup, "signatures", lambda *args: store(real(*args).withColumn("bands", F.array((F.col("id") / 10).cast("long"))), "signatures"))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(df).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 22: 20, 23: 23, 30: 30, 31: 30, 32: 30, 33: 30}


def test_near_dup_of_nothing(spark, frame):
    assert near_dup.groups(frame([])).count() == 0 and near_dup.keep_one(frame([])).count() == 0


# -- operator 8 ---------------------------------------------------------------------------------
def _templates(line):
    """Templates by the definition: own tokens, and with one of four parts after the leading two left open."""
    toks = ["<*>" if re.search("[0-9@]|://", t) else t for t in re.split("[ \t\r\f]+", line.lower().strip(" "))]
    n, rest = len(toks), len(toks) - 2
    if not [t for t in toks if t not in ("<*>", "")]:
        return set()
    parts = [(2 + rest * s // 4, 2 + rest * (s + 1) // 4) for s in range(4)] if rest >= 4 else []
    return {tuple(toks)} | {(n, s, *toks[:a], "|", *toks[b:]) for s, (a, b) in enumerate(parts)}


def brute_lines(texts, min_docs):
    """Independent documents are groups of texts by their shares of runs of three words; nothing of the engine is used."""
    texts_ = sorted({t for t in texts if t is not None})
    runs = [{tuple(w[i : i + 3]) for i in range(len(w))} for w in (t.lower().split() for t in texts_)]
    near = [(i, j) for i in range(len(runs)) for j in range(i) if runs[i] and runs[j] and len(runs[i] & runs[j]) / len(runs[i] | runs[j]) >= 0.5]
    doc, counts = closure(range(len(texts_)), near), defaultdict(set)
    for i, t in enumerate(texts_):
        for line in t.split("\n"):
            for k in _templates(line):
                counts[k].add(doc[i])
    gone = {k for k, ds in counts.items() if len(ds) >= min_docs}
    return [None if t is None else "\n".join(x for x in t.split("\n") if not gone & _templates(x)) for t in texts]


def test_line_templates_equal_brute_force(spark, frame, rng):
    texts = []
    for i in range(30):
        own = [prose(rng, n=rng.randint(25, 60)) for _ in range(3)]
        if i % 2:
            own.insert(1, f"Printed on page {i} of this very long report about the state of all our many things")
        if i % 3 == 0:
            w = words(rng, "en", 1)[0]
            own.append(f"Subscribe to our news letter now and get the best {w} offers every single day at home")
        if i % 3 == 1:
            own.append(f"Read more about {words(rng, 'fr', 1)[0]} over here")
        if i % 4 == 0:
            own += ["All rights reserved", "", "x", "関連記事一覧", "12 34"]
        texts.append("\n".join(own))
    near = "\n".join(prose(rng, n=60) for _ in range(6))
    texts += [near.replace("the", f"the{i}", 1) for i in range(12)] + [texts[0]] * 15
    rows = [(i, t, "en") for i, t in enumerate(texts)] + ODD
    df = frame(rows).selectExpr("*", "1 as gone", "2 as th2", "3 as __drop", "4 as first")
    out = line_templates.dedup(df, min_docs=6, counts=("lines_in", "lines_out"))
    assert out.columns == [*df.columns, "lines_in", "lines_out"]
    got = sorted([(str(r["doc_id"]), str(r["text"]), r["lines_out"] > 0) for r in out.collect()])
    want = brute_lines([t for _, t, _ in rows], 6)
    assert got == sorted([(str(i), str(w), w != t) for (i, t, _), w in zip(rows, want, strict=True)])
    text = {r[0]: r[1] for r in got}
    assert "printed on page" not in text["1"].lower() and "subscribe" not in text["3"].lower() and "read more" not in text["1"].lower()
    assert "関連" not in text["8"] and "\nx" not in text["8"] and "12 34" in text["8"]
    assert text["30"] == texts[30]  # lines of near copies and of copies stay
    assert line_templates.dedup(frame([])).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_templates_count_every_independent_document(spark, frame, rng):
    vocabulary = words(rng, "en", 3000)
    line = "Copyright of this page belongs to the makers of this page"
    body = lambda: "\n".join(" ".join(rng.choices(vocabulary, k=30)) for _ in range(10))
    for n in (9, 10, 20, 200, 2000):
        texts = [body() + "\n" + line for _ in range(n)]
        got = line_templates.dedup(frame([(i, t, "en") for i, t in enumerate(texts)]))
        assert got.where(F.contains("text", F.lit("Copyright"))).count() == (n if n < 10 else 0)
    half = " ".join(rng.choices(vocabulary, k=100))  # a passage as long as a third of each text changes nothing
    texts = [body() + "\n" + half for _ in range(200)]
    assert line_templates.dedup(frame([(i, t, "en") for i, t in enumerate(texts)])).where(F.contains("text", F.lit(half))).count() == 0
    base = body().split(" ")
    texts = []
    for i in range(1000):  # near copies of one text count once, however many
        w = list(base)
        for j in rng.sample(range(len(w)), 5):
            w[j] = w[j] if "\n" in w[j] else f"changed{i}x{j}"
        texts.append(" ".join(w))
    got = line_templates.dedup(frame([(i, t, "en") for i, t in enumerate(texts)]))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == dict(enumerate(texts))


def test_samples_equal_the_plain_formula():
    sample, rng = near_dup.Sampler(), np.random.default_rng(4)
    ptr = np.array([0, 1, 40, 300])
    ids, weights = rng.integers(0, 2**64, 300, dtype=np.uint64), np.exp(rng.normal(0, 6, 300))
    lns, low, want = np.log(weights).astype(np.float32), np.uint64(4095), []
    for seed in sample.seed:
        h = ids * seed
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        a, b, c = (h & low).astype(int), (h >> np.uint64(12) & low).astype(int), (h >> np.uint64(24) & low).astype(int)
        t = np.floor(lns * sample.inv[a] + sample.beta[c])
        lna = sample.lnc[b] - sample.r[a] * (t - sample.beta[c] + 1)
        name = (h >> np.uint64(32)).astype(np.uint32) + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        want.append([min(zip(lna[i:j].tolist(), name[i:j].tolist(), strict=True))[1] for i, j in zip(ptr, ptr[1:], strict=False)])
    assert (sample(ids, weights, ptr) == np.array(want).T).all()
    make = near_dup.Shingles(None)
    assert set(make.vocabulary("b a B c a").tolist()) == set(make.words("a b c").tolist()) and len(make.vocabulary("")) == 0
