"""Quality classifier: a factorisation machine (operator 10).

Features are hashed words and hashed word shapes (shares of the text), structure statistics and numeric
metadata columns. Low-rank pairwise interactions are scored in linear time by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]``.

Training takes a bounded sample: at most about ``max_train`` labelled rows, picked by a hash of the id;
their features are made on the executors, the driver only runs the gradient steps. Scoring is one narrow
pass over whole texts.

Features of a text are summed over pieces of PIECE characters, cut at white space, and only a few texts are
Python strings or features at once, so a long text takes little more memory than its own size.

Results for odd input: null and empty texts are scored on their (zero) features; null metadata counts as 0;
ids labelled more than once count with their mean label; labels other than 0 and 1 and null ids teach
nothing; with fewer than two classes to learn from, the score is the share of label 1 (0.5 without any);
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole

BITS = 18
RANK = 8
SHAPES = 256
MEMO = 250_000
#: Characters of words that are remembered, and characters of a text that are looked at, at once.
MEMO_CHARS = 1 << 24
PIECE = 1 << 20
#: Texts, and features of texts, that are scored at once.
ROWS = 512
FEATURES = 1 << 18
STATS = (
    "log_bytes", "upper", "digit", "space", "newline", "plain_punct", "symbol", "wide", "control",
    "log_words", "mean_word", "long_words", "types", "no_letter", "caps_words", "repeats", "lines_repeated", "log_mean_line", "ends_stop",
)
CLASS = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    CLASS[_i] = 7 if _i >= 128 else 1 if _c.isupper() else 0 if _c.islower() else 2 if _c.isdigit() else 3 if _c in " \t" else 4 if _c == "\n" else 5 if _c in ".,;:?!'\"()-" else 8 if _i < 32 or _i == 127 else 6
_RUNS = [(re.compile(p), r) for p, r in ((r"[a-zà-öø-ÿ]+", "a"), (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"\d+", "9"), (r"([^aA9])\1+", r"\1\1"))]


def shape(word: str) -> str:
    """Runs of lower and upper letters, digits and repeated signs, each as one mark; 8 marks at most count."""
    n = 1024
    while True:
        marks = word[:n]
        for p, r in _RUNS:
            marks = p.sub(r, marks)
        if n >= len(word) or len(marks) > 9:  # what follows may still change the last two marks
            return marks[:8]
        n *= 8


_SPACE, _LINE = re.compile(r"\s"), re.compile("\n")


def pieces(text: str, at: re.Pattern) -> Iterator[str]:
    """The text cut at matches of ``at`` (one character, which goes) about each PIECE characters."""
    lo = 0
    while len(text) - lo > PIECE and (m := at.search(text, lo + PIECE)):
        yield text[lo : m.start()]
        lo = m.end()
    yield text[lo:]


class Features:
    """Sparse features of a text: ids below 2**BITS for words, then SHAPES for shapes, then the dense ones."""

    def __init__(self, n_meta: int):
        self.memo: dict[str, int] = {}
        self.held = 0
        self.n_dense = len(STATS) + n_meta
        self.size = (1 << BITS) + SHAPES + self.n_dense

    def _learn(self, words) -> None:
        if len(self.memo) > MEMO or self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
        for w in words:
            if w not in self.memo:
                self.memo[w] = (zlib.crc32(w.lower().encode()) & ((1 << BITS) - 1)) << 8 | (zlib.crc32(shape(w).encode()) % SHAPES)
                self.held += len(w)

    def _named(self, words: list[str]) -> np.ndarray:
        """Word and shape of each word, as one number."""
        memo = self.memo
        try:
            return np.array([memo[w] for w in words], np.int64)
        except KeyError:
            self._learn(set(words))
            return np.array([memo[w] for w in words], np.int64)

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, their counts, counts of shapes; words, their characters, words of over 20, words that begin with a letter, in capitals, equal to the word before."""
        parts = pieces(text, _SPACE)
        total, shapes, sums, last = None, np.zeros(SHAPES, np.int64), np.zeros(6, np.int64), np.zeros(0, np.int64)
        for part in parts:
            words = part.split()
            both = self._named(words)
            sizes = np.array([len(w) for w in words], np.int64)
            shapes += np.bincount(both & 255, minlength=SHAPES)
            row = np.concatenate([last, both])
            sums += [len(words), sizes.sum(), (sizes > 20).sum(), sum(map(str.isalpha, (w[:1] for w in words))), sum(map(str.isupper, words)), (row[1:] == row[:-1]).sum()]
            last = row[-1:]
            if len(text) <= PIECE:
                return *np.unique(both >> 8, return_counts=True), shapes, sums
            total = np.bincount(both >> 8, minlength=1 << BITS) + (0 if total is None else total)
        ids = np.flatnonzero(total)
        return ids, total[ids], shapes, sums

    def _lines(self, text: str) -> tuple[int, int, int]:
        """Lines that are not empty, those that differ (of long texts by 64-bit names), those that end a sentence."""
        n, ends, names = 0, 0, np.zeros(0, "<u8")
        for part in pieces(text, _LINE):
            lines = [x for x in part.split("\n") if x]
            n += len(lines)
            ends += sum(x[-1] in ".!?" for x in lines)
            if len(text) <= PIECE:
                return n, len(set(lines)), ends
            names = np.union1d(names, np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in set(lines)), "<u8"))
        return n, len(names), ends

    def __call__(self, text: str, meta: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        size, kinds = 0, np.zeros(9, np.int64)
        for k in range(0, len(text), PIECE):
            raw = np.frombuffer(text[k : k + PIECE].encode(), np.uint8)
            size += len(raw)
            kinds += np.bincount(CLASS[raw], minlength=9)
        ids, count, shapes, (n_words, chars, long, letter, caps, same) = self._words(text)
        n_lines, n_kinds, ends = self._lines(text)
        n, m, k = max(size, 1), max(n_words, 1), max(n_lines, 1)
        dense = [
            np.log1p(size) / 10, *(kinds / n)[1:9],
            np.log1p(n_words) / 10, chars / m / 10, long / m, len(ids) / m,
            1 - letter / m, caps / m, same / max(n_words - 1, 1),
            1 - n_kinds / k, np.log1p(len(text) / k) / 10,
            ends / k, *meta,
        ]
        shapes = shapes / m
        at = np.flatnonzero(shapes)
        where = np.concatenate([ids, (1 << BITS) + at, (1 << BITS) + SHAPES + np.arange(self.n_dense)])
        return where, np.concatenate([np.sqrt(count / m), shapes[at], dense]).astype(np.float32)

    def groups(self, texts: pa.Array, metas: Iterable[Sequence[float]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """Features of the texts (null: empty), a few at a time; only one text is a Python string at a time."""
        got, n = [], 0
        for text, meta in zip(texts, metas, strict=True):
            got.append(self(text.as_py() or "", meta))
            n += len(got[-1][0])
            if len(got) == ROWS or n >= FEATURES:
                yield got
                got, n = [], 0
        if got:
            yield got


class Machine:
    """w0, w and V; scores are probabilities of label 1."""

    def __init__(self, size: int, bias: float = 0.0):
        rng = np.random.default_rng(7)
        self.w0, self.w = bias, np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.01, (size, RANK)).astype(np.float32)

    def raw(self, ids: np.ndarray, x: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows ids[ptr[i]:ptr[i+1]], none of them empty, and their sums of v x."""
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, ptr[:-1], axis=0)
        squares = np.add.reduceat(vx * vx, ptr[:-1], axis=0)
        return self.w0 + np.add.reduceat(self.w[ids] * x, ptr[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, steps: int = 500, rate: float = 0.1, decay: float = 1e-5) -> None:
        """Adagrad on the logistic loss, in a fixed order: ``epochs`` rounds, or more until ``steps`` are made."""
        gw, gv, g0 = np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(max(epochs, -(-steps * 128 // len(rows)))):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 128):
                part = order[k : k + 128]
                ids = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])
                size = np.array([len(rows[i][0]) for i in part])
                ptr = np.concatenate([[0], np.cumsum(size)])
                z, sums = self.raw(ids, x, ptr)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]).astype(np.float32) / len(part)
                e = np.repeat(err, size)
                vx = self.v[ids] * x[:, None]
                each = np.concatenate([(e * x)[:, None], (e * x)[:, None] * (np.repeat(sums, size, axis=0) - vx)], axis=1)
                order_ids = np.argsort(ids, kind="stable")
                uniq, first = np.unique(ids[order_ids], return_index=True)
                grad = np.add.reduceat(each[order_ids], first, axis=0)
                dw, dv = grad[:, 0] + decay * self.w[uniq], grad[:, 1:] + decay * self.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                g0 += float(err.sum()) ** 2
                self.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= rate * 0.3 * dv / np.sqrt(gv[uniq])
                self.w0 -= rate * float(err.sum()) / np.sqrt(g0)


def _columns(docs: DataFrame, id_col: str, text_col: str, meta: Sequence[str]):
    meta = [c for c in meta if c in docs.columns]
    return [docs[id_col].alias("id"), whole(text_col).alias("text"), F.array(*[F.log1p(F.greatest(F.coalesce(docs[c].cast("double"), F.lit(0.0)), F.lit(0.0))) / 10 for c in meta] or [F.lit(0.0)]).alias("meta")]


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: Sequence[str] = ("n_chars",)) -> Machine:
    """Fit on about ``max_train`` labelled rows at most. The sample of labels is bounded, so it is broadcast."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.avg("y").alias("y"))
    n = known.count()
    share = min(1.0, max_train / n) if n else 1.0
    sample = known.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    n_meta = max(1, len(meta))

    def run(batches):
        make = Features(n_meta)
        for batch in batches:
            k = 0
            for got in make.groups(batch.column("text"), batch.column("meta").to_pylist()):
                rows, k = batch.slice(k, len(got)), k + len(got)
                yield pa.RecordBatch.from_arrays([rows.column("id").cast(pa.string()), rows.column("y"), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], ["id", "y", "ids", "x"])

    joined = docs.select(*_columns(docs, id_col, text_col, meta)).join(F.broadcast(sample), "id")
    rows = sorted(joined.mapInArrow(run, "id string, y double, ids binary, x binary").collect(), key=lambda r: (r["id"], r["ids"]))
    y = np.array([r["y"] for r in rows], np.float32)
    mean = float(y.mean()) if len(y) else 0.5
    machine = Machine(Features(n_meta).size, bias=float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))) if len(y) else 0.0)
    if len(y) and 0 < mean < 1:
        machine.fit([(np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["x"], np.float32)) for r in rows], y)
    else:
        machine.v[:] = 0
    return machine


def _scorer(machine: Machine):
    make = Features(len(machine.w) - (1 << BITS) - SHAPES - len(STATS))

    def score_all(texts: pa.Array, metas: Iterable[Sequence[float]]) -> np.ndarray:
        scores = [np.zeros(0)]
        for got in make.groups(texts, metas):
            ptr = np.concatenate([[0], np.cumsum([len(i) for i, _ in got])])
            z, _ = machine.raw(np.concatenate([i for i, _ in got]), np.concatenate([x for _, x in got]), ptr)
            scores.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        return np.concatenate(scores)

    return score_all


def _sent(docs: DataFrame, machine: Machine):
    """A broadcast of 2**BITS * (RANK + 1) floats, whatever the data; executors rebuild the machine from it."""
    return docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))


def _received(sent) -> Machine:
    m = Machine.__new__(Machine)
    m.w0, m.w, m.v = sent.value
    return m


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", meta: Sequence[str] = ("n_chars",)) -> DataFrame:
    """(id, score) of every row; narrow, no shuffle."""
    sent = _sent(docs, machine)

    def run(batches):
        score_all = _scorer(_received(sent))
        for batch in batches:
            scores = score_all(batch.column("text"), batch.column("meta").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    rows = docs.select(*_columns(docs, id_col, text_col, meta))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, machine: Machine, threshold: float, text_col: str = "text", meta: Sequence[str] = ("n_chars",)) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they came; narrow, no shuffle."""
    sent, at = _sent(docs, machine), docs.columns.index(text_col)
    places = [docs.columns.index(c) for c in meta if c in docs.columns]

    def run(batches):
        score_all = _scorer(_received(sent))
        for batch in batches:
            values = [np.log1p(np.maximum(np.nan_to_num(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)), 0)) / 10 for c in places] or [np.zeros(batch.num_rows)]
            scores = score_all(batch.column(at), np.stack(values, axis=1).tolist())
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
