"""Benchmark decontamination by pigeonhole edit matching (operator 4).

Texts and items are folded (lower case, every run of other characters than letters and digits as one space).
An item of n characters may be met with k = floor(error_rate * n) edits. It is cut into k + 1 pieces; an
occurrence with at most k edits holds at least one piece unchanged, so all occurrences lie around exact piece
hits (one Aho-Corasick automaton over all pieces). A hit is verified by Myers' bit-parallel distance over
its window; before that a q-gram count (a necessary condition, so nothing is lost) drops most chance hits.

Items come in blocks of at most ``block_chars`` folded characters; each block is one narrow pass over the
texts with a broadcast of that bounded size, however many items there are.

Items shorter than ``min_chars`` after folding (k below 3) would be met by chance in ordinary prose; they are
searched unchanged and as whole words.

Results for odd input: null and empty texts match nothing; items that are null or empty after folding match
nothing; items with equal text match alike; rows with
null id give rows with null id; repeated rows give repeated results; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole

ERROR_RATE = 0.1
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000
Q = 5
OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def grams(codes: np.ndarray) -> np.ndarray:
    """16-bit hashes of all q-grams."""
    if len(codes) < Q:
        return np.zeros(0, np.uint16)
    h = np.zeros(len(codes) - Q + 1, np.uint32)
    for i in range(Q):
        h = h * np.uint32(0x01000193) + codes[i : len(codes) - Q + 1 + i]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.uint16)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Pattern:
    """One item: Myers' masks, its q-grams and its pieces."""

    def __init__(self, text: str, error_rate: float):
        self.text, self.n = text, len(text)
        self.k = int(error_rate * self.n)
        self.full, self.top = (1 << self.n) - 1, 1 << (self.n - 1)
        self.peq, self.back = self._masks(text), self._masks(text[::-1])
        self.has = np.zeros(1 << 16, bool)
        self.has[grams(codes(text))] = True
        self.need = self.n + 1 - Q - self.k * Q
        cuts = [self.n * i // (self.k + 1) for i in range(self.k + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << i
        return out

    def search(self, text: str, peq: dict[str, int] | None = None, anchored: bool = False) -> tuple[int, int]:
        """(least distance of any substring of text, its first end); anchored: substrings from the start only."""
        peq, full, top = peq or self.peq, self.full, self.top
        pv, mv, score, best, at = full, 0, self.n, self.n, 0
        for j, c in enumerate(text, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph = (ph << 1 | anchored) & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, at = score, j
        return best, at

    def verify(self, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best occurrence in text[lo:hi] if it has at most k edits."""
        best, end = self.search(text[lo:hi])
        if best > self.k:
            return None
        _, size = self.search(text[lo : lo + end][::-1], self.back, True)
        return best, lo + end - size, lo + end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.by: dict[str, list] = {}
        for item_id, text in items:  # equal texts are searched once
            self.by.setdefault(text, []).append(item_id)
        self.patterns = [Pattern(t, error_rate) for t in self.by]
        self.ids = list(self.by.values())
        where: dict[str, list[tuple[int, int]]] = {}
        for i, p in enumerate(self.patterns):
            if p.n < min_chars:
                p.k, p.pieces = 0, [(0, p.text)]
            p.words = p.n < min_chars
            for a, piece in p.pieces:
                where.setdefault(piece, []).append((i, a))
        self.machine = ahocorasick.Automaton()
        for piece, hits in where.items():
            self.machine.add_word(piece, (len(piece), hits))
        self.machine.make_automaton()

    def __call__(self, text: str) -> list[tuple]:
        """(item id, distance, start, end) of the best occurrence of each item in the folded text."""
        found: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int]] = set()
        hashes = None
        for end, (size, hits) in self.machine.iter(text):
            for i, offset in hits:
                p = self.patterns[i]
                at = end + 1 - size - offset  # where the item starts without edits before the piece
                if p.words:
                    if i not in found and text[at - 1 : at] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                        found[i] = (0, at, end + 1)
                    continue
                cell = (i, at // (p.k + 1))  # hits of one cell share a window
                if cell in seen:
                    continue
                seen.add(cell)
                first = cell[1] * (p.k + 1)
                lo, hi = max(0, first - p.k), min(len(text), first + p.k + p.n + p.k)
                if p.need > 0:
                    if hashes is None:
                        hashes = grams(codes(text))
                    if np.count_nonzero(p.has[hashes[lo : max(lo, hi - Q + 1)]]) < p.need:
                        continue
                got = p.verify(text, lo, hi)
                if got and (i not in found or got < found[i]):
                    found[i] = got
        return [(item, *got) for i, got in sorted(found.items()) for item in self.ids[i]]


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int):
    """Folded items, a bounded number of characters at a time."""
    rows = items.select(items[id_col].cast("long").alias("id"), items[text_col].alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()
        folded = sorted((r["id"] is not None, r["id"] or 0, t) for r in part if (t := fold(r["text"])))
        if folded:
            yield [(i if there else None, t) for there, i, t in folded]


MATCHES = "id {kind}, item_id long, distance int, start int, end int, error_rate double"


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, distance, start, end, error_rate): the best occurrence of each item in each text that has it.

    Positions count characters of the folded text.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), whole(text_col).alias("text"))
    schema = MATCHES.format(kind=rows.schema["id"].dataType.simpleString())
    out = None
    for block in blocks(items, item_col, item_text, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            match = Matcher(sent.value, error_rate, min_chars)
            size = {}
            for i, t in sent.value:
                size[i] = len(t)
            for batch in batches:
                ids, got = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    if text:
                        hits = match(fold(text))
                        ids += [k] * len(hits)
                        got += hits
                cols = list(zip(*got, strict=True)) if got else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(ids, pa.int64())),
                        pa.array(cols[0], pa.int64()),
                        *[pa.array(c, pa.int32()) for c in cols[1:]],
                        pa.array([d / size[i] for i, d in zip(cols[0], cols[1], strict=True)], pa.float64()),
                    ],
                    ["id", "item_id", "distance", "start", "end", "error_rate"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("id", id_col)


def flags(docs: DataFrame, items: DataFrame, text_col: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they came; narrow."""
    spark, schema = docs.sparkSession, docs.schema
    at = docs.columns.index(text_col)
    out = docs
    for block in blocks(items, item_col, item_text, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            match = Matcher(sent.value, error_rate, min_chars)
            for batch in batches:
                clean = [not (t and match(fold(t))) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
