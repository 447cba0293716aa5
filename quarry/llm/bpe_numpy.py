"""Byte-level BPE over padded numpy matrices (operator 2).

Distinct pieces are put in matrices by length bucket. In each round every row merges its leftmost
pair of minimum rank; pair ranks come from an open-addressing hash table held in numpy arrays, and
after each round rows are compacted (closed up by one) and finished rows leave the matrix.

Long rows may take the same steps several rounds at a time (``_batched``): all occurrences of the
minimum pair merge at once, but only where no pair that would have existed in between has a lower
rank, so the result is the same as one merge a round.

Results for odd input: null and empty texts give no ids; lone surrogates cannot occur in Spark
strings; pieces of any length are encoded whole; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import slices, whole

#: Larger than any rank.
NONE = np.int32(2**31 - 1)
#: Rows of this many ids or more merge all safe occurrences of a pair at once.
LONG = 48
#: Pieces kept per worker; beyond it the memo starts anew, so memory stays bounded.
MEMO = 250_000


class PairTable:
    """(left id, right id) -> merged id, by multiplicative hashing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), np.uint64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        vals, todo, slot = np.array(out, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(todo):  # each free slot takes the first key that asks for it, the others go one on
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            asking, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[asking], self.vals[asking] = keys[won], vals[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none or where a side is padding (negative)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        want, slot = keys[todo], None
        slot = self._slot(want)
        while len(todo):
            there = self.keys[slot]
            hit = there == want
            out[todo[hit]] = self.vals[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo, want, slot = todo[on], want[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Codec:
    """Encoder and decoder for ranks in a tiktoken file and a pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = PairTable(ranks)
        self.whole = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.findall = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    # -- one matrix ---------------------------------------------------------------------------
    def merge(self, tok: np.ndarray) -> list[np.ndarray]:
        """The ids of each row. tok: int32, rows padded with -1 on the right."""
        n = len(tok)
        out: list[np.ndarray] = [None] * n
        row = np.arange(n)
        size = (tok >= 0).sum(axis=1)
        rank = self.pairs.look(tok[:, :-1], tok[:, 1:]) if tok.shape[1] > 1 else np.full((n, 0), NONE, np.int32)
        while len(row):
            if rank.shape[1]:
                at = rank.argmin(axis=1)  # leftmost minimum
                low = rank[np.arange(len(row)), at]
            else:
                at, low = np.zeros(len(row), np.int64), np.full(len(row), NONE, np.int32)
            done = low == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = tok[i, : size[i]].copy()
                live = ~done
                row, tok, rank, size, at, low = row[live], tok[live], rank[live], size[live], at[live], low[live]
                if not len(row):
                    break
                width = int(size.max())
                tok, rank = tok[:, :width], rank[:, : max(width - 1, 0)]
            if tok.shape[1] >= LONG:
                tok, size = self._batched(tok, rank, size, at, low)
                rank = self.pairs.look(tok[:, :-1], tok[:, 1:])
            else:
                tok, rank = self._one(tok, rank, at, low)
                size = size - 1
        return out

    def _one(self, tok, rank, at, low):
        """Each row merges the pair at ``at`` and closes up by one."""
        i = np.arange(len(tok))
        tok[i, at] = low
        col = np.arange(tok.shape[1] - 1)
        shut = col[None, :] + (col[None, :] > at[:, None])
        tok = np.concatenate([np.take_along_axis(tok, shut, 1), np.full((len(tok), 1), -1, np.int32)], axis=1)
        rcol = np.arange(rank.shape[1] - 1)
        rank = np.concatenate([np.take_along_axis(rank, rcol[None, :] + (rcol[None, :] >= at[:, None]), 1), np.full((len(tok), 1), NONE, np.int32)], axis=1)
        rank[i, at] = self.pairs.look(tok[i, at], tok[i, np.minimum(at + 1, tok.shape[1] - 1)])
        rank[at + 1 >= tok.shape[1], -1] = NONE
        has = np.flatnonzero(at > 0)
        rank[has, at[has] - 1] = self.pairs.look(tok[has, at[has] - 1], tok[has, at[has]])
        return tok[:, :-1], rank[:, :-1] if rank.shape[1] else rank

    def _batched(self, tok, rank, size, at, low):
        """All occurrences of each row's minimum pair, left to right, where that equals merging one a round."""
        n, width = tok.shape
        hit = rank == low[:, None]  # starts of the pair
        # overlapping starts (a run of one repeated id): every other one of a run merges
        run = np.arange(width - 1)[None, :] - np.maximum.accumulate(np.where(hit, -1, np.arange(width - 1)[None, :]), axis=1)
        hit &= run % 2 == 1
        r, c = np.nonzero(hit)
        merged = low[r]
        gone = np.zeros((n, width), bool)
        gone[r, c + 1] = True
        new = tok.copy()
        new[r, c] = merged
        # neighbours when this pair merges: the left one is merged already, the right one is not yet
        left_at = np.where(c > 0, c - 1, 0)
        left_at = np.where(gone[r, left_at] & (c > 0), left_at - 1, left_at)
        left = np.where(c > 0, new[r, left_at], -1)
        right = np.where(c + 2 < width, tok[r, np.minimum(c + 2, width - 1)], -1)
        lower = np.minimum(self.pairs.look(left.astype(np.int32), merged), self.pairs.look(merged, right.astype(np.int32))) < merged
        if lower.any():  # these rows take one merge this round
            single = np.zeros(n, bool)
            single[r[lower]] = True
            s = np.flatnonzero(single)
            new[s], gone[s] = tok[s], False
            new[s, at[s]] = low[s]
            gone[s, at[s] + 1] = True
        size = size - gone.sum(axis=1)
        new[gone] = -2
        order = np.argsort(gone, axis=1, kind="stable")  # compaction: what is gone moves to the end
        new = np.take_along_axis(new, order, 1)
        new[np.arange(width)[None, :] >= size[:, None]] = -1
        return np.ascontiguousarray(new[:, : max(int(size.max()), 2)]), size

    # -- pieces and texts ---------------------------------------------------------------------
    def pieces(self, pieces: list[str]) -> None:
        """Put the ids of these distinct pieces in the memo."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        todo = []
        for i, b in enumerate(raw):
            if (r := self.whole.get(b)) is not None:  # a whole token is never cut
                self.memo[pieces[i]] = r.to_bytes(4, "little")
            else:
                todo.append(i)
        size = np.array([len(raw[i]) for i in todo], np.int64)
        bucket = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)))).astype(int)
        for b in np.unique(bucket):
            own = [todo[j] for j in np.flatnonzero(bucket == b)]
            step = max(1, (1 << 21) >> int(b))  # at most 2M cells a matrix, unless one piece has more
            for k in range(0, len(own), step):
                part = own[k : k + step]
                lens = np.array([len(raw[i]) for i in part])
                tok = np.full((len(part), max(2, int(lens.max()))), -1, np.int32)
                tok[np.arange(tok.shape[1])[None, :] < lens[:, None]] = self.byte[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                for i, ids in zip(part, self.merge(tok), strict=True):
                    self.memo[pieces[i]] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str], chars: int = 4_000_000) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        part: list[list[str]] = []
        held = 0
        for k, text in enumerate(texts):
            part.append(self.findall(text))
            held += len(text)
            if held >= chars or k + 1 == len(texts):
                if len(self.memo) > MEMO:
                    self.memo.clear()
                new = set()
                for words in part:
                    new.update(words)
                memo = self.memo
                if new := [w for w in new if w not in memo]:
                    self.pieces(new)
                out += [b"".join([memo[w] for w in words]) for words in part]
                part, held = [], 0
        return out

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian uint32, decoded binary) of every whole text; narrow, no shuffle.

    ``ranks_path`` is read on the executors, from the tokenizer package installed there.
    """

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in slices(batches):
            ids = c.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), whole(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The same pass, returning lengths and digests of ids and decoded bytes, and with ``with_ids`` the ids."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids = c.encode(texts)
            back = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([b == t.encode() for b, t in zip(back, texts, strict=True)]),
                    *[pa.array(ids, pa.binary())] * with_ids,
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *["ids"] * with_ids],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), whole(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)
