"""Token ids in Arrow stream files of fixed-size-list batches (operator 1).

A dataset is a folder of parts. ``part-N.arrows`` is an Arrow IPC stream; each row is one sequence of
``seq_len`` ids (``ids``: fixed-size list of uint16, or of uint32 where the vocabulary needs it) and
``mask``: fixed-size list of uint8 with one bit per id, lowest bit first, set where the id is real.
All batches but a part's last hold ``BATCH_ROWS`` rows, so sequence k lies in batch k // BATCH_ROWS;
opened by memory map the columns are views of the file. ``part-N.docs.arrows`` lists the documents of
the part in order: doc_id, offset in the part's ids, length. Parts follow each other in ascending
doc_id order; only the last sequence of a part is padded (with zeros, mask bits unset).

Writers put a part under a name of their own attempt and rename it when complete; only the names in
the manifest that the job returns count, so lost executors and repeated tasks leave no half parts.

Results for odd input: null and empty texts hold the end id alone; rows with null id come first;
repeated ids keep all their rows, next to each other; an empty table gives an empty manifest; other
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import whole

SEQ_LEN = 2048
BATCH_ROWS = 64
#: Memo entries per worker; beyond it the memo starts anew.
MEMO = 1_000_000


class WordEncoder:
    """``tokenizers`` encoding of whole texts, with a memo of chunks between white space.

    The vocabulary drops white space and never joins across it, so the ids of a text are those of its
    chunks, one after the other. That holds for texts without characters of ``OTHER`` (on the rest lower-casing
    and normalisation act character by character) and without an added token of the vocabulary, in whatever
    case; any other text goes to the library as a whole.
    """

    OTHER = re.compile("[^\\x20-\\x7e\\n\\t\\r\\xa0-\\u012f\\u0131-\\u024f]")
    PART = re.compile(r"[^\W\d_]+|[\W\d_]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or "(?!)", re.I)
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _library(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            got = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            ends = np.searchsorted(owner, np.arange(len(part) + 1))
            for w, a, b in zip(part, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                self.parts[w] = ids[a:b].tobytes()

    def _learn(self, chunks: set[str]) -> None:
        # letters end a token wherever other characters begin, except in contractions, which stay whole
        cut = {c: [c] if "'" in c else self.PART.findall(c) for c in chunks}
        need = {p for x in cut.values() for p in x if p not in self.parts}
        if need:
            self._library(sorted(need))
        parts = self.parts
        for c, x in cut.items():
            self.memo[c] = b"".join([parts[p] for p in x])

    def encode(self, text: str) -> bytes:
        if self.OTHER.search(text) or self.added.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
                self.parts.clear()
            self._learn({w for w in words if w not in memo})
            return b"".join([memo[w] for w in words])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class PartWriter:
    """One part: ids in, full sequences out batch by batch."""

    def __init__(self, base: str, name: str, seq_len: int, wide: bool):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.temp, self.seq_len = name, f"{name}.{uuid.uuid4().hex}.tmp", seq_len
        self.kind = pa.uint32() if wide else pa.uint16()
        self.np = np.dtype("<u4" if wide else "<u2")
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.uint8(), seq_len // 8))])
        self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}.arrows")
        self.ids = pa.ipc.new_stream(self.out, self.schema)
        self.docs_out = self.fs.open_output_stream(f"{self.root}/{self.temp}.docs.arrows")
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        self.docs = pa.ipc.new_stream(self.docs_out, self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0
        self.index: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n_ids, len(ids)))
        self.held.append(ids.astype(self.np))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += 1
        if self.n_held >= self.seq_len * BATCH_ROWS:
            self._flush(False)
        if len(self.index) >= 50_000:
            self._flush_index()

    def _flush_index(self) -> None:
        if self.index:
            cols = list(zip(*self.index, strict=True))
            self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=self.docs_schema))
            self.index = []

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.np)
        block = self.seq_len * BATCH_ROWS
        end = len(flat) if last else len(flat) // block * block
        for k in range(0, end, block):
            part = flat[k : min(k + block, end)]
            rows = -(-len(part) // self.seq_len)
            ids = np.zeros(rows * self.seq_len, self.np)
            ids[: len(part)] = part
            mask = np.zeros(rows * self.seq_len, bool)
            mask[: len(part)] = True
            self.ids.write_batch(
                pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(mask, bitorder="little")), self.seq_len // 8)],
                    schema=self.schema,
                )
            )
        self.held, self.n_held = [flat[end:]], len(flat) - end

    def close(self) -> str:
        self._flush(True)
        self._flush_index()
        for x in (self.ids, self.out, self.docs, self.docs_out):
            x.close()
        final = self.temp.removesuffix(".tmp")
        for ext in (".arrows", ".docs.arrows"):
            self.fs.move(f"{self.root}/{self.temp}{ext}", f"{self.root}/{final}{ext}")
        return final


MANIFEST = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())]
)


def write(docs: DataFrame, base: str, tokenizer_path: str, end_id: int, seq_len: int = SEQ_LEN, wide: bool = False, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Write all documents under ``base`` (a URI that executors can write); returns the manifest, lazily.

    One shuffle: texts are dealt by ranges of id. ``wide`` takes uint32 where ids exceed 65,535.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, end, part, no = encoder(tokenizer_path), np.array([end_id], "<u4"), None, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = part or PartWriter(base, f"part-{no:06d}", seq_len, wide)
                part.add(doc_id, np.concatenate([np.frombuffer(enc.encode(text), "<u4"), end]))
        if part:
            name = part.close()
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([name]), pa.array([part.n_docs]), pa.array([part.n_ids])], ["part", "name", "n_docs", "n_ids"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), whole(text_col).alias("text"))
    dealt = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()) if parts else rows.repartitionByRange(F.col("id").asc_nulls_first())
    return dealt.sortWithinPartitions(F.col("id").asc_nulls_first()).mapInArrow(run, MANIFEST)


def starts(manifest: list) -> list[tuple]:
    """(part, name, ids in all parts before) from the collected manifest, one row per file."""
    out, total = [], 0
    for r in sorted(manifest, key=lambda r: r["part"]):
        out.append((r["part"], r["name"], total))
        total += r["n_ids"]
    return out


class Part:
    """Random access to one part; over a local file the arrays are views of the memory map."""

    def __init__(self, base: str, name: str):
        fs, root = pafs.FileSystem.from_uri(base)
        local = isinstance(fs, pafs.LocalFileSystem)
        open_ = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.batches = list(pa.ipc.open_stream(open_(f"{root}/{name}.arrows")))
        docs = list(pa.ipc.open_stream(open_(f"{root}/{name}.docs.arrows")))
        self.docs = pa.Table.from_batches(docs) if docs else None

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, packed mask) of sequence k, without a copy."""
        b, i = self.batches[k // BATCH_ROWS], k % BATCH_ROWS
        return tuple(c.values.to_numpy(zero_copy_only=True).reshape(len(c), -1)[i] for c in b.columns)

    def span(self, start: int, length: int) -> np.ndarray:
        """Ids [start, start + length) of the part, as uint32."""
        seq = len(self.batches[0].column(0).values) // len(self.batches[0].column(0))
        block, out = seq * BATCH_ROWS, []
        while length > 0:
            flat = self.batches[start // block].column(0).values.to_numpy(zero_copy_only=True)
            got = flat[start % block : start % block + length]
            out.append(got)
            start, length = start + len(got), length - len(got)
        return np.concatenate(out).astype("<u4") if out else np.zeros(0, "<u4")


def read_back(spark, base: str, files: list[tuple]) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                part = Part(base, name)
                for docs in part.docs.to_batches():
                    offset, length = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(part.span(a, n).tobytes()) for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(offset + before), docs.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(files, "part int, name string, before long").repartition(max(1, min(len(files), 10_000)), "part")
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
