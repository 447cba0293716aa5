"""Operators 1 and 2 against the libraries whose results they must equal."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe_numpy, token_files
from quarry.llm.common import new_path

from .conftest import ODD, prose

RANKS = bpe_numpy.read_ranks(P.path("byte_bpe_50k.tiktoken"))
CODEC = bpe_numpy.Codec(RANKS, P.PATTERN)
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def _ids(text):
    return np.array(WANT.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="aehint ", max_size=400) | st.integers(1, 500).map(lambda n: "ab" * n))
def test_bpe_equals_library(text):
    got = CODEC.encode([text])[0]
    assert got == _ids(text)
    assert CODEC.decode(got) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "=-" * 800, "the" * 900, "aaab" * 500, "é" * 700, "\U0001f600" * 200])
def test_bpe_of_long_pieces(text):
    assert CODEC.encode([text])[0] == _ids(text)


def test_bpe_small_memo(monkeypatch):
    monkeypatch.setattr(bpe_numpy, "MEMO", 3)
    c = bpe_numpy.Codec(RANKS, P.PATTERN)
    texts = ["one two three four", "five six seven", "one eight nine"]
    assert c.encode(texts, chars=1) == [_ids(t) for t in texts]


def test_bpe_query_rows(spark, frame, rng):
    rows = [(i, prose(rng, n=200), "en") for i in range(5)] + ODD
    out = bpe_numpy.digests(frame(rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert len(out) == len(rows)
    for r, (i, text, _) in zip(sorted(out, key=lambda r: str((r["doc_id"], r["ids"]))), sorted(rows, key=lambda r: str((r[0], _ids(r[1] or "")))), strict=True):
        ids = _ids(text or "")
        assert (r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["ids_sha256"], r["round_trip"]) == (i, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), True)
    assert bpe_numpy.digests(frame([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


LIBRARY = Tokenizer.from_file(P.path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120) | st.text(alphabet="aZé1²'_- \n\t.sİΣ", max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "endoftext", "|>", " ", "a"]), max_size=9).map("".join))
def test_word_encoder_equals_library(text):
    assert token_files.encoder(P.path("word_bpe_49k.json")).encode(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _written(spark, docs, **more):
    base = new_path(spark, "test-tokens")
    files = token_files.starts(token_files.write(docs, base, P.path("word_bpe_49k.json"), 1, **more).collect())
    return base, files


def test_token_files_round_trip(spark, frame, rng):
    rows = [(i, prose(rng, n=rng.randint(1, 400)), "en") for i in range(40)] + [(50, "hello <|endoftext|> world <|EndOfText|>", "en")] + ODD
    base, files = _written(spark, frame(rows), seq_len=64, parts=3)
    got = sorted(map(tuple, token_files.read_back(spark, base, files).select("start", "doc_id", "n_tokens", "ids_crc32").collect()), key=str)
    start, want = 0, []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want, key=str)


def test_sequences_are_views_with_masks(spark, frame, rng):
    base, files = _written(spark, frame([(i, prose(rng, n=300), "en") for i in range(6)]), seq_len=64, parts=1)
    part = token_files.Part(base, files[0][1])
    n = sum(len(b) for b in part.batches)
    ids, mask = part.sequence(n - 1)
    assert len(ids) == 64 and ids.dtype == np.uint16 and not ids.flags.owndata
    real = np.unpackbits(mask, bitorder="little")
    total = sum(d["length"] for d in part.docs.to_pylist())
    assert real.sum() == total - 64 * (n - 1) and not ids[real == 0].any()
    assert (np.unpackbits(part.sequence(0)[1], bitorder="little") == 1).all()


def test_token_files_of_nothing(spark, frame):
    base, files = _written(spark, frame([]))
    assert files == [] and token_files.read_back(spark, base, files).count() == 0


def test_queries_on_driver_table(spark):
    from quarry.llm import queries

    one, two = (queries.QUERIES[q](spark, DATA).toPandas() for q in ("op1_token_files", "op2_byte_bpe"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id")
    one, two = one.sort_values("doc_id"), two.sort_values("doc_id")
    assert list(one.doc_id) == list(docs.doc_id) == list(two.doc_id)
    assert list(two.ids_sha256) == [hashlib.sha256(_ids(t)).hexdigest() for t in docs.text]
    assert list(two.decoded_sha256) == [hashlib.sha256(t.encode()).hexdigest() for t in docs.text]
    assert list(one.start) == [0, *np.cumsum(one.n_tokens)[:-1]]
