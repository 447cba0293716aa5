"""Language identification by compression (operator 9).

Each language has a raw-content zstandard dictionary made of its own texts. Texts are folded first (lower
case, every run of other characters than letters as one space); a folded text is cut into blocks, every block
is compressed with every language's dictionary, and the language with the smallest total wins, whatever the
text's length. Where the best total is within ``min_margin`` of the next, the answer is rejected: the
prediction stays, ``rejected`` is true and the score is below 0.5.

Training takes a bounded sample: up to ``sample_rows`` labelled rows a language (those of smallest hash
of their text). A dictionary takes whole texts of that sample, in the order of their hashes, as long as they
fit in ``dict_bytes`` bytes; a text that does not fit is passed over, and if none fits the shortest one is the
dictionary. Prediction reads whole texts.

Results for odd input: a text that is null or has no letter gives ``und`` with score 0 and rejected;
equal totals go to the alphabetically first language; rows without language or text teach nothing; with
nothing to learn from every row gets ``und``; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole

BLOCK = 4096
LEVEL = 6
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).strip().encode()


def train(docs: DataFrame, sample_rows: int = 400, dict_bytes: int = 100_000, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content by language, from a bounded sample of the labelled rows."""
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * sample_rows / n))])
    # the hash decides who is in the sample, whatever the partitioning; texts come to the driver only once they are known to fit
    placed = known.withColumns({"k": F.xxhash64("text"), "h": F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)}).where(F.col("h") < share[F.col("lang")])
    sizes = placed.groupBy("lang", "k").agg(F.min("h").alias("h"), F.min(F.octet_length("text")).alias("size")).collect()
    chosen: set[tuple[str, int]] = set()
    for lang in counts:
        own, room = sorted((r for r in sizes if r["lang"] == lang), key=lambda r: (r["h"], r["k"]))[:sample_rows], dict_bytes
        for r in own:
            if r["size"] <= room:
                room -= r["size"] + 1
                chosen.add((lang, r["k"]))
        if own and room == dict_bytes:
            chosen.add((lang, min(own, key=lambda r: (r["size"], r["h"], r["k"]))["k"]))
    keys = sorted({k for _, k in chosen})
    rows = placed.where(F.col("k").isin(keys)).groupBy("lang", "k").agg(F.min("h").alias("h"), F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts):
        own = sorted((r["h"], r["k"], r["text"]) for r in rows if (r["lang"], r["k"]) in chosen and r["lang"] == lang)
        out[lang] = b" ".join(fold(t) for *_, t in own)
    return {k: v for k, v in out.items() if v.strip()}


class Judge:
    def __init__(self, contents: dict[str, bytes], min_margin: float):
        import zstandard as z

        self.langs, self.min_margin = sorted(contents), min_margin
        params = z.ZstdCompressionParameters.from_level(LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0, min_match=3)
        self.by = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(contents[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def __call__(self, text: str) -> tuple[str, float, bool]:
        if not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        raw = fold(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        totals = [sum(len(compress(b)) for b in blocks) for compress in self.by]
        order = sorted(range(len(totals)), key=lambda i: (totals[i], self.langs[i]))
        best = order[0]
        if len(order) == 1:
            return self.langs[best], 1.0, False
        margin = 1 - totals[best] / totals[order[1]]
        rejected = margin < self.min_margin
        score = 0.5 * margin / self.min_margin if rejected else 0.5 + 0.5 * min(1.0, margin / 0.2)
        return self.langs[best], score, rejected


def predict(docs: DataFrame, contents: dict[str, bytes], min_margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row; narrow, no shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(contents)  # dict_bytes a language

    def run(batches):
        judge = Judge(sent.value, min_margin)
        for batch in batches:
            got = [judge(t) for t in batch.column(1).to_pylist()]
            langs, scores, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), whole(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
