"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe_numpy, decontaminate, langid_zstd, line_templates, near_dup, nn_descent, quality_fm, suffix_dedup, token_files, url_filter
from quarry.llm.common import new_path, read


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "tokens")
    manifest = token_files.write(read(spark, sf_dir, "documents"), base, public("word_bpe_49k.json"), end_id=1).collect()
    return token_files.read_back(spark, base, token_files.starts(manifest))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_numpy.digests(read(spark, sf_dir, "documents"), public("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: (verdict, host and path), as the contract of operator 5 fixes them.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(read(spark, sf_dir, "documents"), with_bytes=False)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(read(spark, sf_dir, "documents"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_templates.dedup(read(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _fold(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string")) % n


def op9_langid_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    contents = langid_zstd.train(docs.where(_fold("doc_id", 4) != 2))
    return langid_zstd.predict(docs, contents).select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = quality_fm.train(docs, read(spark, sf_dir, "labels").where(_fold("doc_id", 5) != 0))
    return quality_fm.score(docs, machine).select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


#: From this score on a document counts as good.
QUALITY_AT = 0.3

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_nn_descent": op3_nn_descent,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_near_dup": op7_near_dup,
    "op8_line_templates": op8_line_templates,
    "op9_langid_zstd": op9_langid_zstd,
    "op10_quality_fm": op10_quality_fm,
}
#: Exhaustive counts: every pair of vectors, every window of 400 bytes.
ORACLES: dict[str, str] = {
    "op3_nn_descent": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT src, dst FROM links UNION SELECT reach.src, links.dst FROM reach JOIN links ON reach.dst = links.src),
c AS (SELECT src AS vec_id, min(dst) AS least FROM reach GROUP BY src),
n AS (SELECT src AS vec_id, count(*) AS n_links FROM links GROUP BY src)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, least(vec_id, coalesce(least, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op6_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(1, n - 398)) AS p FROM d WHERE n >= 400),
k AS (SELECT w.doc_id, w.p, md5(b[w.p:w.p + 399]) AS h FROM w JOIN d USING (doc_id)),
r AS (SELECT doc_id, p, lag(p) OVER o AS before, lead(p) OVER o AS after
      FROM k SEMI JOIN (SELECT h FROM k GROUP BY h HAVING count(*) > 1) USING (h) WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, sum(least(coalesce(after - p, 400), 400))::BIGINT AS n_removed, count(*) FILTER (before IS NULL OR p - before > 400) AS n_spans FROM r GROUP BY doc_id),
e AS (SELECT doc_id, p + 400 AS a, coalesce(after, n + 1) AS z FROM r JOIN d USING (doc_id) WHERE after IS NULL OR after - p > 400
      UNION ALL SELECT doc_id, 1, min(p) FROM r GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(hex(b[a:z - 1]), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) WHERE z > a GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
