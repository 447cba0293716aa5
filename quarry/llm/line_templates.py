"""Line dedup by a log-template tree (operator 8), in DataFrame functions only.

Parsing has a fixed depth: a line is first told apart by its number of tokens, then by its ``LEAD`` leading
tokens, then by its template. Tokens that hold a digit, ``@`` or ``://`` are variable fields (``<*>``). Below
a leaf a line stands for its own template and for ``PARTS`` generalised ones, in each of which one part of
the tokens after the leading ones is a variable field as well; two lines of a leaf thus meet if they differ in
one part only (a similarity of at least 1 - 1 / PARTS of those tokens). Where those tokens are fewer than
``PARTS``, a part would be more than that share of them, and a line has its own template alone.

A template recurs if it stands in ``min_docs`` independent documents or more; its lines are dropped
everywhere. Copies are no independent documents, or each line of a copied document would recur: equal texts
count as one, and so do near copies. Near copies are found over the ``SKETCH`` least hashes of a text's runs
of ``RUN`` words: the texts that hold a hash follow the first of them if at least half of both sketches is
the same (verified pair by pair), and followers of followers follow the same text. A line that documents
share is a small part of their sketches, so documents that share no more stay independent however many they
are, and each further one raises the count.

All steps are aggregations with partial sums and joins on hashes; no group is gathered. Recurring templates
and followers are broadcast only if counted to be few, else joined by shuffle.

Results for odd input: null texts stay null with 0 lines; lines without a token, or with variable fields
alone, have no template and are never dropped; a text all of whose lines go becomes empty; repeated rows count
once and are cut alike; null ids are no matter (texts are told apart by their hash); an empty table gives an
empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, fresh, store

MIN_DOCS = 10
LEAD = 2
PARTS = 4
RUN = 3
SKETCH = 16
#: Up to so many recurring templates (8 bytes each) or followers (16 bytes) are broadcast.
FEW = 1_000_000
FIELD = "<*>"
VARIABLE = "[0-9@]|://"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def plain(text: Column) -> Column:
    """Lower case, with one space for each run of blanks within a line."""
    uneven = [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\f")]
    return F.when(reduce(or_, uneven), F.regexp_replace(F.lower(text), "[ \\t\\r\\f]+", " ")).otherwise(F.lower(text))


def tokens(line: Column) -> Column:
    """Tokens of a line of :func:`plain` text."""
    toks = F.split(F.trim(line), " ")
    return F.when(line.rlike(VARIABLE), F.transform(toks, lambda t: F.when(t.rlike(VARIABLE), F.lit(FIELD)).otherwise(t))).otherwise(toks)


def templates(toks: Column) -> Column:
    """Hashes of the templates that a line's tokens stand for; each token is hashed once."""
    n = F.size(toks)
    rest = n - LEAD
    ends = [F.lit(LEAD) + F.floor(rest * s / PARTS).cast("int") for s in range(PARTS + 1)]
    parts = F.array(F.xxhash64(F.slice(toks, 1, LEAD)), *[F.xxhash64(F.slice(toks, a + 1, b - a)) for a, b in zip(ends, ends[1:], strict=False)])

    def wide(h: Column) -> Column:
        held = [h[i] for i in range(PARTS + 1)]
        return F.array(F.xxhash64(F.lit(0), n, *held), *[F.xxhash64(F.lit(s), n, *[x for i, x in enumerate(held) if i != s]) for s in range(1, PARTS + 1)])

    said = F.exists(toks, lambda t: (t != FIELD) & (t != ""))
    return F.when(~said, F.array().cast("array<bigint>")).when(rest < PARTS, F.array(F.xxhash64(F.lit(0), toks))).otherwise(_let(parts, wide))


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)]


def sketch(text: Column) -> Column:
    """The least distinct hashes of a plain text's runs of words (shorter runs at its end)."""
    words = F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        out = h
        for k in range(1, RUN):
            out = F.zip_with(out, F.slice(h, F.lit(k + 1), F.size(h)), lambda x, y: F.xxhash64(x, y))
        return out

    return F.slice(F.sort_array(F.array_distinct(_let(words, runs))), 1, SKETCH)


def parsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(th1, th2, sketch, keys: templates of each line) of each distinct text, stored."""
    text = docs[text_col]
    th1, th2 = text_key(text)
    rows = docs.where(text.isNotNull()).select(th1.alias("th1"), th2.alias("th2"), plain(text).alias("text"))
    rows = rows.select("th1", "th2", sketch(F.col("text")).alias("sketch"), F.transform(F.transform(F.split("text", "\n"), tokens), templates).alias("keys"))
    return store(rows.groupBy("th1", "th2").agg(F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "lines")


def followers(lines: DataFrame) -> DataFrame:
    """(th1, first) of the texts that are near copies of another one, stored."""
    own = lines.select("th1", "sketch")
    each = own.select("th1", F.explode("sketch").alias("h"))
    # stored, so that the joins have exchanges of their own, which Spark can split where a hash or a text is hot
    first = store(each.groupBy("h").agg(F.min("th1").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"), "firsts")
    pairs = store(each.join(first, "h").where("th1 <> first").select("th1", "first").distinct(), "pairs")
    both = pairs.join(own, "th1").join(own.select(F.col("th1").alias("first"), F.col("sketch").alias("other")), "first")
    same = F.size(F.array_intersect("sketch", "other")) * 2 >= F.greatest(F.size("sketch"), F.size("other"))
    tied = store(both.where(same).groupBy("th1").agg(F.min("first").alias("first")), "followers")
    drop(first, pairs)
    for _ in range(2):  # the first of the first; it always has a lesser hash
        up = tied.select(F.col("th1").alias("first"), F.col("first").alias("up"))
        new = store(tied.join(up, "first", "left").select("th1", F.coalesce("up", "first").alias("first")), "followers")
        drop(tied)
        tied = new
    return tied


def _with(rows: DataFrame, small: DataFrame, key: str, how: str) -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= FEW else small, key, how)


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_docs) of the templates that recur across independent documents, stored."""
    tied = followers(lines)
    own = _with(lines.select("th1", "keys"), tied, "th1", "left").select(F.coalesce("first", "th1").alias("doc"), F.explode(F.array_distinct(F.flatten("keys"))).alias("key"))
    out = store(own.distinct().groupBy("key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs), "templates")
    drop(tied)
    return out


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the lines of recurring templates cut out of ``text_col``; ``counts`` names columns for the lines of a text and those cut."""
    lines = parsed(docs, text_col)
    found = recurring(lines, min_docs)
    keys = found.select("key")
    each = lines.select("th1", "th2", F.posexplode("keys").alias("pos", "own")).select("th1", "th2", "pos", F.explode("own").alias("key"))
    gone, h1, h2 = fresh(docs, "gone", "th1", "th2")
    # stored, so that the join with all rows has an exchange of its own, which Spark can split where a text is hot
    drops = store(_with(each, keys, "key", "left_semi").groupBy("th1", "th2").agg(F.sort_array(F.collect_set("pos")).alias(gone)), "drops").withColumnsRenamed({"th1": h1, "th2": h2})
    drop(lines, found)
    cut = docs.withColumns(dict(zip((h1, h2), text_key(docs[text_col]), strict=True))).join(drops, [h1, h2], "left")
    text, none = F.col(f"`{text_col}`"), F.col(gone).isNull()
    kept = F.when(none, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n"))
    out = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        out.append(F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias(counts[0]))
        out.append(F.when(none, 0).otherwise(F.size(gone)).cast("long").alias(counts[1]))
    return cut.select(*out)
