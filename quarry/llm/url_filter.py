"""URL filter: rules first, then word segmentation and naive Bayes (operator 5).

A unigram model of words, counted over all page texts, splits the concatenated names in host and path by
Viterbi; a multinomial naive Bayes over the words scores each url. It learns from weak labels that come from
the pages' contents alone, never from an url: a page teaches "unwanted" if its visible text is no prose, that
is if it has fewer than ``MIN_WORDS`` words, more than ``MAX_MARKS`` marks other than punctuation a word, a
word that makes up more than ``MAX_SAME`` of them, or more than ``MAX_LINKED`` of them inside links. An url is
thus blocked if the words of its name stand, over all pages, for pages without prose.

All words and all urls count, nothing is cut off. The model is never sent around as a whole: a name meets the
counts of its own substrings by a join, and an url the odds of its own words. Pages are parsed once.

Results for odd input: null urls and urls without ``://`` have an empty host and path, no rule and the
verdict allow, as any url without a known word; null page texts have no words and teach nothing; repeated rows
give repeated results; with no words to learn from, names are unknown words; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, slices, store

#: Added to every word count of naive Bayes.
ALPHA = 0.1
MIN_WORDS = 20
MAX_MARKS = 0.25
MAX_SAME = 0.25
MAX_LINKED = 0.5
#: Word counts that a task holds before it passes them on.
HELD = 200_000
TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
LINK = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.S | re.I)
WORD = re.compile(r"[^\W\d_]{2,}")
MARK = re.compile(r"[^\w\s.,;:!?'\"()\-]")
PIECE = re.compile(r"[^\W\d_]+")


def host_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. rules: (verdict, host and path)."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def visible(html: str) -> tuple[str, list[str]]:
    """The visible text, and its words in lower case."""
    text = TAG.sub(" ", html)
    return text, WORD.findall(text.lower())


def unwanted(html: str, text: str, words: Sequence[str]) -> bool:
    """The weak label of a page, by its visible text."""
    if len(words) < MIN_WORDS:
        return True
    linked = sum(len(visible(m)[1]) for m in LINK.findall(html))
    return len(MARK.findall(text)) > MAX_MARKS * len(words) or Counter(words).most_common(1)[0][1] > MAX_SAME * len(words) or linked > MAX_LINKED * len(words)


def pieces(host: str, path: str) -> list[str]:
    """The names in host and path: runs of letters."""
    return PIECE.findall(host + " " + path.lower())


def parsed(pages: DataFrame, url_col: str, text_col: str) -> DataFrame:
    """Stored rows of two kinds: (word, n) of page texts, and (host, path, names, n, n_bad, n_good) of urls."""
    columns = ["word", "host", "path", "names", "n", "bad", "good"]

    def counts(held: Counter):
        none = pa.nulls(len(held), pa.string())
        zero = pa.array([0] * len(held), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), none, none, pa.nulls(len(held), pa.list_(pa.string())), pa.array(list(held.values()), pa.int64()), zero, zero], columns)

    def run(batches):
        held: Counter = Counter()
        for batch in slices(batches):
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            bad = []
            for html in batch.column("html").to_pylist():
                text, words = visible(html or "")
                held.update(words)
                bad.append(None if html is None else unwanted(html, text, words))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(bad), pa.string()), batch.column("host"), batch.column("path"), pa.array([pieces(h, p) for h, p in zip(hosts, paths, strict=True)], pa.list_(pa.string())),
                    *[pa.array(x, pa.int64()) for x in ([1] * len(bad), [int(b is True) for b in bad], [int(b is False) for b in bad])],
                ],
                columns,
            )
            if len(held) > HELD:
                yield counts(held)
                held = Counter()
        yield counts(held)

    host, path = host_path(pages[url_col])
    rows = pages.select(host.alias("host"), path.alias("path"), pages[text_col].alias("html"))
    return store(rows.mapInArrow(run, "word string, host string, path string, names array<string>, n long, bad long, good long"), "pages")


def split(name: str, logp: dict[str, float]) -> list[str]:
    """Most probable split; an unknown word of length k costs as much as k letters and a start."""
    longest = max(map(len, logp), default=0)
    best: list[tuple[float, int]] = [(0.0, 0)]
    alone = 0  # the best start of an unknown word that ends here: its cost is linear in its length
    for end in range(1, len(name) + 1):
        if best[end - 1][0] + 2.5 * (end - 1) > best[alone][0] + 2.5 * alone:
            alone = end - 1
        top = (best[alone][0] - 12.0 - 2.5 * (end - alone), alone)
        for start in range(max(0, end - longest), end):
            p = logp.get(name[start:end])
            if p is not None and best[start][0] + p > top[0]:
                top = (best[start][0] + p, start)
        best.append(top)
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def substrings(name: str, longest: int) -> Iterable[str]:
    return {name[a:b] for a in range(len(name)) for b in range(a + 2, min(len(name), a + longest) + 1)}


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names: the known words of each one's best split, stored. counts: (word, n)."""
    total, longest = counts.agg(F.sum("n"), F.max(F.length("word"))).first()

    def spread(batches):
        for batch in slices(batches, 1024):
            each = [(n, s) for n in batch.column(0).to_pylist() for s in substrings(n, longest or 0)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in each], pa.string()), pa.array([s for _, s in each], pa.string())], ["name", "word"])

    def best(batches):
        for batch in slices(batches, 1024):
            out = []
            for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                logp = {k["word"]: math.log(k["n"] / total) for k in known or ()}
                out.append([w for w in split(name, logp) if w in logp])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    known = names.mapInArrow(spread, "name string, word string").join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return store(names.join(known, "name", "left").select("name", "known").mapInArrow(best, "name string, words array<string>"), "names")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, log_odds, words) of every url; log_odds is null without a known word."""
    table = parsed(pages, url_col, text_col)
    # stored, so that the joins have exchanges of their own, which Spark can split where a key is hot
    counts = store(table.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "unigrams")
    urls = table.where("host is not null").groupBy("host", "path").agg(F.first("names").alias("names"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    urls = store(urls, "urls")
    names = store(urls.select(F.explode("names").alias("name")).distinct(), "distinct")
    known = segmented(names, counts)
    each = urls.select("host", "path", "bad", "good", F.posexplode("names").alias("i", "name")).join(known, "name")
    each = store(each.select("host", "path", "bad", "good", "i", F.posexplode("words").alias("j", "word")), "words")
    seen = store(each.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad + good > 0"), "counts")
    sums, pages_ = seen.agg(F.count("*"), F.sum("bad"), F.sum("good")).first(), urls.agg(F.sum("bad"), F.sum("good")).first()
    size, (bad, good) = ALPHA * sums[0], (sums[1] or 0, sums[2] or 0)
    prior = math.log(((pages_[0] or 0) + 1) / ((pages_[1] or 0) + 1))
    odds = seen.select("word", (F.log((F.col("bad") + ALPHA) / (bad + size or 1.0)) - F.log((F.col("good") + ALPHA) / (good + size or 1.0))).alias("odds"))
    scored = each.join(store(odds, "odds"), "word").groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("i", "j", "word", "odds"))).alias("x"))
    # summed in the order of the words, so that a score does not depend on how rows were dealt
    scored = store(scored.select(F.col("host").alias("h"), F.col("path").alias("p"), F.aggregate("x", F.lit(prior), lambda s, w: s + w["odds"]).alias("log_odds"), F.col("x.word").alias("words")), "scores")
    drop(table, counts, urls, names, known, each, seen)
    host, path = host_path(pages[url_col])
    own = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = own.join(scored, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    learned = F.when(F.coalesce(F.col("log_odds") > 0, F.lit(False)), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "log_odds", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
