"""URL filters: rules first, then words of host and path under a naive Bayes model.

Chunks are runs of letters of host and path. Every different chunk is cut into words once: a unigram model (word counts
of all pages' texts, paths and hyphened host names, whose words are parted already) gives each known substring its
probability, an unknown word of n letters 10 / (N * 10^n), and Viterbi search finds the likeliest cut. Substrings meet their counts in a join, so the model is
never held whole anywhere.

Multinomial naive Bayes: pages whose words contain a seed word are the class to block, all others the class to allow;
word counts of the classes cover all pages; a page's score is the sum over its chunks of their words' log ratios.

The rule whose host and path are the longest decides before the model. A rule's host covers its subdomains.

Joins are on chunks (each once on one side), so that a chunk that all pages share is split by Spark or broadcast by
its measured size; counts are added up before they are shuffled.

Ties: of two cuts of one probability the one that starts its last word later; a
probability of one half blocks; of rules of one length the later listed.

Defined results: a null url or one without `://` has empty host and path, no words and no rule, and is judged by the
prior alone; repeated rows give a row each (a row key is written with the parsed urls); without any seed page all are
allowed; an empty table gives an empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import ascii_lower, map_rows, table, written

#: Rules as (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words that mark a page to block for the model to learn from.
SEEDS = ("spam", "casino", "pills", "viagra", "porn", "xxx", "betting", "lottery", "jackpot", "malware", "phishing", "warez", "payday", "escort", "ads", "track")

MAX_WORD, ALPHA = 20, 1.0


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, decision in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def letters(text: Column) -> Column:
    """Runs of a-z of the lower-cased text."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z]+"), F.lit(0))


def unigrams(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """word, count over the texts of all pages, paths and hyphened host names."""
    hyphened = F.filter(F.split("host", r"\."), lambda label: F.contains(label, F.lit("-")))
    parted = F.concat(letters(F.col("path")), letters(F.array_join(hyphened, " ")))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(?:script|style).*?</(?:script|style)>|<[^>]*>|&[a-z]+;", " ")
    words = pages.select(F.explode(letters(text)).alias("word")).unionByName(urls.select(F.explode(parted).alias("word")))
    return words.filter(F.length("word") <= MAX_WORD).groupBy("word").count()


def best_cut(chunk: str, counts: dict[str, int], total: int) -> list[str]:
    """Viterbi: the words of the likeliest cut of the chunk."""
    log_total = math.log(max(total, 1))
    best, back = [0.0], [0]
    for end in range(1, len(chunk) + 1):
        options = []
        for start in range(max(0, end - MAX_WORD), end):
            n = counts.get(chunk[start:end])
            p = math.log(n) - log_total if n else math.log(10) * (1 - (end - start)) - log_total
            options.append((best[start] + p, start))
        score, start = max(options)
        best.append(score)
        back.append(start)
    words, end = [], len(chunk)
    while end:
        words.append(chunk[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(chunks: DataFrame, model: DataFrame) -> DataFrame:
    """chunk, words: every different chunk with its likeliest cut under the model (word, count)."""
    total = model.agg(F.sum("count")).first()[0] or 0
    starts = F.sequence(F.lit(1), F.length("chunk"))
    ends = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("chunk") - s + 1)), lambda n: F.substring("chunk", s, n))))
    parts = chunks.select("chunk", F.explode(F.array_distinct(ends)).alias("word"))
    known = parts.join(model, "word").groupBy("chunk").agg(F.collect_list(F.struct("word", "count")).alias("known"))
    ready = chunks.join(known, "chunk", "left")

    def rows(cols: dict[str, list]) -> dict:
        words = [best_cut(c, {k["word"]: k["count"] for k in known or ()}, total) for c, known in zip(cols["chunk"], cols["known"])]
        return {"chunk": cols["chunk"], "words": words}

    return map_rows(ready, T.StructType([T.StructField("chunk", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))]), rows)


def judge(pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, words of host and path, block_probability."""
    host, path = parsed(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"))
    urls = urls.select(F.monotonically_increasing_id().alias("row_key"), "page_id", "host", "path", name.alias("rule"), verdict.alias("decided"), F.concat(letters(F.col("host")), letters(F.col("path"))).alias("chunks"))
    urls = written(urls, "urls")
    chunks = urls.select(F.explode("chunks").alias("chunk")).distinct()
    cut = written(segment(chunks, written(unigrams(pages, urls), "unigrams")), "segments")

    # the class of each page, with its chunks kept for the counts
    seeded = cut.select("chunk", F.arrays_overlap("words", F.array(*map(F.lit, seeds))).alias("seeded"))
    uses = urls.select("row_key", F.explode("chunks").alias("chunk"))
    labelled = written(uses.join(seeded, "chunk").groupBy("row_key").agg(F.max("seeded").alias("block"), F.collect_list("chunk").alias("chunks")), "url-classes")
    by_chunk = labelled.select("block", F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.count_if("block").alias("n1"), F.count_if(~F.col("block")).alias("n0"))
    by_word = cut.join(by_chunk, "chunk").select(F.explode("words").alias("word"), "n1", "n0").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    by_word = written(by_word, "url-words")
    sums = by_word.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("v")).first()
    pages_by_class = labelled.agg(F.count_if("block").alias("n1"), F.count_if(~F.col("block")).alias("n0")).first()
    n1 = pages_by_class.n1 or 0
    n0 = urls.count() - n1  # pages without a chunk hold no seed
    prior = math.log((n1 + ALPHA) / (n0 + ALPHA))
    v, t1, t0 = sums.v or 0, sums.n1 or 0, sums.n0 or 0
    ratio = F.log((F.col("n1") + ALPHA) / (t1 + ALPHA * v)) - F.log((F.col("n0") + ALPHA) / (t0 + ALPHA * v))
    weights = by_word.select("word", (ratio if v and n1 else F.lit(-1.0)).alias("weight"))
    scored = cut.select("chunk", F.explode("words").alias("word")).join(weights, "word").groupBy("chunk").agg(F.sum("weight").alias("weight"))
    scored = cut.join(scored, "chunk").select("chunk", "words", "weight")
    per_page = uses.join(scored, "chunk").groupBy("row_key").agg(F.sum("weight").alias("weight"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    out = urls.join(per_page, "row_key", "left")
    probability = 1 / (1 + F.exp(-(F.lit(prior) + F.coalesce("weight", F.lit(0.0)))))
    out = out.withColumn("block_probability", probability)
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.coalesce("words", F.array().cast("array<string>")).alias("words"), "block_probability")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join(F.array_sort("words"), " ").alias("words"), F.round("block_probability", 6).alias("block_probability"))
