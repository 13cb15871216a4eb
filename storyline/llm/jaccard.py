"""Near-duplicates by the exact Jaccard of word shingles: all pairs at 0.8 or more, none below.

Two sets at Jaccard t share a token among the first n - ceil(t n) + 1 of each in any common order (prefix filter). The
order is: tokens that are not frequent, then frequent ones, by hash within both. Which tokens count as frequent is
estimated on an eighth of the texts; it changes the number of candidates, never the result. No key is left out.

A text is its set of different 64-bit shingle hashes; equal sets are merged before keys are made. What keeps groups of
alike texts from being compared all with all, without losing a pair:
  * texts that share a key of over STAR texts are first linked to the most typical one (the fewest tokens that are not
    frequent), one pair a text; after that only texts of different components meet, and those of the component that
    the key's typical text is in never meet each other;
  * two texts that share frequent tokens only overlap in no more than the frequent tokens of either. Where that is too
    few for the threshold, frequent keys don't bring them together: they are a pair only if they share another token,
    which is a key of both;
  * pairs whose shared keys leave the threshold out of reach are dropped before their sets are read; all others are
    verified on whole sets.
What stays quadratic are texts of a frequent key that consist of frequent tokens almost wholly and are yet no links.

Defined results: null and empty texts are equal; texts of fewer words than a shingle are one shingle; classes are the
connected components of the links; an empty table gives an empty result; `keep_one` keeps the row with the smallest
doc_id, nulls last, of equal rows one, and returns all other columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import discard, few, lower_bytes, map_rows, private, written
from storyline.llm.simhash import keep_of_classes
from storyline.operators.graph import connected_components

SHINGLE = 5
NUM, DEN = 4, 5  # the threshold 0.8 as a fraction: integers keep the bounds exact

#: A token of FREQUENT or more of an eighth of the texts is frequent; at most MOST tokens are, by a higher bound.
FREQUENT, MOST = 4, 2_000_000

#: Keys of more texts than this are linked to one text first; parts of a set's rows in joins.
STAR, PARTS = 16, 8


def shingles(text: str | None) -> np.ndarray:
    """Different hashes of the text's shingles, sorted."""
    words = lower_bytes(text).split()
    grams = [b" ".join(words)] if len(words) <= SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g) for g in grams], dtype=np.uint64)).view(np.int64)


def prefix(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The tokens by which a set is found, and how many of all are not frequent (a sorted array)."""
    at = np.searchsorted(frequent, tokens)
    often = frequent[np.minimum(at, frequent.size - 1)] == tokens if frequent.size else np.zeros(tokens.size, bool)
    first = tokens.size - -(-NUM * tokens.size // DEN) + 1
    rare = tokens[~often]
    return np.concatenate((rare, tokens[often]))[:first], rare.size


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [shingles(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["token"])

    part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).select("text").mapInArrow(run, "token long")
    counts = written(part.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT), "token-counts")
    least = max(FREQUENT, (counts.agg(F.sum("n")).first()[0] or 0) // MOST)
    return np.sort(counts.filter(F.col("n") >= least).select("token").toArrow().column(0).to_numpy())


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, uid (of the set), n and n_rare (of its tokens), keys."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs))

    def rows(cols: dict[str, list]) -> dict:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "uid": [], "n": [], "n_rare": [], "keys": []}
        for text in cols["text"]:
            tokens = shingles(text)
            keys, rare = prefix(tokens, frequent.value)
            out["uid"].append(uid_of(tokens))
            out["n"].append(tokens.size)
            out["n_rare"].append(rare)
            out["keys"].append(keys)
        return out

    longs = [T.StructField(c, T.LongType()) for c in ("doc_id", "text_hash", "uid", "n", "n_rare")]
    schema = T.StructType([*longs, T.StructField("keys", T.ArrayType(T.LongType()))])
    return map_rows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), schema, rows, 500)


def uid_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).astype(np.int64))


def token_sets(docs: DataFrame, uids: DataFrame, sets: DataFrame) -> DataFrame:
    """uid and tokens of the given sets, from one text of each; other texts are read, but not moved."""
    (hash_,) = private(docs, "_hash")
    one = written(sets.select("uid", "text_hash").join(uids, "uid", "left_semi").select(F.col("text_hash").alias(hash_)).distinct(), "wanted-texts")
    texts = docs.select("text", F.xxhash64("text").alias(hash_)).join(few(one), hash_, "left_semi")

    def rows(cols: dict[str, list]) -> dict:
        tokens = [shingles(t) for t in cols["text"]]
        return {"uid": [uid_of(t) for t in tokens], "tokens": tokens}

    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
    out = written(map_rows(texts.select("text"), schema, rows, 200).dropDuplicates(["uid"]), "token-sets")
    discard(one)
    return out


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard of the threshold or more."""
    pairs = written(pairs.select("a", "b"), "candidates")
    uids = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    tokens = token_sets(docs, uids, sets)
    both = pairs.join(tokens.toDF("a", "x"), "a").join(tokens.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = written(both.filter((NUM + DEN) * shared >= NUM * (F.size("x") + F.size("y"))).select("a", "b"), "verified")
    discard(pairs, tokens)
    return out


#: Columns of a pair that its bounds need: tokens, keys and tokens that are not frequent of both sets.
SIZES = ("na", "pa", "ra", "nb", "pb", "rb")


def by_frequent() -> Column:
    """Whether a pair can reach the threshold by its frequent tokens alone."""
    return (NUM + DEN) * F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= NUM * (F.col("na") + F.col("nb"))


def in_reach(shared: Column) -> Column:
    """Whether a pair with so many shared keys can reach the threshold.

    What follows the keys of one adds the most. A pair that needs another than frequent tokens meets on those alone;
    if all of both are keys, their count and the frequent tokens bound the overlap.
    """
    follow = F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    frequent = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    all_rare = ~by_frequent() & (F.col("ra") <= F.col("pa")) & (F.col("rb") <= F.col("pb"))
    return (NUM + DEN) * (shared + F.when(all_rare, frequent).otherwise(follow)) >= NUM * (F.col("na") + F.col("nb"))


def packed() -> Column:
    """n, n_rare and whether the key at `place` is a frequent token, in one long."""
    often = (F.col("place") >= F.col("n_rare")).cast("long")
    return F.shiftleft("n", 32).bitwiseOR(F.shiftleft("n_rare", 1)).bitwiseOR(often)


def unpacked(x: str) -> list[Column]:
    """Tokens, keys and tokens that are not frequent of side x from its packed long."""
    n = F.shiftright("meta", 32)
    keys = n - F.ceil(n * NUM / DEN) + 1
    return [n.alias(f"n{x}"), keys.alias(f"p{x}"), F.shiftright(F.col("meta").bitwiseAND(F.lit(0xFFFFFFFE)), 1).alias(f"r{x}")]


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of uids at the threshold or more that connect all such pairs. sets: uid, text_hash, n, n_rare, keys."""
    keys = sets.select("uid", "n", "n_rare", F.posexplode("keys").alias("place", "key")).select("key", "uid", packed().alias("meta"))
    several = keys.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1")
    shared = written(keys.join(several, "key"), "key-texts")
    often = F.col("meta").bitwiseAND(F.lit(1)) == 1
    rare = F.shiftright(F.col("meta").bitwiseAND(F.lit(0xFFFFFFFE)), 1)
    best = F.min(F.struct(rare.alias("r"), "uid", "meta")).alias("s")
    hubs = written(shared.filter(F.col("texts") > STAR).groupBy("key").agg(best).select("key", "s.uid", "s.meta"), "hubs")

    def side(df: DataFrame, x: str, *more: Column) -> DataFrame:
        return df.select("key", F.col("uid").alias(x), *unpacked(x), *more)

    similar = (DEN * F.col("na") >= NUM * F.col("nb")) & (DEN * F.col("nb") >= NUM * F.col("na"))
    meets = similar & (~F.col("often") | by_frequent())

    star = side(hubs, "a").join(side(shared, "b", often.alias("often")), "key").filter((F.col("a") != F.col("b")) & meets)
    star = star.groupBy("a", "b", *SIZES).agg(F.count("*").alias("c")).filter(in_reach(F.col("c")))
    first = verified(star, docs, sets)

    joined = written(connected_components(first).select(F.col("node").alias("uid"), "component"), "joined")
    label = F.coalesce("component", "uid")
    labelled = written(shared.join(joined, "uid", "left").select("key", "uid", "meta", label.alias("label")), "labelled")
    main = hubs.join(joined, "uid", "left").select("key", label.alias("main"))
    n = F.shiftright("meta", 32)
    apart = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(n).alias("least")).filter("l0 <> l1")
    rest = labelled.join(apart.select("key", "least").join(main, "key", "left"), "key")
    hopeful = DEN * (NUM + DEN) * (n - rare) >= NUM * DEN * n + NUM * F.greatest(DEN * F.col("least"), NUM * n)
    rest = written(rest.filter(~often | hopeful).drop("least"), "apart")
    discard(shared, labelled)
    x = side(rest.filter("main IS NULL OR label <> main"), "a", F.col("label").alias("la"))
    of_main = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    y = side(rest, "b", F.col("label").alias("lb"), often.alias("often"), of_main.alias("of_main"))
    pairs = x.join(y, "key").filter((F.col("la") != F.col("lb")) & (F.col("of_main") | (F.col("a") < F.col("b"))) & meets)
    # a pair meets in either order, by the key: its keys are counted together
    ends = [F.struct(*(F.col(f"{c}{x}" if c else x).alias(f"_{c}") for c in ("", "n", "p", "r"))) for x in "ab"]
    ordered = [F.when((F.col("a") < F.col("b")) == F.lit(k == 0), ends[0]).otherwise(ends[1]) for k in (0, 1)]
    pairs = pairs.select(*(o[f"_{c}"].alias(f"{c}{x}") for o, x in zip(ordered, "ab") for c in ("", "n", "p", "r")))
    pairs = pairs.groupBy("a", "b", *SIZES).agg(F.count("*").alias("c")).filter(in_reach(F.col("c")))
    found = first.unionByName(verified(pairs, docs, sets))
    discard(hubs, joined, rest)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class: rows of one class are linked by pairs at the threshold or more."""
    keyed = written(described(docs), "shingle-keys")
    prints = written(keyed.select("doc_id", "text_hash", "uid"), "shingle-sets")
    sets = written(keyed.dropDuplicates(["uid"]).select("uid", "text_hash", "n", "n_rare", "keys"), "token-keys")
    discard(keyed)
    classes = written(connected_components(links(docs, sets)), "set-classes")
    # a group of copies is one uid: joined in parts
    parts = classes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = prints.select("doc_id", "text_hash", "uid", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("of"))
    rows = rows.join(parts, (F.col("uid") == F.col("node")) & (F.col("of") == F.col("part")), "left")
    return written(rows.select("doc_id", "text_hash", F.coalesce("component", "uid").alias("class")), "classes")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns: that with the smallest doc_id."""
    return keep_of_classes(docs, near_duplicates(docs))
