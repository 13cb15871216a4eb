"""Profiles of reports and events as arrays, and their scores over tiles of time.

A profile is one row: its terms and title words as places in a table of frequencies (or hashes, where the table doesn't hold
them), its entities, numbers, quotations and dates as hashes. Pairs meet by time alone: a report is compared with all
reports of its horizon and of the one before, tile by tile, so that no pair is lost, no row is made for a pair that does not
attach, and what is moved are two copies of each profile where a horizon holds up to TILE of them. A fuller horizon is cut
into t tiles by hash, each pair of which is a group of its own: 4 t copies, groups of bounded size.

The most frequent terms (MOST_KNOWN at most) are broadcast with their weights; those of the others are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions.features import number_specificity
from storyline.sources.scratch import written

#: Neither changes the result.
TILE, MOST_KNOWN = 512, 2_000_000

#: Tells a title word from the term.
TITLE = 0x5BD1E9955BD1E995

#: Pairs (keys) of a tile that are worked on at once.
MEETINGS, DENSE = 4_000_000, 2048

#: Place of the language of an item that has none.
NO_LANG = 16383

SCHEMA = (
    "id long, lang string, sec long, size long, langs array<string>, known array<int>, known_at array<short>, known_tf array<float>, "
    "rare array<long>, rare_at array<short>, rare_tf array<float>, rare_idf array<double>, ents array<long>, ent_w array<byte>, nums array<long>, num_w array<double>, quotes array<long>, dates array<long>"
)
FOUND = "v long, p long, score double, cos double, title_share double, ent double, shared_ent long, num double, shared_num long, cross_lang boolean"


# ---- frequencies ----------------------------------------------------------------------------------------------------


def hashes(values: Column, *more: Column) -> Column:
    """Hashes of the different values of an array."""
    return F.transform(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull())), lambda x: F.xxhash64(*more, x))


def title_key(h: Column) -> Column:
    return h.bitwiseXOR(F.lit(TITLE))


def hashed(reports: DataFrame) -> DataFrame:
    """id, lang, sec and the items of a report as hashes: terms (with the title's), titles, ents (with the title's) and so on."""
    both = lambda a, b: F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in (a, b)))
    nums = F.array_distinct(F.filter(F.coalesce("numbers", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return reports.select(
        "id", "lang", F.col("sec").cast("long").alias("sec"),
        hashes(both("terms", "title"), F.col("lang")).alias("terms"), hashes(F.col("title"), F.col("lang")).alias("titles"),
        hashes(both("entities", "title_entities")).alias("ents"), hashes(F.col("title_entities")).alias("title_ents"),
        F.transform(nums, lambda x: F.xxhash64(x)).alias("nums"), F.transform(nums, number_specificity).alias("num_w"),
        hashes(F.col("quotes")).alias("quotes"), hashes(F.col("dates")).alias("dates"),
    )


def frequencies(reports: DataFrame) -> DataFrame:
    """h, df: how many reports have a term or title word. reports: hashed."""
    each = reports.select(F.explode(F.concat("terms", F.transform("titles", title_key))).alias("h"))
    return each.groupBy("h").agg(F.count("*").alias("df"))


def hashed_frequencies(df: DataFrame) -> DataFrame:
    """h, df of a table of kind, lang, key, df."""
    h = F.xxhash64("lang", "key")
    return df.filter(F.col("kind").isin("term", "title")).select(F.when(F.col("kind") == "title", title_key(h)).otherwise(h).alias("h"), "df")


# ---- packing --------------------------------------------------------------------------------------------------------


def idf_of(df: Column, n: int) -> Column:
    return F.log(F.lit(n + 2.0) / (df + 1)) + 1


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column from values in the order of their rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values).cast(kind))


class Packed:
    """Profiles (SCHEMA) and the weights of the known terms, by their places. Rows that are written are made once only."""

    def __init__(self, rows: DataFrame, idf):
        self.rows, self.idf = rows, idf


def packed(reports: DataFrame, df: DataFrame, n: int, all_counted: bool) -> Packed:
    """Profiles of reports (hashed). df: h, df of n reports; all_counted: they are these reports, so that what df doesn't hold
    or holds once stands in one report only."""
    spark = reports.sparkSession
    least = 2 if all_counted else 1
    levels = df.filter(F.col("df") >= least).groupBy(F.floor(F.log2("df") + 1e-9).cast("int").alias("level")).agg(F.count("*").alias("n"))
    bound, total = least, 0
    for level, number in sorted(((r.level, r.n) for r in levels.collect()), reverse=True):
        total += number
        if total > MOST_KNOWN:
            bound = 1 << (level + 1)
            break
    table = df.filter(F.col("df") >= bound).select("h", idf_of(F.col("df"), n).alias("idf")).orderBy("h").toArrow()
    known = spark.sparkContext.broadcast((table["h"].to_numpy(), table["idf"].to_numpy()))
    alone = float(np.log((n + 2.0) / ((1 if all_counted else 0) + 1)) + 1)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"known": pa.int32(), "known_at": pa.int16(), "known_tf": pa.float32(), "rare": pa.int64(), "rare_at": pa.int16(), "rare_tf": pa.float32(), "rare_idf": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value[0]
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            m = batch.num_rows
            mixed = lambda h, row: h ^ (row * np.int64(0x1E3779B97F4A7C15))
            rows = {x: np.repeat(np.arange(m), lengths(c[x])) for x in ("terms", "titles", "ents", "title_ents")}
            values = {x: flat(c[x]) for x in rows}
            with np.errstate(over="ignore"):
                keys = {x: mixed(values[x], rows[x]) for x in rows}
            twice = {x: np.isin(keys[x], keys[y]) for x, y in (("terms", "titles"), ("ents", "title_ents"))}
            row = np.concatenate([rows["terms"], rows["titles"]])
            h = np.concatenate([values["terms"], values["titles"] ^ np.int64(TITLE)])
            at = np.repeat(np.array([0, 1], np.int16), [rows["terms"].size, rows["titles"].size])
            tf = np.concatenate([1.0 + twice["terms"], np.ones(rows["titles"].size)])
            place = np.minimum(np.searchsorted(table, h), max(0, table.size - 1))
            there = table[place] == h if table.size else np.zeros(h.size, bool)
            order = np.lexsort((place, row))
            row, h, at, tf, place, there = (x[order] for x in (row, h, at, tf, place, there))
            no = ~there
            out = {
                "known": (place[there], row[there]), "known_at": (at[there], row[there]), "known_tf": (tf[there], row[there]),
                "rare": (h[no], row[no]), "rare_at": (at[no], row[no]), "rare_tf": (tf[no], row[no]), "rare_idf": (np.full(int(no.sum()), alone), row[no]),
            }
            made = {k: lists(v, r, m, kinds[k]) for k, (v, r) in out.items()}
            made |= {"id": c["id"], "lang": c["lang"], "sec": c["sec"], "size": pa.array(np.ones(m, np.int64)), "langs": pa.ListArray.from_arrays(pa.array(np.arange(m + 1), pa.int32()), c["lang"])}
            made |= {"ents": c["ents"], "ent_w": lists(1 + twice["ents"].astype(np.int8), rows["ents"], m, pa.int8())}
            made |= {x: c[x] for x in ("nums", "num_w", "quotes", "dates")}
            yield pa.RecordBatch.from_arrays([made[x] for x in names], names=names)

    out = reports.mapInArrow(run, SCHEMA)
    if bound > least or not all_counted:
        out = weighed_rare(written(out, "profiles"), df.filter((F.col("df") >= least) & (F.col("df") < bound)), n, alone)
    return Packed(out, spark.sparkContext.broadcast(known.value[1]))


def weighed_rare(profiles: DataFrame, df: DataFrame, n: int, alone: float) -> DataFrame:
    """Profiles with the weights of the terms that are not broadcast."""
    each = profiles.select("id", F.explode(F.arrays_zip("rare", "rare_at", "rare_tf")).alias("r")).select("id", "r.*")
    each = each.join(df.select(F.col("h").alias("rare"), idf_of(F.col("df"), n).alias("idf")), "rare", "left")
    of = each.groupBy("id").agg(F.collect_list(F.struct("rare", "rare_at", "rare_tf", F.coalesce("idf", F.lit(alone)).alias("rare_idf"))).alias("r"))
    names = ("rare", "rare_at", "rare_tf", "rare_idf")
    joined = profiles.drop(*names).join(of, "id", "left").withColumns({x: F.coalesce(F.col(f"r.{x}"), F.array()) for x in names})
    return joined.selectExpr(*(f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in SCHEMA.split(", ")))


def of_items(items: DataFrame, heads: DataFrame) -> Packed:
    """Profiles of rows of items: id, kind, lang, key, tf, idf. heads: id, lang, sec, size."""
    part = F.expr("CASE kind WHEN 'term' THEN 2 WHEN 'title' THEN 3 WHEN 'ent' THEN 4 WHEN 'num' THEN 5 WHEN 'quote' THEN 6 WHEN 'date' THEN 7 END").cast("byte")
    h = F.when(part == 2, F.xxhash64("lang", "key")).when(part == 3, title_key(F.xxhash64("lang", "key"))).otherwise(F.xxhash64("key"))
    value = F.when(part == 5, number_specificity(F.col("key"))).otherwise(F.col("tf"))
    rows = items.filter("kind <> 'title_ent'").select("id", part.alias("part"), h.alias("key"), F.when(part <= 3, F.col("lang")).alias("lang"), value.alias("x"), "idf")
    return Packed(gathered(rows, heads), items.sparkSession.sparkContext.broadcast(np.zeros(0)))


def gathered(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Profiles of rows id, part (0, 1: known terms, titles; 2, 3: others; 4: entities; 5: numbers; 6: quotations; 7: dates),
    key, lang, x (count, weight or specificity), idf."""
    all_ = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "key", "lang", "x", "idf"))).alias("r"), F.array_sort(F.collect_set("lang")).alias("langs"))
    found = heads.select("id", "lang", F.col("sec").cast("long").alias("sec"), F.col("size").cast("long").alias("size")).join(all_, "id", "left")
    none = F.array().cast("array<struct<part:tinyint,key:bigint,lang:string,x:double,idf:double>>")
    found = found.withColumns({"r": F.coalesce("r", none), "langs": F.coalesce("langs", F.array().cast("array<string>"))})

    def of(low: int, high: int, value: Callable[[Column], Column], kind: str) -> Column:
        return F.transform(F.filter("r", lambda x: x["part"].between(low, high)), value).cast(f"array<{kind}>")

    at = lambda x: (F.when(x["lang"].isNull(), NO_LANG).otherwise(F.array_position("langs", x["lang"]) - 1) * 2 + x["part"] % 2)
    return found.select(
        "id", "lang", "sec", "size", "langs",
        of(0, 1, lambda x: x["key"], "int").alias("known"), of(0, 1, at, "smallint").alias("known_at"), of(0, 1, lambda x: x["x"], "float").alias("known_tf"),
        of(2, 3, lambda x: x["key"], "bigint").alias("rare"), of(2, 3, at, "smallint").alias("rare_at"), of(2, 3, lambda x: x["x"], "float").alias("rare_tf"), of(2, 3, lambda x: x["idf"], "double").alias("rare_idf"),
        of(4, 4, lambda x: x["key"], "bigint").alias("ents"), of(4, 4, lambda x: x["x"], "tinyint").alias("ent_w"),
        of(5, 5, lambda x: x["key"], "bigint").alias("nums"), of(5, 5, lambda x: x["x"], "double").alias("num_w"),
        of(6, 6, lambda x: x["key"], "bigint").alias("quotes"), of(7, 7, lambda x: x["key"], "bigint").alias("dates"),
    )


def regrouped(profiles: DataFrame, labels: DataFrame, heads: DataFrame) -> DataFrame:
    """Profiles of the events: counts of terms add up, weights of entities keep the maximum. labels: id, event; heads: of the
    events. An event of one profile keeps that."""
    size = labels.groupBy("event").agg(F.count("*").alias("n"))
    of = profiles.join(labels.join(size, "event"), "id")
    alone = of.filter("n = 1").withColumn("id", F.col("event")).select(profiles.columns)

    def part(number: str, key: str, lang: str, x: str, idf: str) -> str:
        return f"named_struct('part', CAST({number} AS TINYINT), 'key', CAST({key} AS BIGINT), 'lang', CAST({lang} AS STRING), 'x', CAST({x} AS DOUBLE), 'idf', CAST({idf} AS DOUBLE))"

    arrays = [
        f"transform(arrays_zip(known, known_at, known_tf), i -> {part('i.known_at % 2', 'i.known', 'get(langs, CAST(i.known_at DIV 2 AS INT))', 'i.known_tf', 'NULL')})",
        f"transform(arrays_zip(rare, rare_at, rare_tf, rare_idf), i -> {part('2 + i.rare_at % 2', 'i.rare', 'get(langs, CAST(i.rare_at DIV 2 AS INT))', 'i.rare_tf', 'i.rare_idf')})",
        f"transform(arrays_zip(ents, ent_w), i -> {part('4', 'i.ents', 'NULL', 'i.ent_w', 'NULL')})",
        f"transform(arrays_zip(nums, num_w), i -> {part('5', 'i.nums', 'NULL', 'i.num_w', 'NULL')})",
        f"transform(quotes, i -> {part('6', 'i', 'NULL', '1', 'NULL')})",
        f"transform(dates, i -> {part('7', 'i', 'NULL', '1', 'NULL')})",
    ]
    each = of.filter("n > 1").select(F.col("event").alias("id"), F.explode(F.expr(f"concat({', '.join(arrays)})")).alias("i")).select("id", "i.*")
    x = F.when(F.col("part").isin(0, 2), F.sum("x")).otherwise(F.max("x")).alias("x")
    each = each.groupBy("id", "part", "key").agg(F.max("lang").alias("lang"), x, F.max("idf").alias("idf"))
    return alone.unionByName(gathered(each, heads.join(size.filter("n > 1").select(F.col("event").alias("id")), "id", "left_semi")))


# ---- scores ---------------------------------------------------------------------------------------------------------


class Side:
    """The profiles of one side of a tile."""

    def __init__(self, t: pa.Table, idf: np.ndarray, langs: dict[str, int]):
        c = {name: t.column(name).combine_chunks() for name in t.schema.names}
        self.n = t.num_rows
        self.id, self.sec, self.size = (c[x].to_numpy(zero_copy_only=False) for x in ("id", "sec", "size"))
        self.fresh = c["fresh"].to_numpy(zero_copy_only=False)
        code = lambda x: -1 if x is None else langs.setdefault(x, len(langs))
        self.lang = np.array([code(x) for x in c["lang"].to_pylist()], np.int64)
        row = {x: np.repeat(np.arange(self.n), lengths(c[x])) for x in ("langs", "known", "rare", "ents", "nums", "quotes", "dates")}
        codes = np.array([code(x) for x in c["langs"].flatten().to_pylist()] + [-1], np.int64)
        starts = np.cumsum(lengths(c["langs"])) - lengths(c["langs"])
        self.row = np.concatenate([row["known"], row["rare"]])
        at = np.concatenate([flat(c["known_at"]), flat(c["rare_at"])]).astype(np.int64)
        known = flat(c["known"]).astype(np.int64)
        self.key = np.concatenate([known, flat(c["rare"]).astype(np.int64)])
        idf = np.concatenate([idf[known] if known.size else np.zeros(0), flat(c["rare_idf"]).astype(np.float64)])
        tf = np.concatenate([flat(c["known_tf"]), flat(c["rare_tf"])]).astype(np.float64)
        none = at // 2 >= NO_LANG
        self.of = np.where(none, -1, codes[np.where(none, -1, starts[self.row] + at // 2)]) if self.row.size else np.zeros(0, np.int64)
        self.title, self.idf = at % 2 == 1, idf
        self.w = np.minimum(tf, 2.0) * idf
        self.u = np.where(tf > 1, 1 + np.log(np.maximum(tf, 1.0)), tf) * idf
        self.items = {x: (row[x], flat(c[x]).astype(np.int64)) for x in ("ents", "nums", "quotes", "dates")}
        self.ent_w, self.num_w = flat(c["ent_w"]).astype(np.float64), flat(c["num_w"]).astype(np.float64)

    def sums(self, values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(self.row[chosen], weights=values[chosen], minlength=self.n)

    def by_lang(self, values: np.ndarray | None, chosen: np.ndarray, n_langs: int) -> np.ndarray:
        """Sums (or counts) by row and language."""
        chosen = chosen & (self.of >= 0)
        weights = None if values is None else values[chosen]
        return np.bincount(self.row[chosen] * n_langs + self.of[chosen], weights=weights, minlength=self.n * n_langs).reshape(self.n, n_langs)


def product(a: tuple, b: tuple, n: int, m: int) -> np.ndarray:
    """n x m sums of products over shared keys. a, b: rows, keys, values; a row has a key once."""
    out = np.zeros(n * m)
    if not (a[0].size and b[0].size):
        return out.reshape(n, m)
    keys, inverse = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
    ka, kb = inverse[: a[1].size], inverse[a[1].size :]
    ca, cb = (np.bincount(k, minlength=keys.size) for k in (ka, kb))
    many = ca * cb * 128 > n * m
    chosen = np.flatnonzero(many)
    for low in range(0, chosen.size, DENSE):
        place = np.full(keys.size, -1)
        part = chosen[low : low + DENSE]
        place[part] = np.arange(part.size)
        sides = []
        for (rows, _, values), k, size in ((a, ka, n), (b, kb, m)):
            at = place[k]
            here = at >= 0
            dense = np.zeros((size, part.size))
            dense[rows[here], at[here]] = values[here]
            sides.append(dense)
        out += (sides[0] @ sides[1].T).ravel()
    few = (ca * cb > 0) & ~many
    here = few[ka]
    rows, k, values = a[0][here], ka[here], a[2][here]
    order = np.argsort(kb, kind="stable")
    starts = np.cumsum(cb) - cb
    number = cb[k]
    upto = np.cumsum(number)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(MEETINGS, upto[-1] if upto.size else 0, MEETINGS)), [k.size]]))
    for low, high in pairwise(cuts):
        c = number[low:high]
        at = order[np.repeat(starts[k[low:high]] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        cell = np.repeat(rows[low:high], c) * m + b[0][at]
        out += np.bincount(cell, weights=np.repeat(values[low:high], c) * b[2][at], minlength=n * m)
    return out.reshape(n, m)


def shares(v: Side, p: Side, n_langs: int, rules: Callable) -> dict[str, np.ndarray]:
    """All pairs of reports v and events p: score and what it is made of, attach."""
    n, m = v.n, p.n
    over = lambda a, b: product(a, b, n, m)
    own = (v.of >= 0) & (v.of == v.lang[v.row])
    terms, theirs = own & ~v.title, ~p.title
    dot = over((v.row[terms], v.key[terms], v.w[terms]), (p.row[theirs], p.key[theirs], p.u[theirs]))
    lang = np.maximum(v.lang, 0)
    known = (v.lang >= 0)[:, None]
    same = known & (p.by_lang(None, np.ones(p.of.size, bool), n_langs)[:, lang].T > 0)
    uu = p.by_lang(p.u * p.u, theirs, n_langs)[:, lang].T
    norm = np.sqrt(v.sums(v.w * v.w, terms)[:, None] * uu)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)
    cos = np.where(same, ratio(dot, norm), 0.0)
    words = own & v.title
    title = over((v.row[words], v.key[words], v.idf[words]), (p.row[p.title], p.key[p.title], np.ones(int(p.title.sum()))))
    titles = v.sums(v.idf, words)[:, None] + p.by_lang(p.idf, p.title, n_langs)[:, lang].T - title
    title = np.where(same, ratio(title, titles), 0.0)

    def items(name: str, x=None, y=None, only_v=None, only_p=None) -> np.ndarray:
        (rv, kv), (rp, kp) = v.items[name], p.items[name]
        iv = np.ones(rv.size, bool) if only_v is None else only_v
        ip = np.ones(rp.size, bool) if only_p is None else only_p
        one = np.ones
        return over((rv[iv], kv[iv], (one(rv.size) if x is None else x)[iv]), (rp[ip], kp[ip], (one(rp.size) if y is None else y)[ip]))

    shared = items("ents")
    # weights of entities are 1 or 2 (in the title)
    in_v, in_p = v.ent_w > 1, p.ent_w > 1
    least = shared + items("ents", only_v=in_v, only_p=in_p)
    in_title = items("ents", only_v=in_v)
    total = lambda s: np.bincount(s.items["ents"][0], weights=s.ent_w, minlength=s.n)
    ent = ratio(least, total(v)[:, None] + total(p)[None, :] - least)
    nums, num_w = items("nums"), items("nums", x=v.num_w)
    fewer = np.minimum(*(np.bincount(s.items["nums"][0], minlength=s.n).reshape(shape) for s, shape in ((v, (-1, 1)), (p, (1, -1)))))
    num = np.where(fewer > 0, np.minimum(1.0, num_w / np.maximum(1.0, 0.75 * fewer)), 0.0)
    quote, date = items("quotes") > 0, items("dates") > 0
    gap = np.abs(v.sec[:, None] - p.sec[None, :]) / 3600
    score, attach = rules(same, cos, title, ent, num, quote, date, gap, shared, in_title, num_w)
    return {"score": score, "cos": cos, "title_share": title, "ent": ent, "shared_ent": shared, "num": num, "shared_num": nums, "cross_lang": ~same, "attach": attach}


def tiles(profiles: DataFrame, horizon: int) -> DataFrame:
    """Profiles with block, h, q: the group's block of time, its tile of later ones, its tile of earlier ones; own: the block of
    the profile, x: its tile. A profile is in the groups of its block and of the next one."""
    own = F.floor(F.col("sec") / horizon).cast("long")
    full = profiles.groupBy(own.alias("block")).agg(F.ceil(F.count("*") / TILE).cast("long").alias("t")).filter("t > 1")
    both = full.unionByName(full.select((F.col("block") + 1).alias("block"), "t")).groupBy("block").agg(F.max("t").alias("t"))
    out = profiles.withColumn("own", own).withColumn("block", F.explode(F.array("own", F.col("own") + 1)))
    out = out.join(F.broadcast(both), "block", "left").withColumn("t", F.coalesce("t", F.lit(1).cast("long")))
    out = out.withColumn("x", F.pmod(F.xxhash64("id"), F.col("t")))
    each = F.sequence(F.lit(0).cast("long"), F.col("t") - 1)
    as_earlier = F.transform(each, lambda h: F.struct(h.alias("h"), F.col("x").alias("q")))
    as_later = F.transform(F.filter(each, lambda q: q != F.col("x")), lambda q: F.struct(F.col("x").alias("h"), q.alias("q")))
    place = F.when(F.col("block") == F.col("own"), F.concat(as_earlier, as_later)).otherwise(as_earlier)
    return out.withColumn("g", F.explode(place)).select("*", "g.h", "g.q").drop("g", "t")


def attaching(given: Packed, rules: Callable, horizon: int, fresh: DataFrame | None = None, which: str = "any", by_size: bool = False) -> DataFrame:
    """FOUND: all pairs (v, p) that attach, v the later one (by time, then id), p at most a horizon earlier; of by_size the one of
    fewer reports is v (of two equal ones the later). fresh: ids; which: 'any' takes pairs with one of them at least, 'to_old'
    those of a fresh v and another p."""
    rows = given.rows
    rows = rows.withColumn("fresh", F.lit(True)) if fresh is None else rows.join(fresh.select("id", F.lit(True).alias("fresh")), "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    weights = given.idf
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = {"v": pa.int64(), "p": pa.int64(), "shared_ent": pa.int64(), "shared_num": pa.int64(), "cross_lang": pa.bool_()}
    schema = pa.schema([(x, types.get(x, pa.float64())) for x in names])

    def run(t: pa.Table) -> pa.Table:
        h, q, x, own, block = (t.column(c).to_numpy() for c in ("h", "q", "x", "own", "block"))
        later, earlier = (own == block) & (x == h), x == q
        marked = t.column("fresh").to_numpy()
        if which == "to_old":
            later, earlier = later & marked, earlier & ~marked
        if not (later.any() and earlier.any() and marked.any()):
            return schema.empty_table()
        langs: dict[str, int] = {}
        a, b = (Side(t.filter(pa.array(c)), weights.value, langs) for c in (later, earlier))
        gap = a.sec[:, None] - b.sec[None, :]
        take = (gap >= 0) & (gap <= horizon) & ((gap > 0) | (a.id[:, None] > b.id[None, :]))
        if which == "any":
            take &= a.fresh[:, None] | b.fresh[None, :]
        if not take.any():
            return schema.empty_table()
        n_langs = max(1, len(langs))
        parts = []
        straight = take & (a.size[:, None] <= b.size[None, :]) if by_size else take
        for v, p, chosen in ((a, b, straight), (b, a, (take & ~straight).T)):
            if not chosen.any():
                continue
            s = shares(v, p, n_langs, rules)
            i, j = np.nonzero(chosen & s["attach"])
            values = {"v": v.id[i], "p": p.id[j]} | {k: s[k][i, j] for k in names[2:]}
            parts.append(pa.table([pa.array(np.asarray(values[k])).cast(schema.field(k).type) for k in names], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return tiles(rows, horizon).groupBy("block", "h", "q").applyInArrow(run, FOUND)
