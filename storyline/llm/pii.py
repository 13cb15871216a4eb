"""Personal data by bootstrapped contextual extraction.

Seeds are the entities that fixed expressions find (e-mail, address, card, phone). Candidates are all other tokens
with a digit, runs of digit groups joined by spaces, dots, brackets and hyphens, and written-out mail addresses. Every
seed and candidate is an instance that occurs in lexical patterns: the word before it, the word behind it, both, or the
word before it with its shape. On the graph of patterns and instances Spark iterates: a pattern scores by the mean of its
instances' scores, drawn to zero by SMOOTHING, times its words' strength; an instance that is no seed by its best
pattern. Patterns of fewer than MIN_INSTANCES different instances are left out.

Strength holds the patterns against ordinary text: of all places of a word in all texts, the share c that has an instance
beside it counts as c / (c + CUE). A word that texts are full of says nothing, however many identifiers stand beside it.

Instances over the threshold are discovered identifiers if they can be of the kind that their best pattern's seeds mostly
have: a card passes its check sum, an address has four parts up to 255, a phone 9 to 15 digits, an e-mail a sign or a
word for @; and if they have about as many digits and signs as the kind's seeds. Of those within a longer one only that
stays.

Edges are counted before they are joined: an entity that was copied into a third of all texts is one edge of each of
its patterns, and a pattern with many instances is joined on the side that Spark can split. DataFrame functions only.

Discovered spans are kept by the text's digest: equal texts have equal spans, so that a group of copies is looked at
once and no row numbers are needed. They are written, so that Spark broadcasts them while they are under its bound;
beyond it every digest is joined in SALTS parts, so that a group of copies isn't one task's.

Defined results: null and empty texts have no spans; repeated rows give a row each; without seeds nothing is
discovered; equally good kinds of a pattern or an instance: the last by name; spans of one place and two kinds both stay;
an empty table gives an empty result; columns other than doc_id and text are not read (`masked` returns them as they are,
but for n_chars, the length of the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import ascii_lower, discard, few, private, table, written

KINDS = ("email", "ip", "card", "phone")

#: Expressions of the base kinds and of candidates. A look-behind (or \G, the end of the previous match) makes a run of
#: allowed characters start once only, and possessive loops keep long runs linear; the matches are the plain ones.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![^\s,;:!?()\"'<>])[^\s,;:!?()\"'<>0-9]*+[0-9][^\s,;:!?()\"'<>]*+"

#: Digit groups with up to three joining signs between; more than 21 groups have more digits than any kind.
RUN = r"(?<![^\s,;:!?\"'<>])[(\[]?[0-9]++(?:[\x20.()\[\]/-]{1,3}+[0-9]++){1,20}(?![^\s,;:!?()\"'<>.\]])"
#: Addresses that the expression of e-mails doesn't match: no dotted host, or at and dot in words or brackets.
ADDRESS = (
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
    r"(?:(?:@|\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?)[A-Za-z0-9-]++|\x20at\x20[A-Za-z0-9-]++(?=\.[A-Za-z0-9]|\x20?[(\[{<]\x20?dot|\x20dot\x20))"
    r"(?:(?:\.|\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20)[A-Za-z0-9-]++)*+"
)
AT = r"(?i)\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20at\x20"
DOT = r"(?i)\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20"

ROUNDS, MIN_INSTANCES, SMOOTHING, THRESHOLD = 3, 5, 1.0, 0.6

#: Share of a word's places with an instance beside them at which the word is half as strong as it can be.
CUE = 0.05

#: Words that are sent to every task to be counted; more are joined.
MOST_WORDS = 200_000

#: Parts of a digest's rows in joins.
SALTS = 16

PLACED = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def places(text: Column, pattern: str) -> Column:
    """Matches with places in code points and the words beside them: the text is cut at the matches, lengths add up."""
    pieces, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def word(piece: Column, last: bool) -> Column:
        flat = F.translate(piece, "\n\t\r", "   ")
        return F.substring_index(F.rtrim(flat), " ", -1) if last else F.substring_index(F.ltrim(flat), " ", 1)

    def step(state: Column, x: Column) -> Column:
        start = state.at + F.length(x["0"])
        end = start + F.length(x["1"])
        one = F.struct(start.alias("start"), end.alias("end"), x["1"].alias("value"), word(x["0"], True).alias("left"), word(x["2"], False).alias("right"))
        return F.struct(end.alias("at"), F.concat(state.out, F.array(one)).alias("out"))

    zipped = F.filter(F.arrays_zip(pieces, found, F.slice(pieces, 2, 1 << 30)), lambda x: x["1"].isNotNull())
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(PLACED).alias("out")), step, lambda s: s.out)


def luhn(value: Column) -> Column:
    """The check sum of a value's digits ends in zero."""
    digits = F.transform(F.reverse(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0))), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n_digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":  # leading zeros and very long parts count by value
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n_digits.between(13, 19), luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return n_digits.between(9, 15)
    return F.lit(True)


def base_places(text: Column) -> dict[str, Column]:
    """Per kind the base matches that hold."""
    gates = {"email": F.contains(text, F.lit("@")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")), "card": F.rlike(text, F.lit("[0-9][ -]?[0-9]")), "phone": F.contains(text, F.lit("+"))}
    empty = F.array().cast(PLACED)

    def holds(kind: str):
        return lambda x: valid(kind, x.value)

    return {k: F.when(gates[k], F.filter(places(text, PATTERNS[k]), holds(k))).otherwise(empty) for k in KINDS}


def base_spans(docs: DataFrame) -> DataFrame:
    """digest, doc_id, one array of places per kind, and candidates (tokens with a digit, runs of digit groups and
    written-out addresses outside the base spans)."""
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast(PLACED)
    rows = docs.select(F.md5(text.cast("binary")).alias("digest"), "doc_id", text.alias("t"))
    rows = rows.select("digest", "doc_id", "t", *(c.alias(k) for k, c in base_places(F.col("t")).items()))
    rows = rows.withColumn("tokens", F.when(F.rlike("t", F.lit("[0-9]")), places(F.col("t"), TOKEN)).otherwise(empty))
    rows = rows.withColumn("runs", F.when(F.rlike("t", F.lit(r"[0-9][\x20.()\[\]/-]{1,3}[0-9]")), places(F.col("t"), RUN)).otherwise(empty))
    at = F.contains("t", F.lit("@")) | F.rlike("t", F.lit(r"(?i)[\x20(\[{<]at[\x20)\]}>]"))
    rows = rows.withColumn("addresses", F.when(at, places(F.col("t"), ADDRESS)).otherwise(empty)).drop("t")

    def new(c: str, *others: str) -> Column:
        return F.filter(c, lambda x: ~F.exists(F.concat(*others), lambda o: (o.start == x.start) & (o.end == x.end)))

    wider = F.concat("tokens", new("runs", "tokens"), new("addresses", "tokens", "runs"))
    rows = rows.withColumn("tokens", wider).drop("runs", "addresses")
    spans = F.concat(*KINDS)
    free = F.filter("tokens", lambda t: ~F.exists(spans, lambda s: (s.start < t.end) & (t.start < s.end)))
    return rows.withColumn("tokens", F.when(F.size(spans) > 0, free).otherwise(F.col("tokens")))


def shape(value: Column) -> Column:
    """Digits as 0, runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), r"\p{L}+", "a")


def occurrences(base: DataFrame) -> DataFrame:
    """digest, kind (null: a candidate), start, end, value, patterns: one row per seed or candidate."""

    def tagged(kind: Column):
        return lambda x: F.struct(kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), x.value.alias("value"), x.left.alias("left"), x.right.alias("right"))

    seeds = [F.transform(k, tagged(F.lit(k))) for k in KINDS]
    loose = F.transform("tokens", tagged(F.lit(None).cast("string")))
    rows = base.select("digest", F.inline(F.concat(*seeds, loose)))
    left, right = ascii_lower(F.col("left")), ascii_lower(F.col("right"))
    nothing = F.lit(None).cast("string")

    def pattern(kind: str, before: Column, behind: Column, *parts: Column) -> Column:
        name = F.concat_ws(" ", F.lit(kind), *parts)
        return F.struct(name.alias("pattern"), before.alias("before"), behind.alias("behind"))

    patterns = F.array(
        F.when(left != "", pattern("before", left, nothing, left)),
        F.when(right != "", pattern("behind", nothing, right, right)),
        F.when((left != "") & (right != ""), pattern("both", left, right, left, right)),
        F.when(left != "", pattern("shape", left, nothing, left, shape(F.col("value")))),
    )
    return rows.select("digest", "kind", "start", "end", "value", left.alias("left"), right.alias("right"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word, n: how often each of the words (a written table, each once) occurs in all texts."""
    each = docs.select(F.explode(F.split(F.translate(ascii_lower(F.coalesce("text", F.lit(""))), "\n\t\r", "   "), " ")).alias("word"))
    if words.count() <= MOST_WORDS:
        return each.join(F.broadcast(words), "word").groupBy("word").agg(F.count("*").alias("n"))
    return each.groupBy("word").agg(F.count("*").alias("n")).join(words, "word")


def strengths(seen: DataFrame, patterns: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern, strength. patterns: pattern, before, behind, each once. Of two words the stronger one counts."""
    words = patterns.select(F.col("before").alias("word")).unionByName(patterns.select(F.col("behind").alias("word"))).filter("word IS NOT NULL")
    words = written(words.distinct(), "pii-words")
    totals = written(word_counts(docs, words), "pii-word-counts")
    out = patterns
    for side, at in (("before", "left"), ("behind", "right")):
        beside = seen.groupBy(F.col(at).alias("word")).agg(F.count("*").alias("k")).join(totals, "word")
        share = F.least(F.lit(1.0), F.col("k") / F.col("n"))
        cue = beside.select(F.col("word").alias(side), (share / (share + CUE)).alias(f"by_{side}"))
        out = out.join(cue, side, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = written(out.select("pattern", F.greatest(zero("by_before"), zero("by_behind")).alias("strength")), "pii-strengths")
    discard(words, totals)
    return out


def score_values(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """value, value_score and best_kind of the instances that are no seeds."""
    sure = patterns.select("pattern", F.col("score").alias("pattern_score"), F.col("kind").alias("pattern_kind"))
    joined = edges.filter("kind IS NULL").join(sure, "pattern")
    best = F.struct("pattern_score", "pattern_kind")
    return joined.groupBy("value").agg(F.max("pattern_score").alias("value_score"), F.max_by("pattern_kind", best).alias("best_kind"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score, kind. edges: pattern, value, kind (null where it is no seed), strength; each pattern and value once."""
    patterns = None
    for _ in range(rounds):
        score = F.when(F.col("kind").isNotNull(), 1.0)
        if patterns is None:
            scored = edges.withColumn("score", score.otherwise(0.0))
        else:
            scored = edges.join(score_values(edges, patterns), "value", "left").withColumn("score", score.otherwise(F.coalesce("value_score", F.lit(0.0))))
        mean = F.sum("score") / (F.count("*") + SMOOTHING) * F.max("strength")
        sums = scored.groupBy("pattern").agg(mean.alias("score"), F.mode("kind", deterministic=True).alias("kind"))
        before, patterns = patterns, written(sums, "pii-patterns")  # joins on patterns get partitions that Spark can split
        discard(before)
    return patterns


def can_be(value: Column, kind: Column) -> Column:
    """Whether a value, its written-out signs read as one, can be of a kind."""
    plain = F.regexp_replace(F.regexp_replace(value, AT, "@"), DOT, ".")
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    ip = F.rlike(plain, F.lit(r"^[0-9]+([./-][0-9]+){3}$")) & valid("ip", F.translate(plain, "/-", ".."))
    checks = {"email": F.contains(plain, F.lit("@")), "ip": ip, "card": digits.between(13, 19) & luhn(value), "phone": digits.between(9, 15)}
    return F.coalesce(*(F.when(kind == k, check) for k, check in checks.items()), F.lit(False))


def discover(base: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """digest and found: spans (kind, start, end) of identifiers that only patterns know."""
    seen = written(occurrences(base), "pii-occurrences")
    edges = seen.select("value", "kind", F.explode("patterns").alias("p")).groupBy("p", "value").agg(F.max("kind").alias("kind"))
    edges = written(edges.select("p.*", "value", "kind"), "pii-edges")
    frequent = edges.groupBy("pattern", "before", "behind").agg(F.count("*").alias("n"))
    frequent = written(frequent.filter(F.col("n") >= MIN_INSTANCES).drop("n"), "pii-frequent")
    edges = written(edges.select("pattern", "value", "kind").join(strengths(seen, frequent, docs), "pattern"), "pii-strong-edges")
    patterns = score_patterns(edges, rounds)
    plain = F.regexp_replace(F.regexp_replace("value", AT, "@"), DOT, ".")  # written-out signs count as one
    digits, signs = F.length(F.regexp_replace("value", "[^0-9]", "")), F.length(plain)
    seeds = seen.filter("kind IS NOT NULL").groupBy("kind").agg(F.min(digits).alias("d0"), F.max(digits).alias("d1"), F.min(signs).alias("s0"), F.max(signs).alias("s1"))
    new = score_values(edges, patterns).filter((F.col("value_score") >= THRESHOLD) & F.col("best_kind").isNotNull())
    like = digits.between(F.col("d0") - 2, F.col("d1") + 2) & signs.between(F.col("s0") / 2, F.col("s1") + 4)
    alike = (F.col("best_kind") == F.col("kind")) & like & can_be(F.col("value"), F.col("best_kind"))
    new = new.join(F.broadcast(seeds), alike).select("value", "best_kind")  # a row for each kind
    hits = seen.filter("kind IS NULL").join(new, "value")
    found = hits.groupBy("digest").agg(F.collect_set(F.struct(F.col("best_kind").alias("kind"), "start", "end")).alias("all"))
    longer = lambda x: F.exists("all", lambda o: (o.start <= x.start) & (x.end <= o.end) & (o.end - o.start > x.end - x.start))
    return found.select("digest", F.filter("all", lambda x: ~longer(x)).alias("found"))


def with_found(rows: DataFrame, found: DataFrame, digest: Column, name: str) -> DataFrame:
    """rows with the spans found for their text's digest as a column `name` (an empty array: none)."""
    key, salt, salt_of_row = private(rows, "_digest", "_salt", "_row_salt")
    found = (found if hasattr(found, "_scratch") else written(found, "pii-found")).select(F.col("digest").alias(key), F.col("found").alias(name))
    found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(salt_of_row, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(found, (digest == F.col(key)) & (F.col(salt_of_row) == F.col(salt)), "left")
    return joined.withColumn(name, F.coalesce(name, F.array())).drop(key, salt, salt_of_row)


def span_of(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end"))


def of_kind(kind: str):
    return lambda s: s.kind == kind


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """digest, doc_id, base and found: spans (kind, start, end), base ones by kind as listed, then start."""
    base = written(base_spans(docs), "pii-base")
    spans = F.concat(*(F.transform(k, span_of(k)) for k in KINDS))
    rows = base.select("digest", "doc_id", spans.cast(SPANS).alias("base"))
    return with_found(rows, discover(base, docs, rounds), F.col("digest"), "found")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (sorted by start; overlapping ones together) replaced by <KIND>."""

    def step(state: Column, s: Column) -> Column:
        cut = F.concat(state.out, F.substring(text, state.at + 1, s.start - state.at), F.lit("<"), F.upper(s.kind), F.lit(">"))
        out = F.when(s.start >= state.at, cut).otherwise(state.out)
        return F.struct(F.greatest(state.at, s.end).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s.out, F.substring(text, s.at + 1, 1 << 30)))


def masked(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; n_chars, if there, follows the text.

    Only texts with spans are joined with them: the others are told by hashes of digests and stay where they are.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(text.cast("binary"))
    spans_name, key = private(docs, "_spans", "_key")
    base = written(base_spans(docs), "pii-base")
    known = F.concat(*(F.transform(k, span_of(k)) for k in KINDS)).cast(SPANS)
    known = base.select("digest", known.alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["digest"])
    both = known.join(discover(base, docs, rounds), "digest", "full")
    none = F.array().cast(SPANS)
    both = both.select("digest", F.concat(F.coalesce("spans", none), F.coalesce("found", none)).alias("found"))
    by_start = F.sort_array(F.transform("found", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"))))
    both = written(both.select("digest", by_start.alias("found")), "pii-spans")
    keys = few(written(both.select(F.xxhash64("digest").alias(key)).distinct(), "pii-keys"))
    has = F.xxhash64(digest) == F.col(key)
    keyed = with_found(docs.join(keys, has, "left_semi"), both, digest, spans_name)
    some = F.size(spans_name) > 0
    changed = keyed.withColumn("text", F.when(some, mask(text, F.col(spans_name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns).unionByName(docs.join(keys, has, "left_anti"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def ordered(spans: Column) -> Column:
    """By kind as listed, then start."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(F.element_at(rank, s.kind).alias("rank"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ordered(F.concat("base", "found"))).alias("spans"))
