"""Features of articles as column expressions: entities, facts, number keys, overlaps, edits, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline.functions.text import let, sentences, skeleton, text_of


def entities(c: Column, most: int = 14) -> Column:
    """array<struct<n, key, text>>: capitalised runs that don't open a sentence, and acronyms; by count, then text."""
    inner = F.regexp_extract_all(text_of(c), F.lit(r"(?U)(?<=[\p{L}\d,;:'’-] )(\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)*)"), F.lit(1))
    acronyms = F.regexp_extract_all(text_of(c), F.lit(r"(?U)\b(\p{Lu}{2,6})\b"), F.lit(1))

    def counted(found: Column) -> Column:
        one = lambda e: F.struct((-F.size(F.filter(found, lambda x: x == e))).alias("minus_n"), e.alias("text"), skeleton(e).alias("key"))
        ranked = F.slice(F.array_sort(F.transform(F.array_distinct(found), one)), 1, most)
        return F.transform(ranked, lambda e: F.struct((-e["minus_n"]).alias("n"), e["key"].alias("key"), e["text"].alias("text")))

    return let(F.concat(inner, acronyms), counted)


def facts(c: Column, hedges: str, most: int = 6) -> Column:
    """Sentences that state facts, in their order: 35 to 260 characters, without hedges; early ones, numbers and names
    score. Looks at the first 14 sentences, as the rule says."""

    def scored(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            n = F.length(x)
            points = 1.0 - i * 0.05 + F.when(x.rlike(r"\d"), 0.5).otherwise(0.0) + F.when(x.rlike(r"(?U)(?<=\p{L} )\p{Lu}\p{Ll}+"), 0.3).otherwise(0.0)
            good = n.between(35, 260) & ~x.rlike(hedges)
            return F.when(good, F.struct((-points).alias("minus"), i.alias("i"), x.alias("x")))

        kept = F.slice(F.array_sort(F.filter(F.transform(s, one), lambda v: v.isNotNull())), 1, most)
        by_place = F.array_sort(F.transform(kept, lambda v: F.struct(v["i"].alias("i"), v["x"].alias("x"))))
        return F.transform(by_place, lambda v: v["x"])

    return let(F.slice(sentences(c), 1, 14), scored)


def number_key(v: Column) -> Column:
    """Three significant digits: numbers with equal keys count as the same."""
    return F.format_string("%.2e", v.cast("double"))


def number_specificity(key: Column) -> Column:
    """0.25 and a quarter for each significant digit, at most 1."""
    digits = F.length(F.rtrim(F.regexp_replace(F.substring_index(key, "e", 1), "[^0-9]", ""), F.lit("0")))
    return F.least(F.lit(1.0), 0.25 + 0.25 * digits)


def weighted_overlap(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two maps of weights, 0 if both are empty."""
    zero = F.lit(0.0)
    sides = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.least(F.coalesce(x, zero), F.coalesce(y, zero)).alias("lo"), F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)).alias("hi"))))
    total = lambda f: F.aggregate(sides, zero, lambda s, v: s + v[f])
    return F.coalesce(F.try_divide(total("lo"), total("hi")), zero)


def edit_signals(before: Column, after: Column) -> Column:
    """What an edit says about taste: shorter, longer, fewer_hashtags, fewer_exclaims."""
    words = lambda c: F.size(F.filter(F.split(text_of(c), r"\s+"), lambda w: w != ""))
    ratio = words(after) / F.greatest(words(before), F.lit(1))
    fewer = lambda rx: F.regexp_count(text_of(after), F.lit(rx)) < F.regexp_count(text_of(before), F.lit(rx))
    found = F.array(F.when(ratio <= 0.85, "shorter"), F.when(ratio >= 1.15, "longer"), F.when(fewer(r"#\w"), "fewer_hashtags"), F.when(fewer("!"), "fewer_exclaims"))
    return F.filter(found, lambda s: s.isNotNull())


def tolerant_json(c: Column, schema: str) -> Column:
    """A struct from the outermost braces of a text that may have fences or words around them; null if there are none."""
    return F.from_json(F.nullif(F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0), F.lit("")), schema)


def allowed_html(c: Column, tags: tuple[str, ...] = ("b", "i", "u", "s", "a", "code", "pre", "blockquote")) -> Column:
    """Only the named tags stay; links keep an https address, all other attributes go."""
    kept = "|".join(tags)
    s = F.regexp_replace(text_of(c), rf"(?i)</?(?!(?:{kept})\b)[a-z][^>]*>", "")
    s = F.regexp_replace(s, r"(?i)<a\s+[^>]*href=[\"'](https://[^\"'>]+)[\"'][^>]*>", "<a href=\"$1\">")
    s = F.regexp_replace(s, r"(?i)<a(?!\s+href=\"https://)[^>]*>", "<a>")
    return F.regexp_replace(s, rf"(?i)<({'|'.join(t for t in tags if t != 'a')})\s[^>]*>", "<$1>")
