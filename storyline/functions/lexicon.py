"""Lexicons as one Java regular expression each: patterns match at the start of a word, `$` at the end asks for the
whole word, words of a phrase may be inflected."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_pattern(pattern: str) -> str:
    words = pattern.removesuffix("$").split()
    whole = r"\b" if pattern.endswith("$") else ""
    return r"\b" + r"\w*\s+".join(re.escape(w).replace(r"\-", "-") for w in words) + whole


def compile_lexicon(patterns: list[str]) -> str:
    """Longer patterns first, so that the first that fits at a place is the most exact."""
    return "(?iU)(?:" + "|".join(map(compile_pattern, sorted(patterns, key=lambda p: (-len(p), p)))) + ")"


def count(text: Column, patterns: list[str]) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(compile_lexicon(patterns)))


def any_hit(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text, F.lit("")).rlike(compile_lexicon(patterns))


def matched(text: Column, patterns: list[str]) -> Column:
    """The patterns that occur, in the order given."""
    found = [F.when(F.coalesce(text, F.lit("")).rlike("(?iU)" + compile_pattern(p)), p) for p in patterns]
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def classify(title: Column, summary: Column, body: Column, categories: dict[str, list[str]], least: float = 2.5) -> Column:
    """Category of the largest weighted hits (title 3, summary 1.6, first 1500 characters of the body 1; distinct
    patterns count 1, repeats 0.3), or `other` under `least`; ties go to the first name."""

    def hits(text: Column, patterns: list[str]) -> Column:
        distinct = F.size(matched(text, patterns))
        return distinct + 0.3 * F.greatest(F.lit(0), count(text, patterns) - distinct)

    parts = ((title, 3.0), (summary, 1.6), (F.left(body, F.lit(1500)), 1.0))
    scores = [(name, reduce(lambda a, p: a + p[1] * hits(p[0], patterns), parts, F.lit(0.0))) for name, patterns in sorted(categories.items())]
    top = reduce(lambda a, s: F.greatest(a, s[1]), scores[1:], scores[0][1]) if len(scores) > 1 else scores[0][1]
    name = F.coalesce(*(F.when(score == top, n) for n, score in scores))
    return F.when(top >= least, name).otherwise("other")
