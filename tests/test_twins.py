"""Queries without SQL against plain Python, over the driver's smallest tables."""

import os

import pytest
import regex

from storyline.functions import text as T
from storyline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def normalized(s):
    s = regex.sub("[​‌‍⁠﻿­]", "", s)
    s = s.translate(str.maketrans("«»“”„‟❝❞" + "‐‑‒–—―−", '"' * 8 + "-" * 7))
    return regex.sub(r"\s+", " ", s).strip(" ")


def sentences(s):
    out = []
    for piece in regex.split(r"(?<=[.!?…])\s+(?=[«\"(\[]?[A-ZА-ЯЁӘҒҚҢӨҰҮҺІ0-9])", normalized(s)):
        last = out[-1] if out else ""
        word = regex.search(r"(\S+)\.$", last)
        goes_on = bool(word) and word[1].lower().rstrip(".") in T.ABBREVIATIONS or regex.search(r"(?:^|\s)[A-ZА-ЯЁ]\.$", last)
        if out and goes_on:
            out[-1] = f"{last} {piece}"
        else:
            out.append(piece)
    return [x.strip(" ") for x in out if x.strip(" ")]


def clip(s, n):
    s = s.strip(" ")
    if len(s) <= n:
        return s
    head = s[: n - 1]
    at = head.rfind(" ")
    return (head[:at] if at > 0.6 * n else head).rstrip(" ,;:-—") + "…"


def test_sentences_leads_and_clips(spark, texts):
    for r in registry.QUERIES["sentence_lead_clip"](spark, SF).collect():
        s = texts[r.doc_id]
        assert r.n_sentences == len(sentences(s)), r.doc_id
        assert r.lead == "\n\n".join([p for p in s.split("\n\n") if p.strip(" ")][:3])[:600]
        assert r.title == clip(normalized(s), 80)


def test_numbers_dates_and_quotations(spark, texts):
    some = 0
    for r in registry.QUERIES["text_extracts"](spark, SF).collect():
        s, numbers = texts[r.doc_id], []
        for n in regex.findall(r"\b\d+(?:[.,]\d+)*\b", s, regex.ASCII):
            plain = n.replace(",", "") if regex.fullmatch(r"\d{1,3}(,\d{3})+", n) else n.replace(",", ".")
            try:
                numbers.append(float(plain))
            except ValueError:
                continue
        assert r.numbers == list(dict.fromkeys(numbers)), r.doc_id
        dates = regex.findall(r"\b\d{4}-\d{2}-\d{2}\b", s, regex.ASCII) + ["-".join(d.split(".")[::-1]) for d in regex.findall(r"\b\d{2}\.\d{2}\.\d{4}\b", s, regex.ASCII)]
        assert r.dates == list(dict.fromkeys(dates))[:10]
        quotes = [q for p in ("«([^«»]{20,420})»", "“([^“”]{20,420})”", '"([^"]{20,420})"') for q in regex.findall(p, s) if len(regex.split(r"\s+", q.strip(" "))) >= 4]
        assert r.quotes == list(dict.fromkeys(quotes))[:8]
        some += bool(numbers)
    assert some


def skeleton(word):
    s = word.lower().translate(str.maketrans(*T.TRANSLIT_ONE))
    for a, b in T.TRANSLIT_MORE.items():
        s = s.replace(a, b)
    s = regex.sub(r"(.)\1+", r"\1", regex.sub("[aeiouyh]", "", regex.sub("[^a-z]", "", s)))
    return s[:-1] if len(s) > 3 and s.endswith("s") else s


def test_skeletons_and_languages(spark, texts):
    for r in registry.QUERIES["near_titles"](spark, SF).collect():
        words = regex.findall(T.WORD.removeprefix("(?U)"), normalized(texts[r.doc_id]).lower().replace("ё", "е"))
        assert r.skeletons == [skeleton(w) for w in words], r.doc_id


def test_entities_and_facts(spark, texts):
    hedges = regex.compile(r"(?i)\b(?:reportedly|allegedly|rumou?r|may|might|could)\b")
    some = 0
    for r in registry.QUERIES["entities_and_facts"](spark, SF).collect():
        s = texts[r.doc_id]
        found = regex.findall(r"(?<=[\p{L}\d,;:'’-] )(\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)*)", s) + regex.findall(r"\b(\p{Lu}{2,6})\b", s)
        ranked = sorted({(-found.count(e), e) for e in found}, key=lambda x: (x[0], x[1].encode()))[:14]
        assert [(e.n, e.text, e.key) for e in r.entities] == [(-n, e, skeleton(e)) for n, e in ranked], r.doc_id
        scored = []
        for i, x in enumerate(sentences(s)[:14]):
            if 35 <= len(x) <= 260 and not hedges.search(x):
                points = 1.0 - i * 0.05 + (0.5 if regex.search("[0-9]", x) else 0.0) + (0.3 if regex.search(r"(?<=\p{L} )\p{Lu}\p{Ll}+", x) else 0.0)
                scored.append((-points, i, x))
        assert r.facts == [x for _, _, x in sorted(sorted(scored)[:6], key=lambda v: v[1])], r.doc_id
        some += bool(r.facts)
    assert some
