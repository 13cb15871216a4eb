"""Text functions as column expressions. All run in the JVM; regular expressions take (?U) so that words of any script count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a word.
WORD = r"(?U)\d+(?:[.,]\d+)+|[^\W_]+(?:[-'’][^\W_]+)*"

#: English stop-words.
STOP_EN = """the a an and or but of to in on at for with by from as is are was were be been being it its this that these
those he she they we you i his her their our your not no yes do does did have has had will would can could may
might should also than then there here which who whom what when where why how into about over after before between
during under again more most some any each other such only own same so very just said says say reported reports
according told added noted year years""".split()

#: Russian stop-words.
STOP_RU = """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее её мне было вот от
меня еще ещё нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам
ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз
тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее
сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про
всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более
всегда конечно всю между также который которые которая которого которым которых которое сообщает сообщил сообщили
сообщила передает передал передали рассказал рассказали заявил заявили заявила отметил отметили отметила
году года лет год будут стал стала станет свой своей своих вместе очень либо какие подчеркнул пояснил добавил
отмечается сообщается информации информацию данным данных словам""".split()

#: Kazakh stop-words.
STOP_KK = """және мен бен пен да де та те бір бұл сол осы ол олар біз сіз сен үшін деп деген туралы болып болды болады бойынша
кейін дейін арқылы сондай сонымен тағы тек әр қандай қалай неге қай кім не айтты хабарлады мәлімдеді атап өтті
жылы жыл жылдың""".split()

#: Endings that the light stemmer strips, the longest first where it matters.
ENDINGS_EN = ("ing", "ed", "es", "ly", "s")
ENDINGS_RU = """ами ями ого его ому ему ыми ими ах ях ов ев ей ой ий ый ая яя ое ее ые ие ых их ую юю ом ем ам ям а я ы и у
ю е о ь й""".split()

#: Letters that only Kazakh has, lower case.
KAZAKH = "әғқңөұүһ"

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = """г гг тыс млн млрд трлн руб тг долл ул пр им др см рис напр обл р-н проф акад т.д т.п т.е т.к mr mrs dr inc ltd
no vs etc u.s st jr sr co corp прим англ букв ок мл чел кв куб авт гос зам пос""".split()

#: Query parameters that only track.
TRACKING = """utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid gclid yclid ysclid mc_cid mc_eid ref
ref_src from _ga igshid cmpid at_medium at_campaign ocid smid sr_share spm share mkt_tok wt_mc ito xtor""".split()

#: Host parts of trackers.
TRACKER_HOSTS = ("pixel.", "counter.", "stat.", "analytics.", "doubleclick.", "mc.yandex", "top-fwz", "googletagmanager")

#: Secrets as expressions and the texts that take their place, in their order.
SECRET_RULES = (
    (r"\b\d{6,12}:[A-Za-z0-9_-]{30,}\b", "[telegram-token]"),
    (r"\bEA[A-Za-z0-9]{40,}\b", "[meta-token]"),
    (r"\bIG[A-Za-z0-9]{40,}\b", "[instagram-token]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{12,}", "Bearer [redacted]"),
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[api-key]"),
    (r"\b[a-z]{3}_[A-Za-z0-9_-]{20,}\b", "[service-token]"),
    (r"(?i)((?:access_token|refresh_token|client_secret|api[_-]?key|password|passwd|secret|token|fb_exchange_token)=)[^&\s\"']+", "$1[redacted]"),
    (r"(?i)(\"(?:access_token|refresh_token|client_secret|api[_-]?key|password|secret|token)\"\s*:\s*\")[^\"]+", "$1[redacted]"),
    (r"(?i)(/bot)\d{6,12}:[A-Za-z0-9_-]{30,}", "$1[telegram-token]"),
)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Zero-width signs out, double quotes and dashes made plain, white space to single spaces. Input is taken as NFKC."""
    s = F.regexp_replace(text_of(c), "[​‌‍⁠﻿­]", "")
    s = F.translate(s, "«»“”„‟❝❞", '"' * 8)
    s = F.translate(s, "‐‑‒–—―−", "-------")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def letters(c: Column, kind: str = r"\p{L}") -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(text_of(c), f"(?U)[^{kind}]", ""))


def detect_language(c: Column) -> Column:
    """ru, kk, en or unknown from the shares of scripts."""
    n, cyrillic, ascii_, kazakh = letters(c), letters(c, r"Ѐ-ӿ&&\p{L}"), letters(c, "A-Za-z"), letters(F.lower(c), KAZAKH)
    kazakh_wins = (kazakh >= 2) & (kazakh / F.greatest(cyrillic, F.lit(1)) > 0.015)
    return (
        F.when(n < 8, "unknown")
        .when(cyrillic / n > 0.5, F.when(kazakh_wins, "kk").otherwise("ru"))
        .when(ascii_ / n > 0.6, "en")
        .otherwise("unknown")
    )


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(normalize(c)), "ё", "е"), F.lit(WORD), F.lit(0))


def is_cyrillic(token: Column) -> Column:
    return token.rlike("[Ѐ-ӿ]")


def stem(token: Column, lang: Column | None = None) -> Column:
    """Light stemmer: one ending off if four letters stay, then six letters; Kazakh words keep five letters."""

    def cut(endings: list[str]) -> Column:
        """The first ending of the list that fits, the longest first."""
        out = token
        for end in reversed(sorted(endings, key=len, reverse=True)):
            out = F.when(token.endswith(end) & (F.length(token) - len(end) >= 4), F.left(token, F.length(token) - len(end))).otherwise(out)
        return F.left(out, F.lit(6))

    russian = F.when(lang == "kk", F.left(token, F.lit(5))).otherwise(cut(ENDINGS_RU)) if lang is not None else cut(ENDINGS_RU)
    stemmed = F.when(is_cyrillic(token), russian).otherwise(cut(list(ENDINGS_EN)))
    return F.when((F.length(token) <= 4) | token.rlike(r"(?U)^\d+$"), token).otherwise(stemmed)


def tokenize(c: Column, stemming: bool = True) -> Column:
    """Words without stop-words of three languages and single letters, stemmed by the text's language."""
    stops = sorted({*STOP_RU, *STOP_KK, *STOP_EN})  # as literals: Spark looks them up in a hash set
    words = F.filter(word_tokens(c), lambda t: ~t.isin(*stops) & ((F.length(t) >= 2) | t.rlike(r"(?U)^\d$")))
    return let(detect_language(normalize(c)), lambda lang: F.transform(words, lambda t: stem(t, lang))) if stemming else words


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside lambdas expressions are not shared."""
    return F.get(F.transform(F.array(value), body), 0)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by single spaces."""

    def runs(t: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Cyrillic letters that one Latin letter or several stand for.
TRANSLIT_ONE = ("абвгдезийклмнопрстуфыэёәғқңөұүһі", "abvgdeziiklmnoprstufyeeagknouuhi")
TRANSLIT_MORE = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}


def transliterate(c: Column) -> Column:
    """Lower-cased, Cyrillic letters to Latin."""
    return reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), TRANSLIT_MORE.items(), F.translate(F.lower(text_of(c)), *TRANSLIT_ONE))


def skeleton(c: Column) -> Column:
    """Consonants of a word in Latin letters, doubles once, a last s off if more than three letters are left."""
    s = F.regexp_replace(F.regexp_replace(transliterate(c), "[^a-z]", ""), "[aeiouyh]", "")
    s = F.regexp_replace(s, r"(.)\1+", "$1")
    return F.when((F.length(s) > 3) & s.endswith("s"), F.left(s, F.length(s) - 1)).otherwise(s)


def clip(c: Column, n: int, ellipsis: str = "…") -> Column:
    """At most n characters, cut at the last space if it lies beyond 60 % of n, punctuation off, ellipsis on."""
    whole = F.trim(c)
    head = F.left(whole, F.lit(n - len(ellipsis)))
    before = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1  # place of the last space
    cut = F.when(before > 0.6 * n, F.left(head, before)).otherwise(head)
    return F.when(F.length(whole) <= n, whole).otherwise(F.concat(F.rtrim(cut, F.lit(" ,;:-—")), F.lit(ellipsis)))


def sentences(c: Column) -> Column:
    """Cut after . ! ? … before white space and a capital letter or digit; not after abbreviations and initials."""
    pieces = F.split(normalize(c), r"(?<=[.!?…])\s+(?=[«\"(\[]?[A-ZА-ЯЁӘҒҚҢӨҰҮҺІ0-9])")
    stops = F.array(*map(F.lit, ABBREVIATIONS))

    def open_(sentence: Column) -> Column:
        """Whether the sentence goes on behind its last dot."""
        last = F.rtrim(F.lower(F.regexp_extract(sentence, r"(\S+)\.$", 1)), F.lit("."))
        return F.array_contains(stops, last) | sentence.rlike(r"(?:^|\s)[A-ZА-ЯЁ]\.$")

    def step(done: Column, piece: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", before, piece)))
        return F.when((F.size(done) > 0) & open_(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))), joined).otherwise(F.concat(done, F.array(piece)))

    merged = F.aggregate(pieces, F.array().cast("array<string>"), step)
    return F.filter(F.transform(merged, F.trim), lambda s: s != "")


def lead(c: Column, n: int = 3, most: int = 600) -> Column:
    """The first n non-blank paragraphs, at most `most` characters."""
    return F.left(F.array_join(F.slice(F.filter(F.split(text_of(c), "\n\n"), lambda p: F.trim(p) != ""), 1, n), "\n\n"), F.lit(most))


def canonical_url(c: Column) -> Column:
    """https, bare lower-case host, plain path, sorted query without trackers, no fragment."""
    u = F.trim(text_of(c))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    authority = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*", 0), "^.*@", "")
    host = F.regexp_replace(F.rtrim(F.lower(F.regexp_replace(authority, r":\d*$", "")), F.lit(".")), r"^www\.", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/{2,}", "/")
    path = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)
    pairs = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.filter(pairs, lambda p: p.rlike("=.") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(F.when(scheme.isin("", "http", "https"), "https").otherwise(scheme), F.lit("://"), host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def url_hash(c: Column) -> Column:
    """Key of a page: the canonical address without its scheme."""
    return F.sha1(F.regexp_replace(canonical_url(c), "^[a-z]+://", "").cast("binary"))


def is_tracker(c: Column) -> Column:
    host = F.lower(F.regexp_extract(text_of(c), r"^[A-Za-z]+://([^/?#]*)", 1))
    return reduce(lambda a, t: a | F.contains(host, F.lit(t)), TRACKER_HOSTS, F.lit(False))


def redact(c: Column) -> Column:
    return reduce(lambda s, rule: F.regexp_replace(s, rule[0], rule[1]), SECRET_RULES, text_of(c))


#: Of the rules, those that try many words at every place; where they can match, the lower-cased text holds one of these.
SLOW_RULES, SLOW_SIGNS = (6, 7), tuple(f"{word}{sign}" for word in ("token", "secret", "password", "passwd", "key") for sign in ("=", '"'))


def has_secrets(c: Column) -> Column:
    """Whether `redact` changes the text; all rules run only where one may match."""
    t = text_of(c)
    low = F.lower(t)
    may = reduce(lambda x, y: x | y, [F.contains(low, F.lit(sign)) for sign in SLOW_SIGNS] + [t.rlike(rx) for k, (rx, _) in enumerate(SECRET_RULES) if k not in SLOW_RULES])
    return F.when(may, redact(c) != t).otherwise(F.lit(False))


def mask(c: Column, keep: int = 4) -> Column:
    """First and last characters only; short values as stars."""
    value = text_of(c)
    return F.when(F.length(value) <= 2 * keep, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.left(value, F.lit(keep)), F.lit("…"), F.right(value, F.lit(keep))))


def numbers(c: Column) -> Column:
    """Distinct numbers of a text as doubles: 1,234 is a thousand, 1,5 a fraction."""
    found = F.regexp_extract_all(text_of(c), F.lit(r"\b\d+(?:[.,]\d+)*\b"), F.lit(0))
    plain = F.transform(found, lambda n: F.when(n.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(n, F.lit(","), F.lit(""))).otherwise(F.replace(n, F.lit(","), F.lit("."))))
    return F.array_distinct(F.filter(F.transform(plain, lambda n: n.try_cast("double")), lambda n: n.isNotNull()))


def iso_dates(c: Column) -> Column:
    """Distinct dates written 2024-01-31 or 31.01.2024, as YYYY-MM-DD, in the order found by form."""
    iso = F.regexp_extract_all(text_of(c), F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    dotted = F.regexp_extract_all(text_of(c), F.lit(r"\b(\d{2}\.\d{2}\.\d{4})\b"), F.lit(1))
    turned = F.transform(dotted, lambda d: F.concat_ws("-", F.substring(d, 7, 4), F.substring(d, 4, 2), F.substring(d, 1, 2)))
    return F.slice(F.array_distinct(F.concat(iso, turned)), 1, 10)


def quotes(c: Column) -> Column:
    """Quotations of 20 to 420 characters and four words or more, each once, at most eight."""
    found = F.concat(*(F.regexp_extract_all(text_of(c), F.lit(p), F.lit(1)) for p in ("«([^«»]{20,420})»", "“([^“”]{20,420})”", '"([^"]{20,420})"')))
    return F.slice(F.array_distinct(F.filter(found, lambda q: F.size(F.split(F.trim(q), r"\s+")) >= 4)), 1, 8)
