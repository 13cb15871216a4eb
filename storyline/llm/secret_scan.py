"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, checksum validation.

One automaton finds the keywords of all rules in one pass over the ASCII-lower-cased text. A rule's expression is
tried only at the places of its keywords, anchored there, from left to right and never inside its previous match: the
matches are the leftmost non-overlapping ones that a full search would give. Runs of hexadecimal digits have no
keyword; they are found by one expression over the text. Every expression is linear over all hits of a text: unbounded
parts are possessive and start at the beginning of their run, or end where the next keyword can begin.

Tokens with an embedded checksum (CRC-32 in base 62, Bech32, Base58Check) or a decodable part of a known form are
reported only if it holds.

A map without a shuffle. Defined results: null and empty texts have no secrets; a secret of two kinds gives a span for
each kind; repeated rows give a row each; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import map_rows, table

DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])


def base62(number: int, width: int) -> str:
    out = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = DIGITS62[digit] + out
    return out


def crc_holds(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of those between the prefix and them, in base 62."""
    body = m[0].split("_", 1)[1]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def bech32_holds(m: re.Match) -> bool:
    prefix, _, data = m[0].lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.find(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            if top >> i & 1:
                check ^= g
    return check == 1


def base58_holds(m: re.Match) -> bool:
    """The last four bytes are the beginning of the doubled SHA-256 of those before."""
    number = 0
    for c in m[0]:
        number = 58 * number + BASE58.index(c)
    data = number.to_bytes(-(-number.bit_length() // 8), "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def decoded(text: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except (ValueError, binascii.Error):
        return None


def macaroon_decodes(m: re.Match) -> bool:
    """Base64 of a version byte, then a field of the named place."""
    data = decoded(m[0].split("-", 1)[1])
    return data is not None and data[:3] == b"\x02\x01\x08" and data[3:11] == b"pypi.org"


def account_key_decodes(m: re.Match) -> bool:
    """Base64 of 64 bytes."""
    return len(base64.b64decode(m[1], validate=True)) == 64


def header_decodes(m: re.Match) -> bool:
    """The part before the first dot is Base64 of a JSON object that names an algorithm."""
    head = m[0].split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


class Rule:
    def __init__(self, kind: str, keywords: list[str], pattern: str, valid: Callable[[re.Match], bool]):
        self.kind, self.keywords, self.pattern, self.valid = kind, keywords, re.compile(pattern, re.ASCII), valid


#: Keywords are lower-case; expressions start at a keyword. The order is that of kinds at one start.
RULES = [
    Rule("assign", ["password", "passwd", "secret", "token", "api_key", "apikey"], r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    Rule("access", ["akia"], r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    Rule("hex", [], r"[0-9a-f]{32,}", lambda m: True),
    Rule("github", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", crc_holds),
    Rule("npm", ["npm_"], r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", crc_holds),
    Rule("age", ["age-secret-key-1"], r"AGE-SECRET-KEY-1[AC-HJ-NP-Z02-9]{58}(?![A-Z0-9])", bech32_holds),
    Rule("jwt", ["eyj"], r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", header_decodes),
    Rule("slack", ["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"], r"xox[bpars]-[0-9]{6,}-[A-Za-z0-9-]{10,}", lambda m: True),
    Rule("pem", ["-----begin "], r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----", lambda m: True),
    Rule("bip32", ["xprv"], r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])", base58_holds),
    Rule("nsec", ["nsec1"], r"nsec1[02-9ac-hj-np-z]{58}(?![a-z0-9])", bech32_holds),
    Rule("pypi", ["pypi-ageichlwas5vcmc"], r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}+", macaroon_decodes),
    Rule("azure", ["accountkey="], r"AccountKey=([A-Za-z0-9+/]{86}==)", account_key_decodes),
    Rule("gitlab", ["glpat-"], r"glpat-[A-Za-z0-9_-]{20}(?![A-Za-z0-9_-])", lambda m: True),
    Rule("google", ["aiza"], r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", lambda m: True),
    Rule("stripe", ["sk_live_", "rk_live_"], r"[sr]k_live_[A-Za-z0-9]{24,99}(?![A-Za-z0-9])", lambda m: True),
    Rule("sendgrid", ["sg."], r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])", lambda m: True),
    Rule("huggingface", ["hf_"], r"(?<![A-Za-z0-9_])hf_[A-Za-z]{34}(?![A-Za-z0-9])", lambda m: True),
    Rule("digitalocean", ["dop_v1_", "doo_v1_", "dor_v1_"], r"do[opr]_v1_[0-9a-f]{64}(?![0-9a-f])", lambda m: True),
]
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        import ahocorasick

        self.rules = rules
        self.keywords = ahocorasick.Automaton()
        for i, rule in enumerate(rules):
            for word in rule.keywords:
                self.keywords.add_word(word, (i, len(word)))
        self.keywords.make_automaton()

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """Spans (kind, start, end) in code points, by start, then by the order of rules."""
        if not text:
            return []
        # A-Z alone are lowered, so that places in both texts agree
        lowered = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        places: dict[int, list[int]] = {}
        for last, (i, n) in self.keywords.iter(lowered):
            places.setdefault(i, []).append(last - n + 1)
        found = []
        for i, rule in enumerate(self.rules):
            if not rule.keywords:
                found += [(m.start(), i, m.end()) for m in rule.pattern.finditer(text) if rule.valid(m)]
                continue
            end = 0
            for at in sorted(places.get(i, ())):
                if at >= end and (m := rule.pattern.match(text, at)):
                    end = m.end()
                    if rule.valid(m):
                        found.append((at, i, end))
        return [(self.rules[i].kind, start, end) for start, i, end in sorted(found)]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every text."""
    scanners: list[Scanner] = []

    def rows(cols: dict[str, list]) -> dict:
        if not scanners:
            scanners.append(Scanner())
        return {"doc_id": cols["doc_id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in scanners[0].scan(t)] for t in cols["text"]]}

    return map_rows(docs.select("doc_id", "text"), SCHEMA, rows)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def of_kind(kind: str):
    return lambda s: s.kind == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))

