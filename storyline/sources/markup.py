"""Lists on web pages by selectors, over malformed markup, and citations of known names: Arrow maps, one pass over a text.

A selector is compiled once: groups by comma; steps of tag, #id, .class, [attribute] and [attribute=value], joined by a
space (any depth) or > (child). Pages are read by a tolerant parser; a tag that is never closed ends with its parent,
an end without a start is passed over, and void elements hold nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same name (or of its group) before them.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements up to which an open one may be ended.
KEEPS = {"li": {"ul", "ol", "nav"}, "p": {"div", "article", "section", "body", "li", "td"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
MOST_ITEMS = 80


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    children: list = field(default_factory=list)  # elements and texts

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            at = stack.pop()
            yield at
            stack.extend(c for c in reversed(at.children) if isinstance(c, Element))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                parts.append(at)
            elif at.tag not in ("script", "style"):
                stack.extend(reversed(at.children))
        return " ".join(" ".join(parts).split())


class Tree(HTMLParser):
    """The elements of a page."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            up = self.at
            while up.parent is not None and up.tag not in KEEPS[tag]:
                if up.tag in CLOSES[tag]:
                    self.at = up.parent
                    break
                up = up.parent
        child = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


STEP = re.compile(r"^([A-Za-z][\w-]*|\*)?((?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)$")
TOKEN = re.compile(r">|(?:\[[^\]]*\]|[^\s>\[])+")
PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=(\"[^\"]*\"|'[^']*'|[^\]]*))?\]")


def compiled(selector: str) -> list[list[tuple[str, str, list[tuple[str, str | None]]]]]:
    """Per group the steps from the last one back: joint to the step before ('>' or ' '), tag, conditions."""
    out = []
    for group in selector.split(","):
        joints, steps = [], []
        joint = ""
        for token in TOKEN.findall(group):
            if token == ">":
                joint = ">"
                continue
            m = STEP.match(token)
            if not m:
                raise ValueError(f"no selector: {selector!r}")
            conditions: list[tuple[str, str | None]] = []
            for id_, class_, name, value in PART.findall(m[2]):
                conditions.append(("id", id_) if id_ else ("class", class_) if class_ else (f"@{name}", value.strip("\"'") if value else None))
            steps.append(((m[1] or "*").lower(), conditions))
            joints.append(joint or " ")
            joint = ""
        if not steps:
            raise ValueError(f"no selector: {selector!r}")
        out.append([(j, *s) for j, s in zip(joints, steps)][::-1])
    return out


def fits(e: Element, tag: str, conditions: list[tuple[str, str | None]]) -> bool:
    if tag not in ("*", e.tag) or not e.tag:
        return False
    for name, value in conditions:
        if name == "class":
            if value not in e.attributes.get("class", "").split():
                return False
        elif name.startswith("@"):
            if name[1:] not in e.attributes or (value is not None and e.attributes[name[1:]] != value):
                return False
        elif e.attributes.get("id") != value:
            return False
    return True


def matches(e: Element, steps: list) -> bool:
    """Whether the last step fits an element and the steps before fit ancestors."""
    if not fits(e, *steps[0][1:]):
        return False
    if len(steps) == 1:
        return True
    up = e.parent
    if steps[0][0] == ">":
        return up is not None and matches(up, steps[1:])
    while up is not None:
        if matches(up, steps[1:]):
            return True
        up = up.parent
    return False


def select(page: str, selector: str | list) -> list[Element]:
    """Elements in the page's order that a selector names."""
    groups = compiled(selector) if isinstance(selector, str) else selector
    return [e for e in Tree(page).root.walk() if any(matches(e, g) for g in groups)]


def list_items(page: str, base: str, groups: list) -> list[dict]:
    """Title, address and time of the selected elements that have a title and a link (their own or the first inside)."""
    out = []
    for place, e in enumerate(select(page, groups)[:MOST_ITEMS]):
        href = e.attributes.get("href") or next((x.attributes["href"] for x in e.walk() if x.tag == "a" and x.attributes.get("href")), "")
        title = e.text()
        if href and title:
            time = next((x for x in e.parent.walk() if x.tag == "time"), None) if e.parent else None
            out.append({"place": place, "title": title, "url": urljoin(base, href), "published": time.attributes.get("datetime", "") if time else ""})
    return out


def html_list(pages: DataFrame, selector: str) -> DataFrame:
    """page_id, place, title, url, published of list entries. pages: page_id, url, html. At most MOST_ITEMS entries a page,
    as the rule says."""
    groups = compiled(selector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [{"page_id": page_id} | item for item in list_items(html or "", url or "", groups)]
            columns = [pa.array([r[c] for r in rows], t) for c, t in (("page_id", pa.int64()), ("place", pa.int32()), ("title", pa.string()), ("url", pa.string()), ("published", pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "place", "title", "url", "published"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, place int, title string, url string, published string")


# ---- citations ------------------------------------------------------------------------------------------------------

#: Characters behind a marker that a citation may fill, and aliases that one automaton holds.
REACH, MOST_ALIASES = 90, 500_000


def alias_index(sources: DataFrame) -> DataFrame:
    """alias (lower case, three characters or more, each once), key. sources: key, name, aliases (array). Of two keys with
    one alias the last by name counts."""
    every = sources.select("key", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    cleaned = every.select(F.trim(F.lower("alias")).alias("alias"), "key").filter(F.length("alias") >= 3)
    return cleaned.groupBy("alias").agg(F.max("key").alias("key"))


#: The last automaton that this process has built, by its block.
BUILT: dict = {}


def automaton(block: str, pairs: list[tuple[str, str]]):
    import ahocorasick

    if block not in BUILT:
        BUILT.clear()
        built = ahocorasick.Automaton()
        for alias, key in pairs:
            built.add_word(alias, key)
        if pairs:
            built.make_automaton()
        BUILT[block] = built
    return BUILT[block]


def windows_behind(text: str, marker: re.Pattern) -> list[str]:
    """Per marker the REACH characters behind it, up to the end of the sentence."""
    flat = re.sub(r"\s+", " ", text.lower())
    return [re.split(r"[.!?] ", flat[m.end() : m.end() + REACH], maxsplit=1)[0] for m in marker.finditer(flat)]


def citations(texts: DataFrame, aliases: DataFrame, marker: str) -> DataFrame:
    """id, markers (how many), keys (sorted): the sources that stand behind a marker in a text.

    texts: id, text; aliases: alias, key; marker: an expression over lower-cased text. One automaton finds all aliases in
    one scan of a window. The table of aliases goes to the tasks in blocks of at most MOST_ALIASES; with more than one the
    windows are scanned once for each, and the keys are united.
    """
    import uuid

    blocks = max(1, -(-aliases.count() // MOST_ALIASES))
    parts, rx = [], re.compile(marker)
    for block in range(blocks):
        part = aliases if blocks == 1 else aliases.filter(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == block)
        shared = texts.sparkSession.sparkContext.broadcast([(r.alias, str(r.key)) for r in part.toLocalIterator()])
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                built = automaton(name, shared.value)
                counts, keys = [], []
                for text in batch.column(1).to_pylist():
                    found = windows_behind(text or "", rx)
                    counts.append(len(found))
                    keys.append(sorted({key for w in found for _, key in built.iter(w)}) if shared.value else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.string()))], names=["id", "markers", "keys"])

        parts.append(texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, markers long, keys array<string>"))
    out = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("id").agg(F.max("markers").alias("markers"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
    return out
