"""Ledgers, replay, repeats, page lists and citations."""

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storyline.operators import ledger, repeats
from storyline.sources import markup

SIZE = 4


@pytest.fixture(scope="module")
def log(spark):
    rows = spark.createDataFrame([(i, None if i == 5 else f"entry {i}") for i in range(70)], "pos long, payload string").repartition(5)
    return ledger.ledger(rows, SIZE).cache()


def found(df):
    return sorted((r.level, r.pos, r.reason) for r in ledger.verified(df, SIZE).collect())


def test_chain_equals_plain_python(log):
    rows = {(r.level, r.pos): r for r in log.collect()}
    assert sorted({k[0] for k in rows}) == [0, 1, 2, 3] and len([k for k in rows if k[0] == 3]) == 2
    for pos in range(70):
        before = f"segment {pos // SIZE}" if pos % SIZE == 0 else rows[0, pos - 1].hash
        payload = "" if pos == 5 else f"entry {pos}"
        assert rows[0, pos].hash == hashlib.sha256(f"{before}|{pos}|{payload}".encode()).hexdigest()
    assert rows[1, 17].payload == f"2 {rows[0, 69].hash}"
    assert found(log) == []


@pytest.mark.parametrize("level, pos", [(0, 0), (0, 37), (0, 69), (1, 3)])
def test_edits_are_found(log, level, pos):
    here = (F.col("level") == level) & (F.col("pos") == pos)
    edited = log.withColumn("payload", F.when(here, "other").otherwise(F.col("payload")))
    assert (level, pos, "edited") in found(edited)
    # an edit with a new hash breaks the link to the next row, or the segment's head
    fresh = edited.withColumn("hash", F.when(here, ledger.link_hash(F.col("prev_hash"), F.col("pos"), F.col("payload"))).otherwise(F.col("hash")))
    found_ = found(fresh)
    assert found_ and (level, pos, "edited") not in found_
    assert ((level, pos + 1, "link") in found_) if pos % SIZE != SIZE - 1 and pos != 69 else ((level, pos // SIZE, "head") in found_)


def test_gaps_and_cut_tails(log):
    base = F.col("level") == 0
    assert (0, 9, "gap") in found(log.filter(~(base & (F.col("pos") == 9)))) and (0, 2, "head") in found(log.filter(~(base & (F.col("pos") == 9))))
    assert found(log.filter(~(base & (F.col("pos") == 69)))) == [(0, 17, "head")]
    assert found(log.filter(~(base & (F.col("pos") >= 68)))) == [(0, 17, "lost")]


def test_empty_ledger(spark):
    none = ledger.ledger(spark.createDataFrame([], "pos long, payload string"))
    assert none.count() == 0 and ledger.verified(none).count() == 0


def test_replay_equals_row_by_row(spark):
    rng = random.Random(2)
    rows = [(s, rng.randrange(40), rng.choice(["set", "add", "add", "add", "revoke"] if rng.random() < 0.3 else ["set", "add"]), Decimal(rng.randrange(1, 100))) for s in range(600)]
    log = spark.createDataFrame(rows, "seq long, key long, op string, value decimal(38, 6)").repartition(4)
    state = {}
    for _, key, op, value in rows:
        old, revoked = state.get(key, (Decimal(0), False))
        if revoked:
            state[key] = (old, True)
        else:
            state[key] = (value if op == "set" else old + value if op == "add" else old, op == "revoke")
    none = spark.createDataFrame([], "key long, value decimal(38, 6), revoked boolean")
    for cut in (-1, 100, 350, 599):
        snapshot = ledger.replayed(none, log.filter(F.col("seq") <= cut), -1)
        got = {r.key: (r.value, r.revoked) for r in ledger.replayed(snapshot, log, cut).collect()}
        assert got == state


def test_missing_numbers(spark):
    have = [3, 4, 7, 65_535, 65_536, 65_538, 400_000]
    log = spark.createDataFrame([(s,) for s in have + [4]], "seq long")
    assert sorted(map(tuple, ledger.missing(log).collect())) == [(5, 6), (8, 65_534), (65_537, 65_537), (65_539, 399_999)]
    assert ledger.missing(log.limit(0)).count() == 0


# ---- repeats --------------------------------------------------------------------------------------------------------


def test_events_do_not_meet_by_numbers_alone(spark):
    """Numbers that all share add too little; titles alike enough meet, once."""
    columns = "id long, at long, langs array<string>, title array<string>, ent array<string>, num array<string>"
    rows = [(i, i, ["en"], [f"t{i}", f"u{i}"], [f"e{i}"], ["10", "20"]) for i in range(30)] + [(90, 90, ["en"], ["t3", "u3"], ["e3"], ["10", "20"])]
    events = spark.createDataFrame(rows, columns)
    assert [tuple(r) for r in repeats.candidates(events, events.filter("id < 90")).collect()] == [(90, 3)]
    assert [(r.id, r.previous, round(r.sim, 9)) for r in repeats.best_matches(events, events.filter("id < 90")).collect()] == [(90, 3, 1.0)]


def test_repeats_equal_all_pairs(spark):
    rng = random.Random(6)
    words, names = [f"w{i}" for i in range(25)], [f"n{i}" for i in range(12)]

    def event(i):
        pick = lambda pool, most: rng.sample(pool, rng.randint(0, most))
        return (i, i * 10, rng.choice([["en"], ["de"], ["en", "de"]]), pick(words, 6), pick(names, 4), pick(["10", "20", "35", "47"], 3), rng.randint(1, 9), rng.random() < 0.1)

    rows = [event(i) for i in range(120)] + [(200, 5000, ["en"], [], [], [], 1, False), (201, 5000, ["en"], None, None, None, 1, False)]
    columns = "id long, at long, langs array<string>, title array<string>, ent array<string>, num array<string>, independent int, followup boolean"
    events = spark.createDataFrame(rows, columns)
    published = events.filter("id % 3 = 0").drop("followup")
    got = {r.id: (r.previous, None if r.sim is None else round(r.sim, 9), r.verdict) for r in repeats.verdicts(events, published, window=600).collect()}
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    for a in rows:
        best = (0.0, None)
        for b in rows:
            if b[0] % 3 == 0 and b[1] < a[1] <= b[1] + 600:
                title = jaccard(a[3], b[3]) if set(a[2]) & set(b[2]) else 0.0
                sim = round(0.45 * title + 0.35 * jaccard(a[4], b[4]) + 0.2 * jaccard(a[5], b[5]), 9)
                if sim >= 0.45 and (sim, -b[0]) > (best[0], -(best[1][0] if best[1] else 10**9)):
                    best = (sim, b)
        if best[1] is None:
            assert got[a[0]] == (None, None, "new")
        else:
            b = best[1]
            stage = set(a[5]) - set(b[5]) or (a[6] >= 2 * max(1, b[6]) and a[6] - b[6] >= 3) or a[7]
            assert got[a[0]] == (b[0], best[0], "new_stage" if stage else "duplicate")
    assert {v for _, _, v in got.values()} == {"new", "new_stage", "duplicate"}


def test_events_without_entities_and_numbers_meet_by_equal_titles_only(spark):
    columns = "id long, at long, langs array<string>, title array<string>, ent array<string>, num array<string>"
    rows = [(i, i, ["en"], ["a", "b", "c", "d", f"t{i}"], [], []) for i in range(30)] + [(90, 90, ["en"], ["d", "c", "b", "a", "t3"], [], [])]
    events = spark.createDataFrame(rows, columns)
    assert [tuple(r) for r in repeats.candidates(events, events.filter("id < 90")).collect()] == [(90, 3)]
    assert [tuple(r) for r in repeats.best_matches(events, events.filter("id < 90")).collect()] == [(90, 3, 0.45)]


@pytest.mark.parametrize("window", [None, 300])
def test_matches_of_copies_with_ids_in_no_order_equal_all_pairs(spark, window):
    """Many events of few profiles: the smallest id of the earlier ones, whatever the order of ids, equal times left out."""
    rng = random.Random(8)
    kinds = [(rng.choice([["en"], ["de"], ["en", "de"], [None], None]), rng.sample("abcdef", rng.randint(0, 4)), rng.sample("nmo", rng.randint(0, 3)), rng.sample("12", rng.randint(0, 2))) for _ in range(12)]
    ids = rng.sample(range(1000), 150)
    rows = [(i, rng.randint(0, 80) * 10, *rng.choice(kinds)) for i in ids]
    events = spark.createDataFrame(rows, "id long, at long, langs array<string>, title array<string>, ent array<string>, num array<string>")
    got = {r.id: (r.previous, round(r.sim, 9)) for r in repeats.best_matches(events, events.filter("id % 4 < 3"), window).collect()}
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    wanted = {}
    for a in rows:
        best = None
        for b in rows:
            if b[0] % 4 < 3 and b[1] < a[1] and (window is None or a[1] - b[1] <= window):
                title = jaccard(a[3], b[3]) if set(a[2] or []) & set(b[2] or []) - {None} else 0.0
                sim = round(0.45 * title + 0.35 * jaccard(a[4], b[4]) + 0.2 * jaccard(a[5], b[5]), 9)
                if sim >= 0.45 and (best is None or (sim, -b[0]) > best):
                    best = (sim, -b[0])
        if best:
            wanted[a[0]] = (-best[1], best[0])
    assert got == wanted and len(wanted) > 50


# ---- page lists -----------------------------------------------------------------------------------------------------

PAGE = """<html><body><div id=main class="list top"><ul><li class=news><a href="/a">First <b>one</b></a><time datetime="2024-01-02">x</time>
<li class=news>Second <a href='b?x=1&amp;y=2'>two</a><li><p>no link</ul><div class="box"><a class="news" href="http://o.org/c">Third</a>
<div><a class="news">no address</a></div></div><a data-k="v w" href="/d">D</a></div><p>open <p>next <a href="/e">E</a></span></body>"""


@pytest.mark.parametrize(
    "selector, titles",
    [
        ("a.news", ["Third", "no address"]),
        ("li.news", ["First one x", "Second two"]),
        ("li.news > a", ["First one", "two"]),
        ("#main li a", ["First one", "two"]),
        ("div.list.top > a", ["D"]),
        ("div > a", ["Third", "no address", "D"]),
        ('a[data-k="v w"]', ["D"]),
        ("a[data-k]", ["D"]),
        ("body > p", ["open", "next E"]),
        ("p a, time", ["x", "E"]),
        ("ul *", ["First one", "one", "x", "Second two", "two", "no link", "no link"]),
    ],
)
def test_selectors(selector, titles):
    found_ = [e.text() for e in markup.select(PAGE, selector)]
    assert found_ == titles if selector != "ul *" else sorted(set(titles)) == sorted(set(found_) - {"First one x"})


def test_wrong_selectors():
    for selector in ("", "a,", "..x", "a:hover"):
        with pytest.raises(ValueError):
            markup.compiled(selector)


def test_html_list(spark):
    pages = spark.createDataFrame([(1, "http://h.org/x/", PAGE), (2, "http://h.org", None), (3, None, "<li class=news><a href=/z>Z"), (4, "u", "<" * 5000 + "<div>" * 3000)], "page_id long, url string, html string")
    rows = sorted((r.page_id, r.place, r.title, r.url, r.published) for r in markup.html_list(pages, "li.news").collect())
    assert rows == [(1, 0, "First one x", "http://h.org/a", "2024-01-02"), (1, 1, "Second two", "http://h.org/x/b?x=1&y=2", "2024-01-02"), (3, 0, "Z", "/z", "")]


# ---- citations ------------------------------------------------------------------------------------------------------


def test_citations_over_many_aliases(spark, monkeypatch):
    sources = spark.createDataFrame([("reuters", "Reuters", ["Thomson Reuters", " rts "]), ("bbc", "BBC", None), ("b2", "bbc", []), ("x", "ab", ["xy"])], "key string, name string, aliases array<string>")
    index = {r.alias: r.key for r in markup.alias_index(sources).collect()}
    assert index == {"reuters": "reuters", "thomson reuters": "reuters", "rts": "reuters", "bbc": "bbc"}
    many = spark.range(100_000).selectExpr("concat('source number ', id, ' end') AS alias", "concat('s', id) AS key")
    aliases = many.unionByName(sources.filter("key = 'reuters'").selectExpr("'reuters' AS alias", "key"))
    texts = [(1, "It rained, according to Reuters and Source   Number 77 end. Reuters!"), (2, "according to nobody. reuters"), (3, None), (4, "no marker, reuters"), (5, "according to " + "x" * 88 + " reuters")]
    df = spark.createDataFrame(texts, "id long, text string")
    wanted = {1: (1, ["reuters", "s77"]), 2: (1, []), 3: (0, []), 4: (0, []), 5: (1, [])}
    assert {r.id: (r.markers, r["keys"]) for r in markup.citations(df, aliases, "according to ").collect()} == wanted
    monkeypatch.setattr(markup, "MOST_ALIASES", 40_000)
    assert {r.id: (r.markers, r["keys"]) for r in markup.citations(df, aliases, "according to ").collect()} == wanted
    assert {r.id: r["keys"] for r in markup.citations(df, aliases.limit(0), "according to ").collect()} == {k: [] for k in wanted}
