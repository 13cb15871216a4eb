"""Events from reports: blocking, scores, merging and micro-batches against plain Python."""

import itertools
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from storyline.operators import profiles, stories
from storyline.plans import cluster_queries
from storyline.sources.scratch import TABLES
from storyline.streaming import stories as stream

H = 3600
RNG = random.Random(5)
WORDS = ["".join(RNG.choices("bcdfgklmnprst", k=1) + RNG.choices("aeiou", k=1) + RNG.choices("klmnprst", k=RNG.randint(1, 4))) for _ in range(120)]


def report(i, topic, rng, hours=None):
    """A report of a topic: some of its words, names and numbers, and some of its own."""
    base = random.Random(topic)
    words, names, numbers = base.sample(WORDS, 14), base.sample(WORDS, 4), [str(base.randrange(101, 999)) for _ in range(3)]
    lang = rng.choice(["en", "en", "de"])
    sec = int((topic * 5 + rng.random() * 12 if hours is None else hours) * H)
    terms = rng.sample(words, 9) + rng.sample(WORDS, 5)
    return (i, lang, sec, rng.sample(words, 4), terms, rng.sample(names, 3), rng.sample(names, 1), rng.sample(numbers, 2), [f"quote {topic} so"] if rng.random() < 0.2 else [], ["2024-01-02"] if rng.random() < 0.3 else [])


def reports(n=90, topics=12, seed=1):
    rng = random.Random(seed)
    rows = [report(i, rng.randrange(topics), rng) for i in range(n)]
    return rows + [(n, "en", 5 * H, [], [], [], [], [], [], []), (n + 1, "en", 5 * H, None, None, None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, stream.REPORT)


# ---- the rule in plain Python ---------------------------------------------------------------------------------------


def specific(key):
    return min(1.0, 0.25 + 0.25 * len(key.rstrip("0")))


class Profile:
    """Items of an event (or of one report) as dictionaries."""

    def __init__(self, rows):
        self.tf, self.title, self.ent, self.title_ent, self.num, self.quote, self.date = {}, set(), {}, set(), set(), set(), set()
        langs = {}
        for _, lang, _, title, terms, ents, title_ents, nums, quotes, dates in rows:
            title, terms, ents, title_ents = title or [], terms or [], ents or [], title_ents or []
            langs[lang] = langs.get(lang, 0) + 1
            for t in set(terms) | set(title):
                self.tf[lang, t] = self.tf.get((lang, t), 0) + (2 if t in title else 1)
            self.title |= {(lang, t) for t in title}
            for e in set(ents) | set(title_ents):
                self.ent[e] = max(self.ent.get(e, 0), 2 if e in title_ents else 1)
            self.title_ent |= set(title_ents)
            self.num |= set(nums or [])
            self.quote |= set(quotes or [])
            self.date |= set(dates or [])
        self.lang = max(langs, key=lambda k: (langs[k], k))
        self.sec, self.size = min(r[2] for r in rows), len(rows)


def plain_score(v, p, df, n):
    idf = lambda kind, key: math.log((n + 2) / (df.get((kind, *key), 0) + 1)) + 1
    x = {k: min(w, 2) * idf("term", k) for k, w in v.tf.items() if k[0] == v.lang}
    y = {k: (1 + math.log(w) if w > 1 else w) * idf("term", k) for k, w in p.tf.items() if k[0] == v.lang}
    same = any(k[0] == v.lang for k in [*p.tf, *p.title])
    norm = math.sqrt(sum(a * a for a in x.values()) * sum(b * b for b in y.values()))
    cos = sum(a * y.get(k, 0) for k, a in x.items()) / norm if same and norm else 0
    tv, tp = ({k for k in s.title if k[0] == v.lang} for s in (v, p))
    title = sum(idf("title", k) for k in tv & tp) / sum(idf("title", k) for k in tv | tp) if same and tv | tp else 0
    shared = set(v.ent) & set(p.ent)
    keys = set(v.ent) | set(p.ent)
    ent = sum(min(v.ent[k], p.ent[k]) for k in shared) / sum(max(v.ent.get(k, 0), p.ent.get(k, 0)) for k in keys) if keys else 0
    in_title, nums = len(v.title_ent & set(p.ent)), v.num & p.num
    num_w = sum(map(specific, nums))
    num = min(1, num_w / max(1, 0.75 * min(len(v.num), len(p.num)))) if v.num and p.num else 0
    quote, date = bool(v.quote & p.quote), bool(v.date & p.date)
    gap = abs(v.sec - p.sec) / H
    time = 1 if gap <= 24 else max(0.35, 1 - (gap - 24) / 70)
    lexical = (0.44 * cos + 0.14 * title + 0.18 * ent + 0.16 * num + 0.06 * quote + 0.1 * bool(quote and shared)) * (0.75 + 0.25 * time) if same else 0
    other = (0.4 * ent + 0.35 * num + 0.1 * date + 0.15 * min(1, in_title / 3)) * (0.8 + 0.2 * time)
    k = len(shared)
    first = lexical >= 0.3 and cos >= 0.15 and (k >= 2 or num_w >= 0.75 or cos >= 0.5) and (in_title >= 1 or title >= 0.15 or cos >= 0.4 or num_w >= 1.5)
    second = other >= 0.3 and ((k >= 2 and num_w >= 1.2) or (k >= 1 and num_w >= 1.75) or (k >= 3 and num_w >= 0.75) or (k >= 5 and in_title >= 1))
    return max(lexical, other), cos, not same, first or second


def plain_frequencies(rows):
    df = {}
    for r in rows:
        p = Profile([r])
        for kind, keys in (("term", p.tf), ("title", p.title)):
            for key in keys:
                df[kind, *key] = df.get((kind, *key), 0) + 1
    return df


def plain_links(rows, df, n, horizon=72 * H):
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    found = {}
    for p, v in itertools.combinations(ordered, 2):
        if v[2] - p[2] <= horizon:
            score, cos, _, attach = plain_score(Profile([v]), Profile([p]), df, n)
            if attach:
                found[v[0], p[0]] = (round(score, 9), round(cos, 9))
    return found


def plain_components(ids, links):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in links:
            least = min(new[a], new[b])
            new[a] = new[b] = least
        if new == label:
            return label
        label = new


@pytest.fixture(scope="module")
def given(spark):
    rows = reports()
    items = stories.report_items(frame(spark, rows)).cache()
    heads = frame(spark, rows).select("id", "lang", "sec", F.lit(1).cast("long").alias("size"))
    return rows, heads, items, stories.frequencies(items).cache(), len(rows)


def test_attaching_pairs_equal_all_pairs(given):
    rows, heads, items, df, n = given
    found = {(r.v, r.p): (round(r.score, 9), round(r.cos, 9)) for r in stories.attached(heads, stories.weighted(items, df, n)).collect()}
    plain = plain_links(rows, plain_frequencies(rows), n)
    assert set(found) == set(plain) and len(plain) > 100
    assert all(found[k] == pytest.approx(plain[k], abs=1e-8) for k in plain)


def test_best_event_is_the_best_of_all(given, spark):
    rows, heads, items, df, n = given
    old = [r for r in rows if r[0] % 4]
    labels = plain_components([r[0] for r in old], plain_links(old, plain_frequencies(rows), n))
    new = spark.createDataFrame([(r[0],) for r in rows if not r[0] % 4], "id long")
    found = stories.best_event(heads.select("id", "lang", "sec"), new, items, spark.createDataFrame(list(labels.items()), "id long, event long"), df, n)
    found = {r.id: (r.event, round(r.score, 8)) for r in found.collect()}
    events = {e: Profile([r for r in old if labels[r[0]] == e]) for e in set(labels.values())}
    plain = {}
    for r in rows:
        if r[0] % 4 == 0:
            v = Profile([r])
            able = []
            for e, p in events.items():
                if (p.sec, e) < (v.sec, r[0]) and v.sec - p.sec <= 72 * H:
                    score, _, _, attach = plain_score(v, p, plain_frequencies(rows), n)
                    able += [(score, -e)] if attach else []
            if able:
                plain[r[0]] = (-max(able)[1], round(max(able)[0], 8))
    assert found == plain and plain


def plain_merged(rows, labels, df, n):
    while True:
        events = {e: Profile([r for r in rows if labels[r[0]] == e]) for e in set(labels.values())}
        links = []
        for a, b in itertools.combinations(sorted(events), 2):
            later, earlier = (a, b) if (events[a].sec, a) > (events[b].sec, b) else (b, a)
            v, p = (later, earlier) if events[later].size <= events[earlier].size else (earlier, later)
            if abs(events[a].sec - events[b].sec) <= 60 * H:
                score, cos, cross, attach = plain_score(events[v], events[p], df, n)
                links += [(a, b)] if attach and score >= 0.42 and (cos >= 0.3 or cross) else []
        if not links:
            return labels
        into = plain_components(list(events), links)
        labels = {i: into[e] for i, e in labels.items()}


def test_merging_is_the_same_for_any_order(given, spark):
    rows, heads, items, df, n = given
    start = {r[0]: r[0] for r in rows}
    plain = plain_merged(rows, start, plain_frequencies(rows), n)
    assert len(set(plain.values())) < len(rows) - 20
    random.Random(1).shuffle(rows := rows[:])
    labels = spark.createDataFrame([(r[0], r[0]) for r in rows], "id long, event long").repartition(3)
    found = stories.merged(frame(spark, rows).select("id", "lang", "sec"), items, labels, df, n)
    assert {r.id: r.event for r in found.collect()} == plain


def run_batches(spark, tmp_path, batches, **options):
    state = stream.EventState(spark, str(tmp_path / "state"))
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.run_available(spark, str(tmp_path / "in"), state, **options)  # every run starts from the checkpoint
    return state


def test_several_batches_give_the_events_of_one(given, spark, tmp_path):
    rows, _, _, df, n = given
    plain = plain_components([r[0] for r in rows], plain_links(rows, plain_frequencies(rows), n))
    ordered = sorted(rows, key=lambda r: r[2])
    state = run_batches(spark, tmp_path, [ordered[:40], ordered[40:41], ordered[41:] + ordered[:3]], frozen=(df, n))
    assert {r.id: r.event for r in stream.events_of(state).collect()} == plain
    # a batch that runs again changes nothing
    batch = spark.read.schema(stream.REPORT).parquet(str(tmp_path / "in")).join(frame(spark, ordered[41:]).select("id"), "id", "left_semi")
    stream.advance(batch, 2, state, frozen=(df, n))
    assert {r.id: r.event for r in stream.events_of(state).collect()} == plain


def test_batches_are_written_by_many_tasks_and_keep_their_cuts(given, spark, tmp_path):
    """One row a batch that names its reports, which stand in several files; of these what no later report can meet leaves the state."""
    rows, _, _, df, n = given
    state, many = stream.EventState(spark, str(tmp_path / "state")), frame(spark, rows).repartition(3)
    source, folders = stream.arrivals(many, 3, f"parts-{tmp_path.name}")
    assert [spark.read.schema(stream.PART).parquet(source).count(), len(folders)] == [3, 3]
    parts = [spark.read.schema(stream.REPORT).parquet(f) for f in folders]
    assert all(len(p.inputFiles()) > 1 for p in parts) and sum(p.count() for p in parts) == len(rows)
    ends = [p.agg(F.min("sec"), F.max("sec")).first() for p in parts]
    assert ends[0][1] < ends[1][0] and ends[1][1] < ends[2][0]
    stream.run_available(spark, source, state, parts=True, frozen=(df, n), horizon=3600, delay=3600)
    assert state.all("assigned", "id long, event long").groupBy("batch").count().count() == 3
    live = {r.id for r in state.get("live", 2, stream.LIVE).collect()}
    last = max(r[2] for r in rows)
    assert live == {r[0] for r in rows if r[2] >= last - 7200}
    stream.run_available(spark, source, state, parts=True, frozen=(df, n))  # nothing has come since
    assert {r.id for r in state.get("live", 2, stream.LIVE).collect()} == live


def test_horizon_drops_state_and_late_reports(spark, tmp_path):
    rng = random.Random(3)
    early, middle, far = ([report(100 * k + i, 1, rng, hours) for i in range(4)] for k, hours in enumerate((0, 50, 400)))
    late = [report(999, 1, rng, 1)]
    state = run_batches(spark, tmp_path, [early, middle, far, late])
    live = {r.id for r in state.get("live", 3, stream.LIVE).collect()}
    assert live == {r[0] for r in far}
    assert [r.late for r in state.all("late", "late long").orderBy("batch").collect()] == [0, 0, 0, 1]
    events = {r.id: r.event for r in stream.events_of(state).collect()}
    assert 999 not in events and set(events) == {r[0] for r in early + middle + far}
    assert not {events[r[0]] for r in far} & {events[r[0]] for r in early + middle}


def test_every_batch_sees_the_frequencies_before_it(spark, tmp_path):
    rows = sorted(reports(40), key=lambda r: r[2])
    parts = [rows[:15], rows[15:30], rows[30:]]
    state = run_batches(spark, tmp_path, parts)
    for k in (1, 2):
        found = {(r.kind, r.lang, r.key): r.df for r in state.get("frequencies", k, stream.FREQUENCY).collect() if r.kind in stories.OF_LANGUAGE}
        assert found == plain_frequencies(sum(parts[: k + 1], []))
    links = {(r.v, r.p): round(r.score, 8) for r in state.get("links", 1, "v long, p long, score double, cos double").collect()}
    plain = plain_links(rows[:30], plain_frequencies(parts[0]), 15)
    assert links == {k: round(s, 8) for k, (s, _) in plain.items() if {*k} & {r[0] for r in parts[1]}}


def test_empty_tables(spark):
    none = frame(spark, [])
    items = stories.report_items(none)
    heads = none.select("id", "lang", "sec", F.lit(1).cast("long").alias("size"))
    df = stories.frequencies(items)
    assert stories.attached(heads, stories.weighted(items, df, 0)).count() == 0
    assert stories.merged(none.select("id", "lang", "sec"), items, none.select("id", F.col("id").alias("event")), df, 0).count() == 0


@pytest.mark.parametrize("known", [0, 40])
def test_pairs_are_the_same_in_small_tiles_and_with_joined_weights(given, spark, monkeypatch, known):
    rows, _, _, _, n = given
    monkeypatch.setattr(profiles, "TILE", 7)
    monkeypatch.setattr(profiles, "MOST_KNOWN", known)
    hashed = profiles.hashed(frame(spark, rows))
    for all_counted in (True, False):
        found = stories.attached_profiles(profiles.packed(hashed, profiles.frequencies(hashed), n, all_counted)).collect()
        plain = plain_links(rows, plain_frequencies(rows), n)
        scores = {(r.v, r.p): r.score for r in found}
        assert len(found) == len(plain) and scores == pytest.approx({k: s for k, (s, _) in plain.items()}, abs=1e-8)


def test_pairs_of_reports_leave_little_on_disk(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "en", " ".join(rng.choices(WORDS, k=60) + [f"{rng.randrange(10**9):x}" for _ in range(60)])) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    mark = len(TABLES)
    assert cluster_queries.story_pairs(spark, str(tmp_path)).count() >= 0
    size = lambda path: sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
    assert sum(map(size, TABLES[mark:])) < 2 * size(str(tmp_path / "documents.parquet"))  # before: rows of items, three times
