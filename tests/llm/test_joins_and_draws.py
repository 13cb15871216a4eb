"""Parity-sketch join, importance resampling and whitening against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.llm import parity, resampling, whitening

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def edited(text, edits, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- parity-sketch join ---------------------------------------------------------------------------------------------


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(x), root(i)) for i, x in enumerate(sets)]


def mixed_texts():
    texts = [None, "", " \t", "one", "One", "two words", "a b c d e", "a b c d e f", "b c d e f a"]
    texts += [prose(n, n) for n in range(1, 60)]
    texts += [t + " tail" for t in texts[-40:]]  # sizes one apart, at and about the threshold
    for k in range(40):
        base = prose(30 + 7 * k, 500 + k)
        texts += [base, base.upper(), edited(base, 1, k), edited(base, 1 + k // 12, 40 + k), edited(base, 2 + k // 5, 90 + k)]
    passage = prose(120, 999)
    texts += [passage + " " + prose(20 + k, 2000 + k) for k in range(60)]  # much in common, most of them no links
    texts += [passage + " " + prose(3, 3000 + k) for k in range(30)]
    return texts


def test_parity_components(spark):
    texts = mixed_texts()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in parity.near_duplicates(frame(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(texts)


def test_parity_with_every_key_frequent(spark, monkeypatch):
    texts = mixed_texts()
    every = np.unique(np.concatenate([parity.segment_keys(t, w)[0] for x in texts if (t := parity.shingles(x)).size for w in parity.windows_of(t.size)]))
    monkeypatch.setattr(parity, "frequent_keys", lambda docs: every)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in parity.near_duplicates(frame(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(texts)


def test_windows_hold_every_pair_of_sizes():
    for a in range(1, 3000):
        for b in {a, a + 1, 5 * a // 4}:
            if 4 * b <= 5 * a:
                assert set(parity.windows_of(a)) & set(parity.windows_of(b))
    assert len(parity.WINDOWS) < 64


def test_every_link_shares_a_key():
    for seed in range(150):
        text = prose(4 + 3 * seed, seed)
        a, b = parity.shingles(text), parity.shingles(edited(text, 1 + seed // 40, seed))
        shared = np.intersect1d(a, b).size
        if 9 * shared < 4 * (a.size + b.size) or np.array_equal(a, b):
            continue
        for frequent in (np.zeros(0, np.int64), np.sort(np.concatenate([parity.segment_keys(a, w)[0][::2] for w in parity.windows_of(a.size)]))):
            keys = [set(np.concatenate([np.concatenate(parity.chosen_keys(x, w, frequent)) for w in parity.windows_of(x.size)]).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_sketch_distance_is_a_lower_bound():
    for seed in range(60):
        text = prose(10 + 9 * seed, seed)
        a, b = parity.shingles(text), parity.shingles(edited(text, seed // 6, seed) + " more" * (seed % 7))
        assert parity.distance(parity.folded(a), parity.folded(b)) <= np.setxor1d(a, b).size
        assert parity.distance(parity.folded(a), parity.folded(a)) == 0


def test_parity_edges(spark):
    rows = [(None, "w x y z a"), (5, "w x y z a"), (5, "w x y z a"), (7, None), (None, ""), (9, "x " * 30_000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, uid int, class int")
    found = sorted(parity.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    assert found == sorted([(None, 1, 5), (5, 1, 5), (5, 1, 5), (7, 0, 7), (None, 0, None), (9, 1, 9)], key=str)
    assert parity.near_duplicates(docs.limit(0)).count() == 0


# ---- importance resampling ------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_draw(docs, target, most=1, buckets=10_000, percent=10, least=20):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


DRAW_TEXTS = [None, "", "Straße, straße 北京", "a" * 5000, "ab" * 40_000 + " x"] + [prose(5 + 3 * k, k) + "; NEW-word " + "é" * (k % 4) for k in range(80)]
TARGET = [prose(40, 7), None, "Straße " + prose(9, 8)]


@pytest.mark.parametrize("most, words", [(1, 65_536), (3, 100), (2, 0)])
def test_resampling(spark, most, words):
    docs = list(enumerate(DRAW_TEXTS))
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resampling.resample(frame(spark, DRAW_TEXTS), target, most=most, max_words=words)
    found = sorted(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect()))
    assert found == plain_draw(docs, TARGET, most)


def test_resampling_ranks_over_many_parts(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("score"))
    found = sorted((r["rank"], -r.score, r.doc_id) for r in resampling.ranked(docs.repartition(9)).collect() if r["rank"])
    wanted = sorted((-r.score, r.doc_id) for r in docs.collect())[:500]
    assert found == [(k + 1, *x) for k, x in enumerate(wanted)]


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "text string")
    docs = spark.createDataFrame([(None, "x " * 25, 3), (1, None, 4), (1, None, 4)], "doc_id long, text string, rank int")
    found = resampling.resample(docs, none).collect()
    assert len(found) == 3 and {r.n_features for r in found} == {25, 0}
    assert resampling.resample(docs.limit(0), none).count() == 0


def test_chunks_of_a_scan(monkeypatch):
    text = "Alpha " + "b" * 300 + " gamma-alpha " * 20
    dictionary = resampling.Dictionary(["alpha", "nothing"])
    whole = dictionary.payloads(text)
    monkeypatch.setattr(resampling, "CHUNK", 16)
    assert [x.tolist() for x in dictionary.payloads(text)] == [x.tolist() for x in whole]


# ---- whitening ------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")


def plain_whitening(rows, components=8):
    x = np.floor(1024 * np.array(rows, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    values, turn = np.linalg.eigh(np.cov((x - s / n).T, bias=True))
    order = np.argsort(-values)[:components]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ turn[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((300, 12)) * np.logspace(1, -1, 12)).astype(np.float32).tolist()
    n, deviation, z, explained = plain_whitening(rows)
    bad = [None, [1.0, None] * 6, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [], [1.0]]
    found = sorted(whitening.whiten(vectors(spark, rows + bad).repartition(7)).collect(), key=lambda r: r.id)
    assert [r.id for r in found] == list(range(300)) and {r.n for r in found} == {n}
    assert [r.deviation for r in found] == deviation.tolist()
    got = np.array([r.whitened for r in found])
    assert np.allclose(got * np.sign(got[0]), z * np.sign(z[0]), atol=1e-8)
    assert np.allclose(found[0].explained, explained, rtol=1e-10)
    assert found[0].identity_error < 1e-9


def test_whitening_unites_many_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = np.random.default_rng(4).standard_normal((200, 5)).astype(np.float32).tolist()
    found = whitening.whiten(vectors(spark, rows).repartition(13)).first()
    assert np.allclose(found.explained, plain_whitening(rows, 5)[3], rtol=1e-10) and found.identity_error < 1e-9


def test_whitening_edges(spark):
    equal = whitening.whiten(vectors(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in equal] == [(3, 0, [None, None], [None, None], None)] * 3
    few = whitening.whiten(vectors(spark, np.random.default_rng(5).standard_normal((4, 10)).tolist())).collect()
    assert all(sum(z is None for z in r.whitened) == 5 for r in few) and few[0].identity_error < 1e-8
    assert whitening.whiten(vectors(spark, [None, []])).count() == 0
    far = whitening.whiten(vectors(spark, [[3e12, 0.0], [-3e12, 1.0]])).collect()
    assert all(r.deviation is None for r in far)


def test_solver_on_equal_values():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    values = np.array([5.0, 5.0, 5.0, 4.0, 4.0, 3.0] + [1.0] * 10 + [1e-9] * 4)
    r = np.linalg.qr(np.diag(np.sqrt(values)) @ q.T, mode="r")
    found, u = whitening.right_vectors(r, 8)
    assert np.allclose(found[:16], values[:16], rtol=1e-12) and np.allclose(u.T @ u, np.eye(8), atol=1e-13)
    assert np.allclose(r.T @ (r @ u), u * found[:8], atol=1e-12)
