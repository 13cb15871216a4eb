"""Near duplicates, contamination, packing, sharding, toxicity and the pipeline against plain Python."""

import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from storyline.llm import decontaminate, packing, registry, sharding, simhash, toxicity

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    texts = [None, "", " ", "one", "Two words", "two WORDS"]
    for i in range(30):
        base = prose(200, i).split()
        texts.append(" ".join(base))
        for k in range(3):
            copy = list(base)
            copy[random.Random(100 * i + k).randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates(spark):
    texts = near_texts()
    found = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert len(found) == len(texts)
    for i in range(len(texts)):
        assert found[i].fp & (2**64 - 1) == prints[i]
        assert found[i].component_id == root(i)


def test_keys_find_all_within_three_bits():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for errors in (1, 2, 3):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, errors, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        rows_a, keys_a = simhash.keys_of(base.view(np.int64))
        rows_b, keys_b = simhash.keys_of(other.view(np.int64))
        for i in range(len(base)):
            assert set(keys_a[rows_a == i]) & set(keys_b[rows_b == i])


def test_golay_decodes_three_errors():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 2000)
    near = words ^ simhash.ERRORS[simhash.syndromes(words)]
    assert (simhash.syndromes(near) == 0).all() and (np.bitwise_count(words ^ near) <= 3).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 600), (600, 500)], "a long, b long")
    found = {r.node: r.component for r in simhash.connected_components(links).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[600] == found[500] == 500
    assert simhash.connected_components(links.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(5, "a b c d", "x"), (3, "a b c d", "y"), (3, "a b c d", "y"), (None, "e f g h", "z"), (9, None, "n")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r.doc_id or 0, r.fp) for r in kept) == [(0, "z"), (3, "y"), (9, "n")]


def test_keep_one_with_clashing_columns(spark):
    rows = [(5, "a b c d", 1, "x", 0), (3, "a b c d", 2, "y", 0), (3, "a b c d", 2, "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash string, class int")
    for keep_one in (simhash.keep_one, corpus_pipeline.jaccard.keep_one):
        kept = keep_one(docs)
        assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[1]]


def test_a_frequent_key_is_split_without_losing_links(spark):
    """Fingerprints that share two whole segments, over the bound for one bucket."""
    rng = np.random.default_rng(8)
    prints = np.unique(rng.integers(0, 1 << 21, 700).astype(np.int64) | (5 << 42))
    frame_ = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    near = {(int(prints[i]), int(prints[j])) for i, j in zip(*np.nonzero(apart <= 3)) if i < j}
    roots = []
    for split in (64, simhash.SPLIT):
        found = simhash.link_fingerprints(frame_, split=split)
        assert {(r.a, r.b) for r in found.collect()} <= near
        roots.append({r.node: r.component for r in simhash.connected_components(found).collect()})
    assert roots[0] == roots[1] and {x for pair in near for x in pair} == set(roots[0])


def plain_hits(words, items, window=13):
    hit, found = set(), set()
    for item, test in items:
        n = min(window, len(test))
        grams = {tuple(test[i : i + n]) for i in range(len(test) - n + 1)} if test else set()
        for i in range(len(words) - n + 1):
            if grams and tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return hit, found


def test_contamination(spark):
    items = [prose(40, 900), "short item", "", None, prose(13, 901), prose(60, 902)]
    texts = [None, "", prose(50, 1), items[0], items[0].upper() + ", " + prose(900, 2), "x short, ITEM y", " ".join(items[5].split()[:12]), " ".join(items[5].split()[5:18]) + " end", items[4] + " " + items[4]]
    bench = frame(spark, items).withColumnRenamed("doc_id", "item_id")
    parsed = [(i, decontaminate.words_of(t)) for i, t in enumerate(items)]
    for limit in (4_000_000, 30):  # one block of items, and several
        found = {r.doc_id: r for r in decontaminate.find_matches(frame(spark, texts), bench, max_block_words=limit).collect()}
        for i, text in enumerate(texts):
            words = decontaminate.words_of(text)
            hit, ids = plain_hits(words, parsed)
            assert set(found[i].hits) == hit and {m.item_id for m in found[i].matches} == ids and found[i].n_words == len(words)
        assert max(m.length for m in found[3].matches) == 40
        clean = {r.doc_id for r in decontaminate.keep_clean(frame(spark, texts), bench, max_block_words=limit).collect()}
        assert clean == {i for i, t in enumerate(texts) if not (h := plain_hits(decontaminate.words_of(t), parsed)[0]) or 20 * len(h) < len(decontaminate.words_of(t))}


def test_search_of_suffixes_at_the_end_of_a_block():
    """One suffix's range is closed at the end of the array, whose last suffix ends the block, while another's is open."""
    found = decontaminate.TestSuffixes([(1, [b"p", b"q", b"r"] * 5), (2, [b"z", b"y", b"x"] * 5), (3, [b"z", b"z", b"y"])], 13)
    hits = [h for h, _ in found.matches([[b"p", b"q", b"r"] * 5, [b"z", b"y", b"x"] * 5, [b"z"]])]
    assert hits == [list(range(15)), list(range(15)), []]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    for words in (1, 2, 3, 50):
        seq = np.append(rng.integers(0, words + 1, 400) * (rng.random(400) < 0.97), 0)
        seq[100:150] = seq[200:250]

        def suffix(p, seq=seq.tolist()):
            return seq[p : seq.index(0, p)]

        array = decontaminate.suffix_array(seq).tolist()
        assert sorted(array) == np.flatnonzero(seq).tolist()
        assert [suffix(p) for p in array] == sorted(suffix(p) for p in array)


def test_contamination_among_very_many_words():
    """Numbers of over two million different test words: no key overflows, a verbatim copy is found."""
    many = [(b"%d" % i) for i in range(2_200_000)]
    tests = decontaminate.TestSuffixes([(7, many)], 13)
    hits, matches = tests.matches([many[-40:], many[5:17], many[:20] + [b"x"] + many[100:113]])[0]
    assert hits == list(range(40)) and matches == [{"item_id": 7, "item_start": 2_199_960, "doc_start": 0, "length": 40}]
    found = tests.matches([many[5:17], many[:20] + [b"x"] + many[100:113]])
    assert found[0] == ([], []) and [(m["doc_start"], m["length"]) for m in found[1][1]] == [(21, 13), (0, 20)]


def test_packing(spark):
    texts = [None, "", *(prose(n, n) for n in (1, 5, 50, 500, 500, 3000, 9000, 40, 40, 41)), "Ünïcode ﬁ 日本語 it's 12"]
    rows = packing.pack(packing.pieces(frame(spark, texts))).collect()
    encoder = packing.Encoder(packing.tokenizer_path())
    bins = {}
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = np.concatenate((np.frombuffer(encoder.whole([text or ""])[0], "<u4"), [1])).astype("<u4")
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and (r.length == 4096 or r is own[-1])
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in rows) // 4096)


def test_packing_with_a_frequent_length(spark):
    texts = ["same words here"] * 300 + [prose(n, n) for n in range(1, 60)]
    rows = packing.pack(packing.pieces(frame(spark, texts)), least_buckets=2, bucket_rows=20).collect()
    assert len(rows) == len(texts) == len({(r.sequence_id, r.offset) for r in rows})
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        assert all(o == sum(n for p, n in content if p < o) for o, _ in content) and sum(n for _, n in content) <= 4096


def test_packing_plan_uses_every_piece():
    for seed in range(20):
        rng = random.Random(seed)
        counts = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(rng.randint(1, 40))}
        used = {}
        for content, times in packing.plan(dict(counts), 100):
            assert sum(content) <= 100 and times > 0
            for n in content:
                used[n] = used.get(n, 0) + times
        assert used == counts


def test_encoder_equals_tokenizer():
    encoder = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(3)
    signs = [chr(c) for c in [*range(0x180), *range(0x2010, 0x2028)]] + ["'s", "'t", " ", " ", "re", "thing", "Σ", "İ", "é"] * 20
    for _ in range(2000):
        text = "".join(rng.choices(signs, k=15))
        assert encoder.encode(text) == encoder.whole([text])[0], repr(text)


def test_sharding(spark, tmp_path):
    texts = [prose(RNG.randint(0, 60), i) for i in range(500)] + [None, ""]
    rows = sharding.shard(frame(spark, texts), path=str(tmp_path)).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        sizes.setdefault(r.shard, []).append((r.slot, r.size))
    assert set(sizes) == set(range(16))
    totals = [sum(s for _, s in v) for v in sizes.values()]
    assert max(totals) - min(totals) <= 0.01 * sum(totals) / 16 + 50
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in sizes.values())
    first, second = (sharding.load_map(spark, str(tmp_path), v) for v in (1, 2))
    assert first == sharding.even_map() and sum(a != b for a, b in zip(first, second)) < 600
    assert sharding.last_version(spark, str(tmp_path)) == 2
    again = sharding.shard(frame(spark, texts), path=str(tmp_path)).select("doc_id", "shard").collect()
    assert {r.doc_id: r.shard for r in again} == {r.doc_id: r.shard for r in rows} and sharding.last_version(spark, str(tmp_path)) == 2
    more = spark.createDataFrame([(1000 + i, "y" * 3000) for i in range(40)], "doc_id long, text string")
    moved = sharding.shard(frame(spark, texts).unionByName(more), path=str(tmp_path))
    sums = [r["sum(size)"] for r in moved.groupBy("shard").sum("size").collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 3001
    third = sharding.load_map(spark, str(tmp_path), 3)
    assert sharding.last_version(spark, str(tmp_path)) == 3 and 0 < sum(a != b for a, b in zip(second, third)) < 200
    grown = sharding.grow(second, {s: 1 for s in range(4096)}, 16)
    assert all(a == b or b == 16 for a, b in zip(second, grown)) and grown.count(16) in (240, 241)  # a seventeenth


def test_sharding_after_a_run_that_died_and_beside_another(spark, tmp_path):
    docs, path = frame(spark, [prose(RNG.randint(0, 60), i) for i in range(200)]), str(tmp_path)
    assert sharding.claim(spark, path) == 1 and sharding.claim(spark, path) == 2  # two runs at once get two numbers
    (tmp_path / "version=1").mkdir()  # a run that died while it wrote
    first = {r.doc_id: r.shard for r in sharding.shard(docs, path=path).collect()}
    last = sharding.last_version(spark, path)
    assert last == 4  # the even map and the rebalanced one, behind the claimed numbers
    (tmp_path / "version=5").mkdir()
    assert sharding.last_version(spark, path) == last
    assert {r.doc_id: r.shard for r in sharding.shard(docs, path=path).collect()} == first
    assert sharding.last_version(spark, path) == last and sharding.save_map(spark, sharding.load_map(spark, path, last), path) == 6



def test_sharding_of_repeated_and_missing_ids(spark):
    rows = [(7, "a")] * 60 + [(None, f"t{i}") for i in range(300)] + [(None, None)] * 5
    placed = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(placed) == len(rows) and len({r.shard for r in placed if r.doc_id == 7}) == 1
    for k in range(16):
        own = sorted(r.slot for r in placed if r.shard == k)
        assert own == list(range(len(own)))
    assert len({r.shard for r in placed if r.doc_id is None}) > 12


def toxic_tables(spark, folder):
    marks = ["vile", "rotten", "nasty"]
    texts, labels = [], []
    for i in range(600):
        words = prose(60, i).split()
        bad = i % 5 == 0
        if bad:
            for m in random.Random(i).sample(marks, 2):
                words.insert(random.Random(i).randrange(60), m)
        texts.append(" ".join(words))
        if i % 2 == 0 or bad:
            labels.append((i, 1, int(bad)))
    texts += [None, ""]
    frame(spark, texts).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels + [(9999, 1, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [prose(30, 5000), prose(20, 5001)]
    frame(spark, items).withColumnRenamed("doc_id", "item_id").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_toxicity_on_held_out_rows(spark, tmp_path):
    toxic_tables(spark, tmp_path)
    rows = toxicity.query(spark, str(tmp_path)).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == int(r.doc_id % 5 == 0 and r.doc_id < 600) for r in held) >= 0.98 * len(held)


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a", None])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5, 0.5]


def test_toxicity_equals_brute_force(spark, tmp_path):
    """Neighbours and scores of every text against all cosines of dictionaries."""
    texts = toxic_tables(spark, tmp_path) + ["ﬁné ñandú 17", "vile"]
    docs, labels = frame(spark, texts), spark.read.parquet(f"{tmp_path}/labels.parquet")
    for relevance in (True, False):
        model = toxicity.fit(docs, labels, relevance=relevance)
        scale = dict(zip((*model.words, *model.prefixes), model.scale))

        def vector(text, scale=scale, unknown=model.unknown):
            tf, out = {}, {}
            for w in toxicity.LETTERS.findall((text or "").lower()):
                for f in (w, *toxicity.prefixes_of(w)):
                    if f in scale or f == w:
                        tf[f] = tf.get(f, 0) + 1
            out = {f: (1 + np.log(n)) * scale.get(f, unknown) for f, n in tf.items()}
            norm = sum(v * v for v in out.values()) ** 0.5
            return {f: v / norm for f, v in out.items()}

        toxic = {}
        for r in labels.filter("doc_id < 600 AND toxic IS NOT NULL").collect():
            if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
                toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, 0))
        examples = {i: vector(texts[i]) for i in toxic}
        assert len({texts[i] for i in toxic}) == len(toxic)
        here = [sum(t == c for t in toxic.values()) for c in (0, 1)]
        sizes = [here[0], here[1] + (zlib.crc32(b"9999") % 3 != 1)]  # a label without a document
        mean = sum(sizes) / sum(here)
        for r in toxicity.score(docs, model).collect():
            v = vector(texts[r.doc_id])
            cosines = {i: sum(x * v.get(f, 0.0) for f, x in e.items()) for i, e in examples.items()}
            expected = sorted((c for c in cosines.values() if c > 0), reverse=True)[:15]
            assert np.allclose([n.cosine for n in r.neighbours], expected)
            assert all(np.isclose(cosines[n.doc_id], n.cosine) and toxic[n.doc_id] == n.toxic for n in r.neighbours)
            if expected:
                votes = [(sizes[n.toxic] / here[n.toxic] / mean / (1.1 - n.cosine), n.toxic) for n in r.neighbours] + [(1 / 1.1, sizes[1] / sum(sizes))]
                share = sum(w * t for w, t in votes) / sum(w for w, _ in votes)
                assert np.isclose(r.score, 1 / (1 + np.exp(-model.slope * np.log(share / (1 - share)) - model.shift)))
            else:
                assert r.score == model.without


def test_block_max_is_exact():
    rng = np.random.default_rng(4)
    vectors = rng.random((300, 40)) * (rng.random((300, 40)) < np.linspace(0.02, 0.9, 40))  # rare to frequent features
    vectors[:, 0] += 0.01
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    sparse = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in vectors]
    index = toxicity.BlockMaxIndex(sparse, np.arange(300), np.zeros(300, int), np.ones(300), 40)
    assert 0 < index.matrix.shape[0] < 40
    queries = rng.random((50, 40)) * (rng.random((50, 40)) < 0.3)
    queries[0] = 0
    asked = [(np.flatnonzero(q), q[np.flatnonzero(q)] / (np.linalg.norm(q) or 1)) for q in queries]
    for q, (places, cosines) in zip(queries, index.nearest(asked, 15)):
        all_ = np.sort(vectors @ (q / (np.linalg.norm(q) or 1)))[::-1]
        assert np.allclose(cosines, all_[:15][all_[:15] > 0]) and np.allclose(vectors[index.ids[places]] @ q / (np.linalg.norm(q) or 1), cosines)
    for row, (places, _) in enumerate(index.nearest(index.vectors, 5, leave_one_out=True)):
        assert row not in places


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_toxicity", "op5_simhash_near_dedup", "op6_benchmark_decontamination", "op8_sharding", "op10_best_fit_packing", "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    empty = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string"}
    for table, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    query = corpus_pipeline.run if name == "pipeline" else registry.QUERIES[name]
    assert query(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    toxic_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    extra = [(700, prose(60, 1), "en", "s", 1), (701, prose(30, 5000), "en", "s", 1), (702, "mail me@x.example.org " + prose(40, 77), "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    ids, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
    assert not {i for i in ids["toxicity"] if i < 600 and i % 5 == 0} and 700 in ids["toxicity"]
    assert 700 not in ids["near_duplicates"] and 1 in ids["near_duplicates"]
    assert ids["near_duplicates"] - ids["decontamination"] == {701}
    text = spark.read.parquet(f"{tmp_path}/personal_data").filter("doc_id = 702").first().text
    assert text.startswith("mail <EMAIL> ") and ids["packing"] == ids["personal_data"] == ids["decontamination"]


def test_near_copies_by_jaccard(spark):
    """Against all pairs: every link at 0.8 or more, none below, also where many texts share keys."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one two", "One  TWO", "a b c d e"]
    line = " ".join(words[:14])
    for size in (6, 12, 40, 90, 300):
        base = [draw.choice(words) for _ in range(size)]
        for edits in [0, 1, 1, 2, 3, 4, 6, 10] * (6 if size == 90 else 1):
            copy = list(base)
            for _ in range(edits):
                copy[draw.randrange(size)] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += [line + " " + " ".join(draw.choice(words) for _ in range(draw.randrange(2, 60))) for _ in range(60)]
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    expected = {root(i) for i in range(len(texts))}
    docs = frame(spark, texts)
    ids = [r.doc_id for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {ids[i] for i in expected}
    assert len(expected) < len(texts) - 20


def test_near_copies_by_either_kind_of_link(spark, monkeypatch):
    """The pipeline drops op5's near copies too, and a class is what links of both kinds connect."""
    base = prose(400, 31).split()
    far = base[:30] + [f"x{i}" for i in range(6)] + base[36:]
    texts = [" ".join(base), " ".join(far), prose(50, 32)]
    far_prints = {texts[0]: 7, texts[1]: 1 << 40, texts[2]: 5 << 40 | 1}  # the last two differ in two bits
    monkeypatch.setattr(simhash, "fingerprint", lambda t, shingle=3: far_prints[t])
    docs = frame(spark, texts)
    ids = [r.doc_id for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {ids[0]}
    assert {r.doc_id for r in corpus_pipeline.jaccard.keep_one(docs).collect()} == {ids[0], ids[2]}


def test_near_duplicates_leave_texts_where_they_are(spark):
    """Also where Spark would not broadcast the ids by itself: no plan of the stage moves texts."""
    base = prose(400, 31).split()
    far = base[:30] + [f"x{i}" for i in range(6)] + base[36:]
    docs = frame(spark, [" ".join(base), " ".join(far), prose(50, 32)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and kept.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_toxicity_cut_is_the_best_of_all():
    rng = np.random.default_rng(12)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        x, y, w = rng.integers(0, 8, n) / 4.0, rng.integers(0, 2, n), rng.random(n) + 0.1
        if 0 < y.sum() < n:
            def measure(cut):
                found = x >= cut
                return 2 * (w * y)[found].sum() / (w[found].sum() + (w * y).sum())

            cut = toxicity.best_cut(x, y, w)
            assert measure(cut) == pytest.approx(max(measure(c) for c in x))
