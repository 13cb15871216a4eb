"""Registered queries: names, columns and plans that matter at scale, on the smallest driver tables."""

import os

import pytest

from storyline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_sql_belongs_to_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", ["trend_board", "session_timeout", "baseline_trailing_median", "url_canonical", "copy_ratio_5gram", "version_history"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_read_what_they_need(spark):
    shown = plan(registry.QUERIES["status_counts_mapped"](spark, SF))
    assert "ReadSchema: struct<o_orderstatus:string>" in shown
    pushed = plan(registry.QUERIES["set_union_keys"](spark, SF))
    assert "GreaterThan(value,80.0)" in pushed


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(registry.QUERIES["dense_cosine_topk"](spark, SF))


def test_running_twice_gives_the_same(spark):
    rows = [sorted(map(tuple, registry.QUERIES["posterior_affinity"](spark, SF).collect())) for _ in range(2)]
    assert rows[0] == rows[1]


def test_near_titles_reads_the_whole_text(spark, tmp_path):
    whole = "Der Hund und die Katze sind nicht in dem Haus. " + "The market and the government have said that this is the last of the reports. " * 4 + "Zeppelin"
    spark.createDataFrame([(1, whole)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = registry.QUERIES["near_titles"](spark, str(tmp_path)).first()
    assert row.lang == "en" and row.stems[-1].startswith("zeppel") and len(row.skeletons) > 60


def test_near_titles_word_by_word_equal_the_expressions(spark, tmp_path, monkeypatch):
    """Every character that Python cuts, and some that it leaves to Spark; words known from texts before and forgotten."""
    import random

    from pyspark.sql import functions as F

    from storyline.functions import text, words

    rng = random.Random(3)
    some = "running walked boxes really cats ass\u0451 \u041f\u0440\u0438\u0432\u0435\u0442\u0430\u043c\u0438 \u0431\u044b\u043b\u0430 \u049b\u0430\u0437\u0430\u049b\u0441\u0442\u0430\u043d\u043d\u044b\u04a3 \u0431\u043e\u043b\u0430\u0434\u044b the of 7 12 3.5 1,234,5 x o'neil re-used a_b bookkeeper massess \u00e9t\u00e9s \u0429\u0443\u043a\u0438".split()
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}2 X{chr(c)}ing{chr(c)}{chr(c)} \u0436{chr(c)}\u0437\u0430\u043c\u0438" for c in words.SAFE + sorted(words.EXCEPT) + [0x3A3, 0x3C2, 0x4E2D, 0x1F600, 0x660, 0x301, 0xFFFD]]
    texts += [rng.choice(" \u2014\n\u00a0").join(rng.choices(some[:k], k=rng.randrange(40))) for k in (3, 9, 12, len(some)) for _ in range(60)] + ["", None, "\u049b\u049b\u049b \u04d9\u04d9\u04d9 \u043a\u0456\u0442\u0430\u043f\u0442\u0430\u0440\u044b\u043c\u044b\u0437"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = F.col("text")
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", text.detect_language(t).alias("lang"), text.tokenize(t).alias("stems"), F.transform(text.word_tokens(t), text.skeleton).alias("skeletons"))
    wanted = {r.doc_id: tuple(r) for r in plain.collect()}
    for most in (200_000, 5):
        monkeypatch.setattr(words, "MOST_WORDS", most)
        monkeypatch.setattr(words, "AT_ONCE", 50)
        found = registry.QUERIES["near_titles"](spark, str(tmp_path))
        assert "MapInArrow" in plan(found)
        got = {r.doc_id: tuple(r) for r in found.collect()}
        assert [got[k] for k in wanted if got[k] != wanted[k]] == []
    assert {v[1] for v in wanted.values()} == {"en", "ru", "kk", "unknown"}


def test_prior_members_by_slices_equal_all_pairs_without_sliding_windows(spark):
    import random

    from storyline.operators import events

    rng = random.Random(4)
    rows = [(i, rng.randrange(3), rng.randrange(-50, 300), rng.choice([None, float(rng.randrange(20))])) for i in range(300)]
    found = events.prior_best(spark.createDataFrame(rows, "id long, story int, sec long, value double"), 40)
    assert "-40" not in plan(found)  # no frame of the horizon's width, which reads it anew for each row
    for r in found.collect():
        before = [v for _, s, t, v in rows if s == r.story and r.sec - 40 <= t < r.sec]
        assert (r.n_prior, r.best_prior) == (len(before), max((v for v in before if v is not None), default=None))


def test_stop_words_are_looked_up_not_searched(spark):
    from pyspark.sql import functions as F

    from storyline.functions import text

    d = spark.createDataFrame([("The ministers of и Москва said 7 x times",)], "t string").select(text.tokenize(F.col("t"), stemming=False).alias("w"))
    assert "array_contains" not in plan(d).lower() and d.first().w == ["ministers", "москва", "7", "times"]


def test_nearest_vectors_by_products_keep_the_order_of_equal_ones(spark, tmp_path):
    import random

    rng = random.Random(6)
    some = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(7)]
    rows = [(i, some[i % 7]) for i in range(250)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = registry.QUERIES["dense_cosine_topk"](spark, str(tmp_path))
    assert "NestedLoop" not in plan(found)
    near = {q: sorted(r.vec_id for r in found.collect() if r.q == q) for q in (0, 100, 200)}
    assert near == {q: [i for i in range(q % 7, 250, 7) if i != q][:5] for q in near}
