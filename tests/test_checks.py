"""Rules over drafts, media, grounding, evidence."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from storyline.operators import checks


def results(spark, **inputs):
    df = spark.range(1).selectExpr(*(f"{v} AS {k}" for k, v in ({"body": "'text'"} | inputs).items()))
    row = checks.checked(df).first()
    return {r.key: (r.status, r.blocks) for r in row.results}, row.passed, row.blocks


def test_rules_are_many_and_one_pass(spark, tmp_path):
    assert len(checks.RULES) >= 20 and len({r.key for r in checks.RULES}) == len(checks.RULES)
    spark.range(5).selectExpr("'text' AS body", "'telegram' AS platform").write.parquet(str(tmp_path / "d"))
    plan = checks.checked(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan


def test_a_clean_draft_passes(spark):
    found, passed, blocks = results(spark, body="'All is well.'", platform="'telegram'", language="'en'")
    assert passed and not blocks and {s for s, _ in found.values()} == {"pass"}


@pytest.mark.parametrize(
    "inputs, key, wanted",
    [
        ({"body": "'  '"}, "not_empty", ("fail", True)),
        ({"body": "repeat('x', 4097)", "platform": "'telegram'"}, "length", ("fail", True)),
        ({"body": "repeat('x', 4097)"}, "length", ("pass", False)),
        ({"platform": "'instagram'", "hashtags": "31"}, "hashtags", ("fail", True)),
        ({"platform": "'instagram'", "hashtags": "9"}, "hashtags", ("warn", False)),
        ({"platform": "'facebook'", "hashtags": "6"}, "hashtags", ("warn", False)),
        ({"copy_run": "10"}, "originality", ("fail", True)),
        ({"copy_run": "8"}, "originality", ("warn", True)),
        ({"copy_run": "2", "copy_ratio": "0.13"}, "originality", ("fail", True)),
        ({"agitation": "1", "political": "true"}, "politics", ("fail", True)),
        ({"political": "true"}, "politics", ("warn", True)),
        ({"disclosed": "false"}, "disclosure", ("fail", True)),
        ({"disclosure_on": "false", "disclosed": "false"}, "disclosure", ("warn", True)),
        ({"verification": "'rejected'"}, "verification", ("fail", True)),
        ({"verification": "'needs_check'"}, "verification", ("warn", True)),
        ({"body": "repeat('word ', 20)", "language": "'en'", "text_language": "'ru'"}, "language", ("warn", True)),
        ({"platform": "'telegram'", "bad_tags": "1"}, "html", ("fail", True)),
        ({"missing_numbers": "CAST(NULL AS INT)"}, "numbers", ("pass", False)),
    ],
)
def test_rules(spark, inputs, key, wanted):
    found, passed, _ = results(spark, **inputs)
    assert found[key] == wanted
    assert passed == (wanted[0] != "fail")


def test_rules_that_do_not_apply_give_no_result(spark):
    found, _, _ = results(spark, body="'x'", platform="'facebook'")
    assert not {"not_empty", "html", "originality", "verification", "repeat"} & set(found)


def test_media(spark):
    columns = "draft int, platform string, format string, rights string, attribution string, ai boolean, ai_label boolean, kind string, mime string, width int, height int, bytes long"
    good = ("own", None, False, False, "image", "image/jpeg", 1000, 1000, 10)
    rows = [(1, "instagram", "photo", *good), (2, "instagram", "photo", "unknown", None, True, False, "card", "image/png", 300, 100, 9 << 20), (3, "facebook", "photo", "licensed", "", False, None, "image", "image/png", 10, 0, None)]
    rows += [(4, "instagram", "carousel", *good)] * 11
    found = {r.draft: (r.media_problems, r.media_warnings) for r in checks.media_findings(spark.createDataFrame(rows, columns)).collect()}
    assert found == {1: (0, 0), 2: (5, 0), 3: (0, 1), 4: (1, 0)}


def test_numbers_are_grounded_to_a_hundredth(spark):
    rng = random.Random(4)
    numbers = [(i, rng.choice("ab"), i, rng.choice([0.0, 1.0, rng.uniform(0.5, 3), -rng.uniform(1, 3), 10.0 ** rng.randint(-12, 12)]), rng.choice(["", "", "kg", "m"])) for i in range(300)]
    df = spark.createDataFrame(numbers, "draft long, group string, place long, v double, unit string")
    found = {r.draft: (r.n, r.missing) for r in checks.ungrounded_numbers(df, df.drop("draft")).collect()}
    for draft, group, place, v, unit in numbers:
        ok = any(g == group and p < place and abs(v - kv) <= max(1e-9, 0.01 * abs(kv)) and (unit == ku or not unit or not ku) for _, g, p, kv, ku in numbers)
        assert found[draft] == (1, 0 if ok else 1)


def test_quotations_hold_each_other_either_way(spark):
    known = [("a", 1, "He said: we will never, ever give up on this!"), ("a", 9, "later words that come too late here"), ("b", 1, "one two three four")]
    asked = [(1, "a", 5, "we will never ever give"), (2, "a", 5, "And so he said we will never ever give up on this at all"), (3, "a", 5, "we will always give up on"), (4, "a", 5, "later words that come too late"), (5, "a", 5, "too short quote"), (6, "a", 5, "one two three four")]
    drafts = spark.createDataFrame(asked, "draft int, group string, place int, quote string")
    found = {r.draft: (r.n, r.missing) for r in checks.ungrounded_quotes(drafts, spark.createDataFrame(known, "group string, place int, quote string")).collect()}
    assert found == {1: (1, 0), 2: (1, 0), 3: (1, 1), 4: (1, 1), 6: (1, 1)}


def test_addresses(spark):
    drafts = spark.createDataFrame([(1, "g", "https://a.b/c."), (1, "g", "https://x.y"), (2, "h", "https://a.b/c")], "draft int, group string, url string")
    sources = spark.createDataFrame([("g", "https://a.b/c")], "group string, url string")
    assert {r.draft: (r.n, r.missing) for r in checks.ungrounded_urls(drafts, sources).collect()} == {1: (2, 1), 2: (1, 1)}


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.choice(["t", "kg"]), round(rng.choice([5.0, 5.0, 5.0, -5.0]) * rng.choice([1.0, 1.005, 1.01, 1.03]), 4), rng.choice("xyz")) for _ in range(200)]
    found = {tuple(r) for r in checks.number_conflicts(spark.createDataFrame(rows, "event int, unit string, v double, origin string")).collect()}
    plain = set()
    for (e1, u1, a, o1), (e2, u2, b, o2) in itertools.combinations(rows, 2):
        if (e1, u1) == (e2, u2) and o1 != o2 and abs(a - b) / max(abs(a), abs(b), 1e-9) > 0.02:
            plain.add((e1, u1))
    assert found == plain and plain and len(plain) < len({r[:2] for r in rows})


def test_support_is_containment(spark):
    facts = spark.createDataFrame([(1, "f", ["1", "2"]), (1, "g", []), (1, "h", ["9"]), (2, "f", ["1"])], "event int, fact string, values array<string>")
    numbers = spark.createDataFrame([(1, "x", "1"), (1, "x", "2"), (1, "y", "1"), (1, "z", "2"), (1, "z", "1"), (1, "z", "1")], "event int, origin string, value string")
    found = {(r.event, r.fact): r.support for r in checks.supported_facts(facts, numbers).collect()}
    assert found == {(1, "f"): 2, (1, "g"): 1, (1, "h"): 1, (2, "f"): 1}


def test_decision(spark):
    columns = "event int, n_independent int, official boolean, cited_official int, single_reliability double, avg_reliability double, hedge double, conflicts int, n_quotes int, shared_quotes int, n_facts int"
    rows = [(1, 1, False, 0, 0.5, 0.5, 0.0, 1, 0, 0, 1), (2, 3, False, 0, None, 0.7, 0.0, 0, 0, 0, 1), (3, 1, True, 0, 0.5, 0.5, 0.2, 0, 1, 0, 1), (4, 1, False, 2, 0.95, 0.95, 0.0, 0, 0, 0, 1), (5, 2, False, 0, None, 0.9, 0.5, 0, 0, 0, 1), (6, 1, False, 0, 0.5, 0.5, 0.7, 0, 0, 0, 1)]
    found = {r.event: (r.status, r.primary, r.score) for r in checks.verified(spark.createDataFrame(rows, columns)).collect()}
    assert [found[k][0] for k in range(1, 7)] == ["rejected", "multi_confirmed", "confirmed", "confirmed", "needs_check", "rejected"]
    assert found[2][2] == pytest.approx(0.35 + 0.15 + 0.1 + 0.07 + 0.05) and found[4][1] == "cited_official"
    assert found[1][2] == pytest.approx(0.4 * (0.35 / 3 + 0.1 + 0.05 + 0.05), abs=1e-6)


def test_copies_in_one_scan_equal_runs_and_shares(spark):
    """What version_checks asks of copies, against the operators that it took one scan of the texts each for."""
    from storyline.functions import text
    from storyline.operators import similarity

    rng = random.Random(6)
    pool = [f"w{i}" for i in range(6)]
    texts = [(i, [rng.choice(pool) for _ in range(rng.randrange(0, 30))]) for i in range(60)] + [(60, ["x"] * 9), (61, [])]
    sources = [(i, [rng.choice(pool) for _ in range(rng.randrange(0, 40))]) for i in range(8)] + [(8, [])]
    d, b = spark.createDataFrame(texts, "doc_id long, w array<string>"), spark.createDataFrame(sources, "item_id long, w array<string>")
    grams, words = text.ngrams(F.col("w"), 5).alias("grams"), F.transform("w", lambda w: F.xxhash64(w)).alias("words")
    d5, b5 = d.select("doc_id", grams), b.select("item_id", grams)
    runs = {r.doc_id: r.run for r in similarity.common_runs(d5, b5, 5).groupBy("doc_id").agg(F.max("run").alias("run")).collect()}
    shares = {r.doc_id: r.share for r in similarity.copied_share(d5, b5).groupBy("doc_id").agg(F.max("copied").alias("share")).collect()}
    known = {k: (runs[k], shares[k]) for k in runs}
    for most in (similarity.MOST_GRAMS, 0):  # with more grams than are sent to the tasks the result is the same
        similarity.MOST_GRAMS, before = most, similarity.MOST_GRAMS
        try:
            found = {r.doc_id: (r.copy_run, r.copy_ratio) for r in similarity.copies(d.select("doc_id", words), b.select("item_id", words), 5).collect()}
        finally:
            similarity.MOST_GRAMS = before
        assert found == known and len(known) > 5


def test_secrets_are_where_redaction_changes_a_text(spark):
    from storyline.functions import text

    texts = ["", None, "token=abc", "TOKEN=[redacted]", "x token=[redacted] sk-abcdefghijklmnop1", 'a "Api_Key" : "v"', "Bearer abcdefghijklmnop", "my key = 5", "passwd=1", "see token: none", "EA" + "b" * 40, "/BOT123456:" + "a" * 30, "abc_" + "d" * 20, "fb_exchange_token=q"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(text.has_secrets(F.col("text")).alias("x"), (text.redact(F.col("text")) != F.coalesce("text", F.lit(""))).alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows] and 5 < sum(r.x for r in rows) < len(texts)
