import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.catalog import QUERIES
from pageloom.functions import words
from pageloom.operators import scoring, text


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_default_lists_have_the_expected_sizes():
    assert len(vocab.STOP_WORDS) == len(set(vocab.STOP_WORDS)) == 129
    assert len(vocab.TOPIC_TERMS) == 62
    assert len(vocab.ARTICLE_SIGNALS) == 19
    assert len(vocab.NOISE_SIGNALS) == 18
    assert [len(s) for _, s in vocab.CATEGORY_RULES] == [7, 9, 7, 5, 6]
    terms = vocab.TOPIC_TERMS
    assert not any(a != b and b.startswith(a) for a in terms for b in terms)


def test_lemmatise(spark):
    cases = {
        "running": "runn", "string": "string", "wanted": "want", "speed": "speed",
        "policies": "policy", "flies": "flie", "glass": "glass", "cats": "cats", "books": "book",
        "éing": "éing", "ééing": "éé", "ééed": "éé", "éées": "éée",
    }
    got = values(spark, words.lemmatise(F.col("x")), [(w,) for w in cases])
    assert dict(zip(cases, got)) == cases


def test_tokens_split_on_everything_not_alphanumeric(spark):
    line = "Don't réeaution_x İstanbul ½ Ⅷ 中 the-Running"
    got = values(spark, words.tokens(F.col("x")), [(line,), ("",), (None,)])
    assert got[0] == ["don", "réeaution", "ⅷ", "中", "runn"]
    assert got[1] == [] and got[2] == []


def test_stop_words_go_before_endings_are_cut(spark):
    assert values(spark, words.tokens(F.col("x")), [("others other doing doings",)]) == [["other", "doing"]]


def test_term_counts_match_brute_force(spark):
    rng = random.Random(7)
    texts = [
        " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünder", "x1y"]) for _ in range(n))
        for n in (0, 1, 2, 3, 50, 400)
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {(r.id, r.term): r.tf for r in text.term_freq(df, ["id"], "text", unique_keys=True).collect()}
    want = {
        (i, term): n for i, t in rows
        for term, n in Counter(w.lower() for w in re.split(r"\W+", t) if w).items()
    }
    assert got == want
    shuffled = {(r.id, r.term): r.tf for r in text.term_freq(df, ["id"], "text").collect()}
    assert shuffled == want


def test_rows_that_share_a_key_are_added(spark):
    df = spark.createDataFrame([(1, "apple pear"), (1, "apple"), (2, "pear")], "k int, t string")
    got = {(r.k, r.term, r.tf) for r in text.term_freq(df, ["k"], "t").collect()}
    assert got == {(1, "apple", 2), (1, "pear", 1), (2, "pear", 1)}


def test_prefix_matches_count_each_prefix_once(spark):
    prefixes = ["a", "ab", "abc", "xyz", "a"]
    got = values(spark, words.prefix_matches(F.col("x"), prefixes), [("abcd",), ("ab",), ("xy",), ("b",), ("",)])
    assert got == [3, 2, 0, 0, 0]
    assert values(spark, words.prefix_matches(F.col("x"), []), [("abc",)]) == [0]


@pytest.mark.parametrize("n,unique,hits,score", [
    (0, 0, 0, 0.0), (300, 150, 0, 0.325), (300, 300, 300, 1.0), (75, 75, 15, 0.395),
    (600, 600, 9000, 1.0),
])
def test_relevance(spark, n, unique, hits, score):
    row = values(
        spark, words.relevance(F.col("n"), F.col("u"), F.col("h")), [(n, unique, hits)],
        "n bigint, u bigint, h bigint",
    )
    assert math.isclose(row[0], score, abs_tol=1e-12)


def test_shares_of_nothing_are_null(spark):
    assert values(spark, words.share(F.col("a"), F.col("b")), [(0, 0)], "a bigint, b bigint") == [None]


def test_category_takes_the_first_rule_and_matches_anywhere(spark):
    cases = [
        (["electric", "market"], "Politics"), (["selection"], "Politics"),
        (["market", "virus"], "Business"), (["technology"], "Health & Science"),
        (["healthy"], "Environment"), (["football"], "Sports"), ([], "General News"),
        (["quiet"], "General News"),
    ]
    got = values(spark, words.infer_category(F.col("x")), [(k,) for k, _ in cases], "x array<string>")
    assert got == [label for _, label in cases]


def test_own_rules_and_stop_words(spark):
    rules = [("Fruit", ["pear"]), ("Other", ["a"])]
    df = spark.createDataFrame([(1, "pears and plums")], "id int, t string")
    row = scoring.score_texts(df, ["id"], "t", ["plum"], ["and"], rules=rules).first()
    assert (row.n_tokens, row.topic_hits, row.inferred_category) == (2, 1, "Fruit")


def test_top_keywords_break_ties_by_term(spark):
    df = spark.createDataFrame([(1, "bb bbb bbb aaa ccc aaa zzz")], "id int, t string")
    narrow = scoring.score_texts(df, ["id"], "t", k=3).first().top_keywords
    wide = scoring.score_groups(df, ["id"], "t", k=3).first().top_keywords
    assert narrow == wide == ["aaa", "bbb", "ccc"]


def test_groups_without_tokens_keep_a_row(spark):
    df = spark.createDataFrame([(1, "the"), (1, None), (2, "market market")], "k int, t string")
    rows = {r.k: r for r in scoring.score_groups(df, ["k"], "t").collect()}
    assert rows[1].n_tokens == 0 and rows[1].relevance_score == 0.0 and rows[1].top_keywords == []
    assert rows[1].inferred_category == "General News"
    assert rows[2].topic_hits == 2 and rows[2].inferred_category == "Business"


def test_scores_stay_in_range_and_sum_up(spark):
    rng = random.Random(3)
    pool = vocab.TOPIC_TERMS + ["word%d" % i for i in range(50)]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 700)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, t string")
    scored = scoring.score_texts(df, ["id"], "t").collect()
    assert len(scored) == 40
    assert all(0.0 <= r.relevance_score <= 1.0 and len(r.top_keywords) <= 12 for r in scored)
    sums = {r.id: r.s for r in text.term_freq(df, ["id"], "t").groupBy("id").agg(F.sum("tf").alias("s")).collect()}
    assert all(sums.get(r.id, 0) == r.n_tokens for r in scored)


def test_topic_hits_from_a_table_equal_the_literal_list(spark):
    rows = [(1, "market marketing mark stock"), (2, "nothing here"), (3, "mark mark")]
    df = spark.createDataFrame(rows, "id int, t string")
    counts = text.term_freq(df, ["id"], "t", unique_keys=True)
    vocabulary = spark.createDataFrame([("mark",), ("market",), ("sto",), ("mark",)], "prefix string")
    got = {r.id: r.topic_hits for r in scoring.topic_hits_from_table(counts, ["id"], vocabulary).collect()}
    want = {r.id: r.topic_hits for r in text.term_totals(counts, ["id"], ["mark", "market", "sto"]).collect()}
    assert got == want == {1: 6, 2: 0, 3: 2}


def test_tf_idf(spark):
    rows = [(1, "apple apple pear"), (2, "apple")]
    df = spark.createDataFrame(rows, "id int, t string")
    counts = text.term_freq_with_total(df, ["id"], "t")
    got = {(r.id, r.term): r.weight for r in scoring.tf_idf(counts, ["id"], F.lit(2)).collect()}
    assert math.isclose(got[1, "apple"], 2 / 3)
    assert math.isclose(got[1, "pear"], (math.log(3 / 2) + 1) / 3)


def test_threshold_keeps_equal_scores(spark):
    df = spark.createDataFrame([(0.05,), (0.0499,), (0.9,)], "relevance_score double")
    assert scoring.keep_relevant(df).count() == 2
    row = scoring.run_metrics(df, spark.range(3)).first()
    assert (row.pages_in, row.discarded, row.kept, row.read_errors) == (3, 1, 2, 3)


def test_tf_idf_of_frequent_and_rare_terms(spark, monkeypatch):
    rows = [(i, f"alpha alpha {'beta' if i % 2 else 'gamma'} rare{i}") for i in range(20)] + [(None, "alpha beta"), (30, None)]
    docs = spark.createDataFrame(rows, "id int, t string")
    counts = text.term_freq_with_total(docs, ["id"], "t")

    def run():
        return sorted(map(tuple, scoring.tf_idf(counts, ["id"], F.lit(22)).collect()), key=repr)

    want = run()
    assert len(want) == 62 and {(r[1], r[3]) for r in want} >= {("alpha", 21), ("beta", 11), ("rare7", 1)}
    for share in (1, 10, 50):  # none, some and most terms count as frequent
        monkeypatch.setattr(scoring, "FREQUENT_TERMS", share)
        assert run() == want


def test_tf_idf_query_splits_texts_once(spark, monkeypatch):
    calls, tokens = [], words.tokens
    monkeypatch.setattr(words, "tokens", lambda *args: calls.append(args) or tokens(*args))
    QUERIES["tf_idf_documents"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
