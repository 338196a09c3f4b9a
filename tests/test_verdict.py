"""Findings that no oracle row looks at."""

from pyspark.sql import functions as F

from pageloom.operators import entities, joins, scoring, text
from pageloom.operators.articles import latest_per_url
from pageloom.operators.joins import salted_join
from pageloom.sources.html_files import file_url


def test_latest_row_with_null_and_equal_order(spark):
    rows = [("a", None, 1), ("a", None, 2), ("b", 1, 3), ("b", None, 4), ("c", 5, 6), ("c", 5, 7)]
    df = spark.createDataFrame(rows, "url string, at int, n int")
    first = {r.url: r.n for r in latest_per_url(df, "at").collect()}
    again = {r.url: r.n for r in latest_per_url(df.repartition(3), "at").collect()}
    assert set(first) == {"a", "b", "c"} and first["b"] == 3 and first == again


def test_schemes_of_files(spark):
    cases = {"file:/a/b.html": "file:///a/b.html", "file:///a/b.html": "file:///a/b.html", "/a/b.html": "file:///a/b.html",
             "s3://k/b.html": "s3://k/b.html", "hdfs://nn/x.html": "hdfs://nn/x.html"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.u for r in df.select("p", file_url(F.col("p")).alias("u")).collect()} == cases


def test_long_hot_keys_are_spread(spark):
    hot = "k" * 2_000
    left = spark.range(4_000).select(F.when(F.col("id") % 10 < 9, hot).otherwise(F.col("id").cast("string")).alias("key"), "id")
    right = left.groupBy("key").agg(F.count("*").alias("heat"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put small partitions together
    try:
        joined = salted_join(left, right, ["key"], spread_by=["id"], heat="heat")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4_000 and max(sizes) < 2_500


def test_hot_keys_get_salts_by_their_share(spark):
    left = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key"), "id")
    right = left.groupBy("key").agg(F.count("*").alias("heat"))
    joined = salted_join(left, right, ["key"], spread_by=["id"], heat="heat", parts=30)
    assert joined.count() == 6_000 and joined.select("id").distinct().count() == 6_000
    empty = salted_join(left.limit(0), right.limit(0), ["key"], spread_by=["id"], heat="heat")
    assert empty.count() == 0


def test_keys_without_terms_and_null_keys_keep_their_figures(spark):
    rows = [("a", "market stock"), (None, "market market mark"), ("b", ""), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, t string")
    scored = {r.k: r for r in scoring.score_groups(df, ["k"], "t", ["mark"]).collect()}
    assert {k: (r.n_tokens, r.topic_hits, list(r.top_keywords)) for k, r in scored.items()} == {
        "a": (2, 1, ["market", "stock"]), None: (3, 3, ["market", "mark"]), "b": (0, 0, []), "c": (0, 0, [])}
    counts = text.term_freq(df, ["k"], "t")
    prefixes = spark.createDataFrame([("mark",), ("m" * 50,)], "prefix string")
    hits = scoring.topic_hits_from_table(counts, ["k"], prefixes, every=df)
    assert {r.k: r.topic_hits for r in hits.collect()} == {"a": 1, None: 3, "b": 0, "c": 0}
    entries = spark.createDataFrame([("stock", "event")], "text string, label string")
    listed = entities.collect_entities(entities.dictionary_spans(df, ["k"], "t", entries), ["k"], every=df)
    assert {r.k: [e.text for e in r.named_entities] for r in listed.collect()} == {"a": ["stock"], None: [], "b": [], "c": []}


def test_recogniser_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load_and_note():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda text, labels: [(text, labels[0])]

    df = spark.range(64).select(F.col("id").cast("string").alias("body")).repartition(32)
    found = entities.detect_entities(df, "body", load_and_note)
    assert found.filter("named_entities[0].text = body").count() == 64
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers))


def test_recogniser_that_cannot_be_loaded_finds_nothing(spark):
    def fail():
        raise OSError("no model")

    df = spark.createDataFrame([("Ada",)], "body string")
    assert [r.named_entities for r in entities.detect_entities(df, "body", fail).collect()] == [[]]


def test_lookup_beyond_a_broadcast(spark, monkeypatch):
    left = spark.range(600).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) AS key")
    right = spark.createDataFrame([("hot", 1), ("7", 2), ("none", 3), (None, 4)], "key string, value int")

    def run():
        return sorted(map(tuple, joins.lookup_join(left, right, ["key"], ["id"]).select("id", "value").collect()))

    want = run()
    assert sum(value == 1 for _, value in want) == 200
    monkeypatch.setattr(joins, "BROADCAST_LIMIT_BYTES", -1)
    assert run() == want
