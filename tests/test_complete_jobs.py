"""Listing, complete watching, restarts, run figures, crawling without moving pages, dictionaries."""

import os
import re

import pytest
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.operators import articles, entities, joins
from pageloom.operators.dom import parse_pages
from pageloom.plans import crawl
from pageloom.plans.files import write_run
from pageloom.sources.folder_stream import FolderReader, stream_folders
from pageloom.sources.html_files import listed_files, read_html_files
from pageloom.streaming.watch import read_figures, read_log, run_stream, stop_after_batch

TEXT = "<title>Some title</title><article><p>" + "election minister parliament vote " * 20 + "</p></article>"


def write(folder, name, content=TEXT):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


# --- listing -----------------------------------------------------------------------


def test_folders_are_listed_level_by_level(spark, tmp_path):
    want = {write(tmp_path, f"a{i}/b{j}/c/{k}.html") for i in range(3) for j in range(4) for k in range(2)}
    want.add(write(tmp_path, "top.txt"))
    hidden = {write(tmp_path, "a0/_h/x.html"), write(tmp_path, "a1/.x.html")}
    (tmp_path / "empty").mkdir()
    got = [(r.path, r.refused) for r in listed_files(spark, [str(tmp_path)]).collect()]
    assert len(got) == len(want) and {p for p, _ in got} == want and {m for _, m in got} == {None}
    assert {r.path for r in listed_files(spark, [str(tmp_path)], hidden=True).collect()} == want | hidden
    named = listed_files(spark, [str(tmp_path / "a1/.x.html"), str(tmp_path / "gone"), str(tmp_path / "empty")]).collect()
    assert sorted((os.path.basename(r.path), r.refused) for r in named) == [(".x.html", None), ("gone", "file not found")]


def test_a_level_of_folders_is_dealt_to_several_tasks(spark, tmp_path):
    for i in range(40):
        write(tmp_path, f"d{i}/x.html", "")
    listed = listed_files(spark, [str(tmp_path)])
    folders = spark.createDataFrame([(f"{tmp_path}/d{i}",) for i in range(40)], "path string")
    tasks = folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").select(
        F.spark_partition_id().alias("p")).distinct().count()
    assert listed.count() == 40 and tasks > 1
    pages, quarantine = read_html_files(spark, [str(tmp_path)])
    assert pages.count() == 40 and quarantine.isEmpty()


# --- watching ------------------------------------------------------------------------


def test_folder_stream_sees_empty_hidden_and_modified_files(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.html"), write(folder, "sub/deep/B.HTML", ""), write(folder, ".c.html"), write(folder, "_d.html", b"\xff")
    write(folder, "no.htm")
    seen = []

    def run():
        seen.clear()
        query = stream_folders(spark, [str(folder)], settle=0).writeStream.foreachBatch(
            lambda df, _: seen.extend((os.path.basename(r.path), r.length, r.content is None) for r in df.collect())
        ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(seen)

    size = len(TEXT)
    assert run() == [(".c.html", size, False), ("B.HTML", 0, False), ("_d.html", 1, False), ("a.html", size, False)]
    assert run() == []
    write(folder, "a.html", "other"), write(folder, "sub/new.html", "x")
    assert run() == [("a.html", 5, False), ("new.html", 1, False)]


def test_files_wait_until_they_have_settled(tmp_path):
    write(tmp_path, "a.html")
    reader = FolderReader({"dirs": str(tmp_path), "settle": "3600"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [b.num_rows for part in parts for b in reader.read(part)] == []
    os.utime(tmp_path / "a.html", (1, 1))
    assert [b.num_rows for part in parts for b in reader.read(part)] == [1]
    assert reader.partitions({"until": 0}, {"until": 1}) and FolderReader({"dirs": str(tmp_path / "gone")}).partitions({"until": 0}, {"until": 1})


def test_watch_stops_restarts_and_counts(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "1.html"), write(folder, "2.html", b"\xff\xfe"), write(folder, "3.html", "")
    jobs = {"source": "folders", "settle": 0, "figures": str(tmp_path / "figures"), "quarantine": str(tmp_path / "bad")}

    def start(**trigger):
        return run_stream(spark, [str(folder)], str(tmp_path / "log"), str(tmp_path / "cp"), 0.05, trigger=trigger or None, **jobs)[0]

    stop_after_batch(start(processingTime="0 seconds"))
    write(folder, "4.html")
    stop_after_batch(start(processingTime="0 seconds"), 2)
    log = read_log(spark, str(tmp_path / "log"))
    assert sorted(os.path.basename(r.url) for r in log.collect()) == ["1.html", "4.html"]
    total = read_figures(spark, str(tmp_path / "figures")).groupBy().sum().first().asDict()
    assert {k[4:-1]: v for k, v in total.items() if "batch" not in k} == {
        "files": 4, "pages_in": 3, "read_errors": 1, "discarded": 1, "kept": 2}
    assert spark.read.json(str(tmp_path / "bad")).count() == 1


def test_run_figures_come_from_the_run(spark, tmp_path):
    paths = [write(tmp_path, "a.html"), write(tmp_path, "b.html", ""), write(tmp_path, "c.html", b"\xff"), str(tmp_path / "gone.html")]
    got = write_run(spark, paths, str(tmp_path / "out"), 0.05)
    assert got == {"files": 4, "pages_in": 2, "read_errors": 2, "discarded": 1, "kept": 1}
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert write_run(spark, spark.createDataFrame([], "path string"), str(tmp_path / "none")) == dict.fromkeys(got, 0)


# --- crawl ---------------------------------------------------------------------------


def test_html_is_not_shuffled_however_many_urls_are_wanted(spark, tmp_path):
    spark.range(500).select(
        F.concat(F.lit("http://h.ex/"), "id").alias("url"), F.concat(F.lit("<h1>"), "id").alias("html")).write.parquet(str(tmp_path / "p"))
    snapshot = spark.read.parquet(str(tmp_path / "p"))
    wanted = snapshot.filter(F.substring("url", -1, 1) == "7").select("url")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = parse_pages(crawl.fetch(snapshot, wanted), ["url"])
        plan = parsed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and not re.search(r"(?<!Broadcast)Exchange", plan.replace("ReusedExchange", ""))
        urls = {r.url for r in parsed.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.url for r in wanted.collect()} <= urls and len(urls) < 100


@pytest.mark.parametrize("bits", [1 << 15, 1 << 29])
def test_a_full_bitmap_lets_rows_pass_but_loses_none(spark, bits):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("k"))
    wanted = rows.filter("k % 2 = 0")
    bitmaps, used = joins.key_bitmaps(wanted, "k", most_bits=bits)
    kept = joins.keep_wanted(rows.unionByName(spark.createDataFrame([(None,)], "k string")), "k", bitmaps, used)
    found = {r.k for r in kept.collect()}
    assert {str(i) for i in range(0, 40_000, 2)} <= found and used <= bits
    if bits > 1 << 20:
        assert len(found) < 20_000 * 1.05
    empty, used = joins.key_bitmaps(wanted.limit(0), "k")
    assert joins.keep_wanted(rows, "k", empty, used).isEmpty()


def test_hot_targets_are_spread_and_others_are_not_copied(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.on_demand_join(left, right, ["k"], ["id"])
        rows = joined.select("id", "k", "v", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.id, r.v) for r in rows) == sorted((r.id, len(r.k)) for r in left.collect())
    assert len({r.p for r in rows if r.k == "hot"}) > 1


# --- dictionaries and recognisers ----------------------------------------------------


def named(table):
    return {r.url: [(e.text, e.kind) for e in r.named_entities] for r in table.collect()}


def test_dictionary_entities_in_articles(spark, pages, monkeypatch):
    body = "<article>" + "New York met Ada Lovelace. In New Jersey, New York, Ada; Lovelace " + "filler words here " * 10 + "</article>"
    table = pages({"http://x/1": body, "http://x/2": "<p>short</p>", "http://x/3": body.replace("Ada", "Bob")})
    entries = spark.createDataFrame(
        [("New York", "location"), ("Lovelace", "person"), ("Ada Lovelace", "person"), ("York", "organization"), ("York", "a thing"),
         ("in", "event"), (None, "event"), ("", "event"), ("a b c d e", "event")], "text string, label string")

    def load():
        return lambda text, labels: [("Ada", labels[0]), ("New York", labels[1])] if "Ada" in text else []

    want = {
        "http://x/1": [("New York", "LOCATION"), ("York", "A_THING"), ("Ada Lovelace", "PERSON"), ("Lovelace", "PERSON")],
        "http://x/2": [], "http://x/3": [("New York", "LOCATION"), ("York", "A_THING"), ("Lovelace", "PERSON")]}
    both = dict(want, **{"http://x/1": [("Ada", "PERSON"), ("New York", vocab.ENTITY_LABELS[1].upper().replace(" ", "_"))]
                         + want["http://x/1"][1:]})
    for limit in (joins.BROADCAST_LIMIT_BYTES, 0):
        monkeypatch.setattr(joins, "BROADCAST_LIMIT_BYTES", limit)
        found = articles.extract_articles(table, dictionary=entries)
        assert found.columns == articles.ARTICLE_FIELDS and named(found) == want
        assert named(articles.extract_articles(table, dictionary=entries, load_recogniser=load)) == both


def test_dictionary_articles_need_no_shuffle(spark, pages):
    entries = spark.createDataFrame([("Ada", "person")], "text string, label string")
    table = articles.extract_articles(pages({"http://x/1": TEXT}), dictionary=entries)
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()


def test_recognisers_take_batches_and_report(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        class Batches:
            def batch(self, texts, labels):
                calls.add(1)
                if any("boom" in t for t in texts):
                    raise RuntimeError("bad")
                return [[(t[:2], labels[0])] for t in texts]

        return Batches()

    def gone():
        raise OSError("no model")

    rows = [(f"text {i}",) for i in range(200)] + [(None,), (vocab.NO_BODY,)]
    df = spark.createDataFrame(rows, "body string").coalesce(1)
    got = entities.detect_entities(df, "body", load, status="s").collect()
    assert [r.s for r in got] == ["ok"] * 200 + ["no text"] * 2 and calls.value == -(-200 // entities.BATCH_TEXTS)
    bad = entities.detect_entities(df.unionByName(spark.createDataFrame([("boom",)], "body string")).coalesce(1), "body", load, status="s")
    assert {r.s: r["count"] for r in bad.groupBy("s").count().collect()} == {"ok": 200, "no text": 2, "failed": 1}
    none = entities.detect_entities(df, "body", gone, status="s")
    assert {r.s: r["count"] for r in none.groupBy("s").count().collect()} == {"not loaded": 200, "no text": 2}
    assert {r.s for r in entities.detect_entities(df, "body", None, status="s").collect()} == {"not loaded"}


# --- newest rows and repeated prefixes -----------------------------------------------


def test_the_newest_row_is_found_without_sorting_aggregates(spark):
    log = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("url"),
        (F.col("id") * 7919 % 3001).alias("seq"), F.col("id").cast("string").alias("v"))
    newest = articles.latest_per_url(log, "seq")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") >= 1 and newest.columns == log.columns
    want = {}
    for r in log.collect():
        want[r.url] = max(want.get(r.url, (-1, "")), (r.seq, r.v))
    assert {r.url: (r.seq, r.v) for r in newest.collect()} == want


def test_a_prefix_listed_twice_can_count_twice(spark):
    from pageloom.functions import words
    from pageloom.operators import scoring

    prefixes = ["vot", "vot", "elect", "e", "vot", "elect"]
    counts = spark.createDataFrame([(1, "voter", 2), (1, "election", 3), (1, "east", 1), (2, "none", 5)], "id int, term string, tf bigint")
    vocabulary = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    want = {1: 2 * 3 + 3 * 3 + 1, 2: 0}
    assert {r.id: r.topic_hits for r in scoring.topic_hits_from_table(counts, ["id"], vocabulary, repeats=True).collect()} == want
    summed = counts.groupBy("id").agg(F.sum(F.col("tf") * words.prefix_matches(F.col("term"), prefixes, repeats=True)).alias("n"))
    assert {r.id: r.n for r in summed.collect()} == want
