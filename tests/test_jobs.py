import json

import pytest
from pyspark.sql import functions as F

from pageloom.operators import articles
from pageloom.operators.joins import on_demand_join, salted_join
from pageloom.plans import crawl
from pageloom.plans.files import run_files
from pageloom.sources.html_files import read_html_files, rescan_modified
from pageloom.sources.sinks import write_articles_json
from pageloom.streaming import watch

TEXT = "<article><h1>Election results</h1><p>" + "The government won the election by a wide margin. " * 4 + "</p></article>"


def link(*targets):
    return "".join(f'<a href="{t}">x</a>' for t in targets) + TEXT


WEB = {
    "http://one.ex/a?src=feed": link("/news/b", "/c", "/c#again", "/a", "/news/missing", "http://two.ex/", "/d"),
    "http://one.ex/a": link(),
    "http://one.ex/news/b#top": link("/deep"),
    "http://one.ex/news/b": link(),
    "http://one.ex/c": link(),
    "http://one.ex/d": "<p>x</p>",
    "http://two.ex/": link("/self-only"),
}


def frontier(spark, pages, seeds, **options):
    rows = crawl.expand_frontier(
        spark.createDataFrame([(s,) for s in seeds], "url string"), pages(WEB), **options).collect()
    return sorted((r.seed_url, r["rank"], r.url, r.page_url, r.depth, r.copies) for r in rows)


A = "http://one.ex/a?src=feed"


def test_frontier(spark, pages):
    got = frontier(spark, pages, [A, "http://two.ex/", "http://gone.ex/"], dedupe=True)
    assert got == [
        (A, 0, A, A, 0, 1),
        # /news/missing is rank 2: it has no page but uses up its place
        (A, 1, "http://one.ex/news/b", "http://one.ex/news/b", 1, 1),
        (A, 3, "http://one.ex/c", "http://one.ex/c", 1, 1),
        (A, 4, "http://one.ex/a", "http://one.ex/a", 1, 1),
        (A, 5, "http://one.ex/d", "http://one.ex/d", 1, 1),
        ("http://two.ex/", 0, "http://two.ex/", "http://two.ex/", 0, 1),
    ]


@pytest.mark.parametrize("budget,ranks", [(0, [0]), (1, [0, 1]), (2, [0, 1]), (4, [0, 1, 3, 4])])
def test_budget_counts_links_per_seed(spark, pages, budget, ranks):
    assert [r[1] for r in frontier(spark, pages, [A], page_budget=budget)] == ranks


def test_links_back_to_the_seed(spark, pages):
    web = {"http://s.ex/": '<a href="/">home</a><a href="/x">x</a>', "http://s.ex/x": ""}
    seeds = spark.createDataFrame([("http://s.ex/",)] * 2, "url string")
    kept = crawl.expand_frontier(seeds, pages(web), dedupe=False).collect()
    assert sorted((r["rank"], r.page_url, r.copies) for r in kept) == [
        (0, "http://s.ex/", 2), (1, "http://s.ex/", 2), (2, "http://s.ex/x", 2)]
    assert crawl.expand_frontier(seeds, pages(web)).count() == 2


def test_crawl_extracts_reached_pages(spark, pages):
    seeds = spark.createDataFrame([(A,), ("http://one.ex/c",)], "url string")
    rows = crawl.run_crawl(seeds, pages(WEB), threshold=0.2).collect()
    got = sorted((r.seed_url, r["rank"], r.url) for r in rows)
    assert got == [
        (A, 0, A), (A, 1, "http://one.ex/news/b"), (A, 3, "http://one.ex/c"), (A, 4, "http://one.ex/a"),
        ("http://one.ex/c", 0, "http://one.ex/c"),
    ]
    assert {r.inferred_category for r in rows} == {"Politics"}


def test_skewed_joins_keep_every_row(spark):
    n = 3000
    left = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("rows")).withColumn("v", F.col("k") * 2)
    want = sorted((r.id, r.k * 2) for r in left.collect())
    for joined in (
        salted_join(left, right, ["k"], ["id"]),
        salted_join(left, right, ["k"], ["id"], heat="rows"),
        salted_join(left, right, ["k"], ["id"], how="left", heat="rows"),
        on_demand_join(left, right, ["k"], ["id"]),
    ):
        assert sorted((r.id, r.v) for r in joined.collect()) == want


def test_hot_keys_are_spread(spark):
    # tiny partitions would be merged again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    left = spark.range(4000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 4000, 1)], "k string, rows bigint, v int")
    joined = salted_join(left, right, ["k"], ["id"], heat="rows")
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and len(sizes) > 1


def test_article_rows_and_text_forms(spark, pages):
    html = '<meta name="author" content="Ann"><title>T</title>' + TEXT
    table = articles.extract_articles(pages({"http://x/1": html, "http://x/2": ""}))
    assert table.columns == articles.ARTICLE_FIELDS
    rows = {r.url: r for r in table.collect()}
    empty = rows["http://x/2"]
    assert (empty.title, empty.author, empty.word_count, empty.relevance_score, empty.top_keywords) == (
        "(no title found)", None, 0, 0.0, [])
    assert rows["http://x/1"].author == "Ann" and rows["http://x/1"].title == "Election results"
    texts = {r.url: json.loads(r.json) for r in articles.articles_as_json(table).collect()}
    assert list(texts["http://x/2"]) == articles.ARTICLE_FIELDS and texts["http://x/2"]["author"] is None
    cards = {r.url: r.card for r in articles.summary_card(table).collect()}
    assert " Author : Ann\n Date   : --\n" in cards["http://x/1"]
    assert "Keywords" not in cards["http://x/2"] and "Relevance : 0.000 | Words: 0" in cards["http://x/2"]


def test_extraction_is_one_stage_and_filters_first(spark, pages):
    table = articles.extract_articles(pages({"http://x/1": TEXT}), threshold=0.05)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1
    # the title is looked for above the filter on the score
    assert plan.index("og:title") < plan.index("Filter")


def test_latest_per_url(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "url string, n int, v string")
    assert sorted(tuple(r) for r in articles.latest_per_url(log, "n").collect()) == [("a", 3, "z"), ("b", 1, None)]


# --- files and streams -----------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.html").write_text(TEXT)
    (tmp_path / "in" / "sub" / "B.HTML").write_text("<title>B</title>" + TEXT)
    (tmp_path / "in" / "skip.htm").write_text(TEXT)
    (tmp_path / "in" / "bad.html").write_bytes(b"<p>\xff\xfe")
    (tmp_path / "in" / "thin.html").write_text("")
    (tmp_path / "in" / "_x.html").write_text(TEXT)
    return tmp_path


def test_file_mode(spark, folder):
    paths = [str(folder / "in" / n) for n in ("a.html", "skip.htm", "bad.html", "missing.html", "thin.html", "_x.html")]
    kept, quarantine = run_files(spark, paths)
    assert sorted(r.url for r in kept.collect()) == [
        f"file://{folder}/in/{name}" for name in ("_x.html", "a.html", "skip.htm")]
    messages = {r.item.rsplit("/", 1)[1]: r.message for r in quarantine.collect()}
    assert messages == {"bad.html": "not valid UTF-8", "missing.html": "file not found"}
    everything, _ = run_files(spark, paths, threshold=0.0)
    assert [r.relevance_score for r in everything.collect() if r.url.endswith("thin.html")] == [0.0]
    pages, errors = read_html_files(spark, [paths[3]])
    assert pages.count() == 0 and errors.count() == 1
    in_folder, _ = run_files(spark, [f"file:{folder}/in"], threshold=0.0)
    assert sorted(r.url.rsplit("/", 1)[1] for r in in_folder.collect()) == ["B.HTML", "a.html", "skip.htm", "thin.html"]


def test_json_sink_overwrites_and_keeps_nulls(spark, pages, tmp_path):
    out = str(tmp_path / "out")
    for web in ({"http://x/1": TEXT}, {"http://x/2": TEXT}):
        write_articles_json(articles.extract_articles(pages(web)).coalesce(1), out)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert [x["url"] for x in lines] == ["http://x/2"]
    assert list(lines[0]) == articles.ARTICLE_FIELDS and lines[0]["author"] is None


def run_watch(spark, folder):
    query, invalid = watch.run_stream(
        spark, [str(folder / "in"), str(folder / "nowhere"), str(folder / "in" / "a.html")],
        str(folder / "out"), str(folder / "checkpoint"), quarantine=str(folder / "bad"))
    query.awaitTermination()
    return invalid


def test_watch_mode_and_restart(spark, folder):
    invalid = run_watch(spark, folder)
    assert [m for _, m in invalid] == ["not found", "not a directory"]
    log = watch.read_log(spark, str(folder / "out"))
    assert sorted(r.url.rsplit("/", 1)[1] for r in log.collect()) == ["B.HTML", "a.html"]
    assert spark.read.json(str(folder / "bad")).count() == 1

    batch, _ = run_files(spark, [str(folder / "in" / "a.html"), str(folder / "in" / "sub" / "B.HTML")])
    assert sorted(map(str, log.drop("batch").collect())) == sorted(map(str, batch.collect()))

    (folder / "in" / "new.html").write_text(TEXT)
    run_watch(spark, folder)
    log = watch.read_log(spark, str(folder / "out"))
    assert sorted(r.url.rsplit("/", 1)[1] for r in log.collect()) == ["B.HTML", "a.html", "new.html"]


def test_folders_may_vanish_and_lie_inside_each_other(spark, folder):
    for name in ("more", "odd {a}"):
        (folder / name).mkdir()
        (folder / name / "m.html").write_text(TEXT)
    out, checkpoint = str(folder / "out"), str(folder / "checkpoint")

    def names(*dirs):
        query, _ = watch.run_stream(spark, [str(folder / d) for d in dirs], out, checkpoint)
        query.awaitTermination()
        return sorted(r.url.rsplit("/", 2)[-2] + "/" + r.url.rsplit("/", 1)[1] for r in watch.read_log(spark, out).collect())

    seen = names("in", "in/sub", "more", "odd {a}")
    assert seen == ["in/a.html", "more/m.html", "odd {a}/m.html", "sub/B.HTML"]
    (folder / "more").rename(folder / "gone")
    (folder / "in" / "n.html").write_text(TEXT)
    assert names("in", "in/sub", "more", "odd {a}") == sorted([*seen, "in/n.html"])


def test_watching_is_stopped(spark, folder):
    query, _ = watch.run_stream(
        spark, [str(folder / "in")], str(folder / "out"), str(folder / "checkpoint"),
        trigger={"processingTime": "1 second"})
    query.processAllAvailable()
    query.stop()
    assert not query.isActive and watch.read_log(spark, str(folder / "out")).count() == 2


def test_rescan_appends_modified_files(spark, folder):
    import os

    out, ledger, dirs = str(folder / "out"), str(folder / "ledger"), [str(folder / "in")]
    query, _ = watch.run_stream(spark, dirs, out, str(folder / "checkpoint"), ledger=ledger)
    query.awaitTermination()
    assert watch.run_rescan(spark, dirs, out, ledger).count() == 0
    (folder / "in" / "a.html").write_text("<title>Second version</title>" + TEXT.replace("Election results", "No"))
    os.utime(folder / "in" / "a.html", (2_000_000_000, 2_000_000_000))
    assert [r.path.rsplit("/", 1)[1] for r in watch.run_rescan(spark, dirs, out, ledger).collect()] == ["a.html"]
    assert watch.run_rescan(spark, dirs, out, ledger).count() == 0
    newest = articles.latest_per_url(watch.read_log(spark, out), "batch").collect()
    assert {r.url.rsplit("/", 1)[1]: r.title for r in newest} == {"a.html": "Second version", "B.HTML": "Election results"}
    assert watch.run_rescan(spark, [str(folder / "nowhere")], out, ledger) is None


def test_no_valid_directory_starts_nothing(spark, tmp_path):
    query, invalid = watch.run_stream(spark, [str(tmp_path / "x")], str(tmp_path / "o"), str(tmp_path / "c"))
    assert query is None and len(invalid) == 1


def test_modified_files_are_found_again(spark, folder):
    import os

    source = [str(folder / "in")]
    ledger = spark.createDataFrame([], "path string, modificationTime timestamp")
    first = rescan_modified(spark, source, ledger)
    assert first.count() == 3  # without the empty file
    ledger = spark.createDataFrame(watch.with_ledger_columns(first).collect())
    assert rescan_modified(spark, source, ledger).count() == 0
    os.utime(folder / "in" / "a.html", (2_000_000_000, 2_000_000_000))
    again = rescan_modified(spark, source, ledger)
    assert [r.path.rsplit("/", 1)[1] for r in again.collect()] == ["a.html"]
    assert rescan_modified(spark, source, ledger, since="2033-01-01T00:00:00").count() == 1
