from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions.entities import entity_list
from pageloom.operators import entities

SPANS = "spans array<struct<text:string,label:string>>"


def test_first_label_per_text_and_kinds(spark):
    spans = [("Acme", "organization"), ("Acme", "person"), ("law 12", "law or regulation")]
    df = spark.createDataFrame([(spans,), (None,), ([],)], SPANS).coalesce(1)
    rows = [[(e.text, e.kind) for e in r[0]] for r in df.select(entity_list(F.col("spans"))).collect()]
    assert rows == [[("Acme", "ORGANIZATION"), ("law 12", "LAW_OR_REGULATION")], [], []]


def test_cap_counts_distinct_texts_in_span_order(spark):
    spans = [(f"n{i % 20}", "person") for i in range(19, -1, -1)] * 2
    df = spark.createDataFrame([(spans,)], SPANS)
    got = [e.text for e in df.select(entity_list(F.col("spans"))).first()[0]]
    assert got == [f"n{i}" for i in range(19, 4, -1)]


def test_detection(spark):
    def load_test_recogniser():
        def recognise(text, labels):
            if "boom" in text:
                raise RuntimeError("bad page")
            return [(word, labels[0]) for word in text.split() if word[0].isupper()]

        return recognise

    rows = [("Ada met Bob", ), ("boom Ada",), (None,), (vocab.NO_BODY,), ("Ada Ada",)]
    df = spark.createDataFrame(rows, "body string").coalesce(1)
    got = entities.detect_entities(df, "body", load_test_recogniser).collect()
    assert [[(e.text, e.kind) for e in r.named_entities] for r in got] == [
        [("Ada", "PERSON"), ("Bob", "PERSON")], [], [], [], [("Ada", "PERSON")]]
    none = entities.detect_entities(df, "body", None)
    assert [r.named_entities for r in none.collect()] == [[]] * 5


def test_dictionary_spans(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "New York is new. Ada Lovelace in New York"), (2, ""), (3, "York")], "id int, t string")
    entries = spark.createDataFrame(
        [("New York", "location"), ("York", "organization"), ("Ada Lovelace", "person"), ("ada", "person")],
        "text string, label string")

    def run():
        spans = entities.dictionary_spans(docs, ["id"], "t", entries)
        listed = entities.collect_entities(spans, ["id"])
        return {r.id: [(e.text, e.kind) for e in r.named_entities] for r in listed.collect()}

    want = {
        1: [("New York", "LOCATION"), ("York", "ORGANIZATION"), ("Ada Lovelace", "PERSON")],
        3: [("York", "ORGANIZATION")],
    }
    assert run() == want
    monkeypatch.setattr("pageloom.operators.joins.BROADCAST_LIMIT_BYTES", 0)
    assert run() == want


def test_dictionaries_beyond_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"common name w{i} pair{i % 7} tail") for i in range(200)] + [(200, None), (201, ""), (None, "common name")],
        "id int, t string")
    entries = spark.createDataFrame(
        [("common name", "person"), ("pair3 tail", "event"), ("w5", "law"), ("absent", "law"), (None, "law")], "text string, label string")

    def run(dictionary):
        return sorted(map(tuple, entities.dictionary_spans(docs, ["id"], "t", dictionary).collect()), key=repr)

    want, none = run(entries), run(entries.limit(0))
    assert len(want) == 201 + sum(i % 7 == 3 for i in range(200)) + 1 and none == []
    monkeypatch.setattr("pageloom.operators.joins.BROADCAST_LIMIT_BYTES", 0)
    assert run(entries) == want and run(entries.limit(0)) == none


def test_cap_of_span_rows(spark):
    spans = spark.createDataFrame(
        [(1, i, f"n{i % 30:02d}", "person" if i < 30 else "event") for i in range(60)],
        "id int, seq int, text string, label string")
    rows = entities.first_entities(spans, ["id"]).orderBy("rank").collect()
    assert [(r.rank, r.text, r.kind) for r in rows] == [(i + 1, f"n{i:02d}", "PERSON") for i in range(15)]
