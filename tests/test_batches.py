"""Python steps hold a part of a batch at a time, whatever the session's batch size."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.functions import batches, markup
from pageloom.operators import dom, entities


def detector_of(monkeypatch, build):
    """The Python function under a column function, to be run here."""
    found = []
    monkeypatch.setattr(entities.F, "arrow_udf", lambda f, kind: found.append(f))
    build()
    return found[0]


def test_parts_are_consecutive_and_bounded():
    texts = pa.array(["ab", None, "", "x" * 50, "cd", "é"] * 3)
    found = list(batches.parts(texts, most=10))
    assert pa.concat_arrays(found).equals(texts)
    assert all(len(p) == 1 or sum(len((t or "").encode()) + 1 for t in p.to_pylist()) <= 10 for p in found)
    lists = pa.array([["a"] * 3, None, [], ["b"] * 40, ["c"]])
    assert [p.to_pylist() for p in batches.parts(lists.slice(1), most=4)] == [[None, []], [["b"] * 40], [["c"]]]
    assert list(batches.parts(texts.slice(0, 0))) == []


def test_pages_are_parsed_part_by_part():
    pages = pa.array([f"<p class=a>{i}</p>" + "<b>x</b>" * 20_000 for i in range(20)] + [None, ""])
    found = markup._parse_batches(iter([pages, pages.slice(0, 0)]))
    first = next(found)
    assert len(first) < 10
    assert pa.concat_arrays([first, *found]).equals(markup._parse_batch(pages))


def test_recogniser_gets_part_by_part(spark, monkeypatch):
    detect = detector_of(monkeypatch, lambda: entities.span_detector(lambda: lambda text, labels: [(text[:2], labels[0])], ["person"]))
    texts = pa.array([f"{i:02d}" + "x" * 200_000 for i in range(20)] + [None])
    found = list(detect(iter([texts])))
    assert len(found) > 2
    assert pa.concat_arrays(found).to_pylist() == [
        {"spans": [{"text": f"{i:02d}", "label": "person"}], "status": "ok"} for i in range(20)] + [{"spans": [], "status": "no text"}]


def test_dictionary_is_looked_up_part_by_part(spark, monkeypatch):
    entries = spark.createDataFrame([("a b", "person"), ("c", "law")], "text string, label string")
    detect = detector_of(monkeypatch, lambda: entities.dictionary_detector(entries, 2))
    rows = [["x"] * 20_000 + ["a", "b", "c"], None, ["b", "a"], ["c"], []] * 10
    found = list(detect(iter([pa.array(rows).slice(1), pa.array([["a"], ["b"]])])))
    assert len(found) > 3
    own = [{"seq": 40_001, "text": "a b", "label": "person"}, {"seq": 40_004, "text": "c", "label": "law"}]
    want = [own, None, [], [{"seq": 0, "text": "c", "label": "law"}], []] * 10
    assert pa.concat_arrays(found).to_pylist() == want[1:] + [[], []]


@pytest.mark.parametrize("rows", [dom.dom_nodes, lambda pages, keys: dom.dom_select_each(
    dom.parse_pages(pages, keys), keys, {"p": lambda n: n["tag"] == "p"}), lambda pages, keys: dom.dom_select(
    dom.parse_pages(pages, keys), keys, lambda n: n["tag"] == "p")])
def test_rows_of_nodes_parse_once(pages, rows):
    found = rows(pages({"u": "<p>a</p><p>b</p>", "v": "", "w": None}), ["url"]).filter("tag is not null")
    assert found.filter("tag = 'p'").count() == 2
    plan = found.groupBy("tag").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
