import pytest
from pyspark.sql import functions as F

from pageloom.operators import validation


@pytest.mark.parametrize("items,valid,failed", [
    (["2147483646", "-2147483648", "0"], ["2147483646", "-2147483648", "0"], []),
    (["-7", "2147483647", "many"], [], [("-7", "Odd number"), ("2147483647", "Odd number"), ("many", "Not a number")]),
    (["88", "13", "x9"], ["88"], [("13", "Odd number"), ("x9", "Not a number")]),
    ([], [], []),
    (["+2", "-4", " 2", "2.0", "99999999999", None, ""], ["+2", "-4"],
     [(" 2", "Not a number"), ("2.0", "Not a number"), ("99999999999", "Not a number"),
      (None, "Not a number"), ("", "Not a number")]),
])
def test_split(spark, items, valid, failed):
    df = spark.createDataFrame(list(enumerate(items)), "n int, item string")
    ok, bad = validation.validate(df, "item", validation.even_integer_rules(F.col("item")))
    assert [r.item for r in ok.orderBy("n").collect()] == valid
    assert [(r.item, r.message) for r in bad.orderBy("n").collect()] == failed


def test_error_text(spark):
    df = spark.createDataFrame([("17", "too small")], "i string, m string")
    assert df.select(validation.error_text(F.col("i"), F.col("m"))).first()[0] == "Invalid item: 17 - too small"


def test_html_paths(spark):
    cases = {"/a/b.html": True, "/a/b.HTML": True, "/a/b.htm": False, "/a/html": False,
             "/a/.html": False, "/a/b.html.gz": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", validation.is_html_path(F.col("p"))).collect()} == cases
