"""A query pays for the parts of a paper that it reads."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import labels
from paperloom.operators import build
from paperloom.plans import corpus, paper, queries

from .conftest import SF001


def never(*_, **__):
    raise AssertionError("a part was worked out that is not read")


@pytest.fixture(scope="module")
def few(spark):
    return paper.cut(corpus.segmented(spark, SF001).where("paper_id < 6"))


def test_kinds_are_the_same_with_and_without_items(spark, few, monkeypatch):
    """Questions by themselves put no items in order and make no subs; their kinds are those told from the items that blocks read."""
    whole = paper.parse(few)
    want = whole.items.count() and whole.questions.collect()
    monkeypatch.setattr(build, "items", never)
    monkeypatch.setattr(build, "subs", never)
    monkeypatch.setattr(queries, "segmented", lambda *_: few)
    got = paper.parse(few).questions.collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r["kind"] for r in got} >= {"mcq", "match", "list", "inline"}


def test_subs_ask_for_no_items_and_no_pairs(spark, few, monkeypatch):
    for name in ("items", "item_rows", "match_rows", "reworded_headings"):
        monkeypatch.setattr(build, name, never)
    monkeypatch.setattr(queries, "segmented", lambda *_: few)
    rows = queries.mcq_subs(spark, "").collect()
    assert rows and all(r["options"] is not None for r in rows)


def test_romans_of_any_case(spark):
    """Forms as they were told from labels in lower case, for every mix of cases."""
    cases = {"ii": "r", "iI": "R", "Ii": "R", "II": "R", "viii": "r", "vIIi": "R", "VIII": "R", "v": "r", "X": "R", "i": "a", "I": "A", "b": "a", "xi": None, "İ": None, "": None, None: None}
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, label string").select("label", labels.label_format(F.col("label")).alias("form"), labels.is_ambiguous(F.col("label")).alias("two"))
    got = rows.collect()
    assert {r["label"]: r["form"] for r in got} == cases
    assert {r["label"] for r in got if r["two"]} == {"v", "X", "i", "I"}
