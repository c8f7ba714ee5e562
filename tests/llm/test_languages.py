"""Language report and training sums against plain versions."""

import itertools
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperloom.llm import language_id
from tests.llm.test_ops import prose

SPACE = language_id.SPACE


def segmentations(text, pieces):
    """(probability, pieces) of every way to cut a text; a letter that is no piece stands alone."""
    out = []
    for cuts in itertools.product([False, True], repeat=len(text) - 1):
        parts, at = [], 0
        for k, cut in enumerate((*cuts, True), 1):
            if cut:
                parts.append(text[at:k])
                at = k
        if all(p in pieces or len(p) == 1 for p in parts):
            out.append((math.prod(pieces.get(p, language_id.STRANGE) for p in parts), parts))
    return out


def plain_words(text):
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()


def test_words_are_letters_by_category():
    for text in ("² ½ Ⅳ", "x²y Ⅷth ½cup", "Größe_3 日本語 naïve", None, "", "𝟘a ٣ب"):
        assert language_id.words_of(text) == plain_words(text)


def test_report_equals_all_segmentations(spark):
    model = language_id.Model(["aa", "bb"], {SPACE: [0.1, 0.2], "a": [0.2, 0.1], "b": [0.1, 0.3], "ab": [0.3, 0.05], SPACE + "b": [0.05, 0.1], "ba": [0.1, 0.15], "bb": [0.15, 0.1]})
    texts = ["ab ba", "bbb b", "abc cab", "a", "² ½ Ⅳ", "", None, "ABBA abba", "zz", "b1b"]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        logs = [sum(math.log(sum(p for p, _ in segmentations(SPACE + w, {x: v[j] for x, v in model.pieces.items()}))) for w in plain_words(t)) for j in range(2)]
        if not plain_words(t):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        best = max(range(2), key=lambda j: logs[j])
        assert got[k]["lang_pred"] == model.languages[best]
        assert got[k]["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs))


def test_expected_counts():
    pieces = {SPACE: 0.1, "a": 0.2, "b": 0.1, "ab": 0.3, SPACE + "a": 0.2, "ba": 0.1}
    scorer = language_id.Scorer(language_id.Model(["x"], {p: [v] for p, v in pieces.items()}))
    for word in ("ab", "abab", "abcba", "c"):
        ways = segmentations(SPACE + word, pieces)
        want = {}
        for p, parts in ways:
            for x in parts:
                if x in pieces:
                    want[x] = want.get(x, 0.0) + 2 * p / sum(q for q, _ in ways)
        assert language_id.expectation({word: 2.0}, scorer, 0) == pytest.approx(want)
    # A long word counts to its end: as often as two halves of the same pieces.
    long = language_id.expectation({"ab" * 2000: 1.0}, scorer, 0)
    assert 1.9 < long["a"] / language_id.expectation({"ab" * 1000: 1.0}, scorer, 0)["a"] < 2.1


def test_held_out_rows(spark):
    rows = [(k, prose(k, 60) if k % 2 else prose(k, 60)[::-1], ["yy", "xx"][k % 2]) for k in range(120)]
    got = language_id.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))).collect()
    assert all(r["lang_pred"] == ["yy", "xx"][r["doc_id"] % 2] for r in got if r["held_out"]) and sum(r["held_out"] for r in got) > 10
