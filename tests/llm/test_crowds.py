"""Ids that are no numbers, repeated texts in training, and links at the threshold within crowded bands."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import language_id, minhash, suffix_dedup
from tests.llm.test_ops import brute_components, prose, shingle_set


def test_ids_of_any_type(spark):
    base = prose(1, 200)
    texts = [base, base + " " + prose(2, 10), prose(3, 200), None, base, prose(4, 150) + base]
    rows = [(k + 1, f"w-{k:03}", t) for k, t in enumerate(texts)] + [(None, None, base)]
    df = spark.createDataFrame(rows, "n long, s string, text string")
    name = {n: s for n, s, _ in rows}
    by_number = sorted(((name[r[0]], *r[1:]) for r in suffix_dedup.repeated_spans(df, id_col="n").collect()), key=str)
    assert sorted((tuple(r) for r in suffix_dedup.repeated_spans(df, id_col="s").collect()), key=str) == by_number
    kept = sorted(((name[r[0]], *r[1:]) for r in suffix_dedup.repeated_spans(df, True, id_col="n").collect()), key=str)
    assert sorted((tuple(r) for r in suffix_dedup.repeated_spans(df, True, id_col="s").collect()), key=str) == kept
    near = sorted(((name[r[0]], r[1], name[r[2]], r[3]) for r in minhash.near_duplicates(df, id_col="n").collect()), key=str)
    assert sorted((tuple(r) for r in minhash.near_duplicates(df, id_col="s").collect()), key=str) == near
    assert ("w-001", len(shingle_set(texts[1])), "w-000", False) in near


@pytest.mark.parametrize("seed", range(2))
def test_no_language_is_lost(spark, seed):
    notice = ["We use cookies to make this site work well for you", "All rights are reserved by the owner of this page"][seed]
    rows = [(k, notice, "en") for k in range(1000)] + [(2000 + k, "Der Hund und die Katze gehen durch den alten Garten " + prose(k, 3), "de") for k in range(400)] + [(5000 + k, "12 34", "xx") for k in range(9)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    probe = spark.createDataFrame([(1, notice), (2, "Der Garten und der Hund")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(probe, model).orderBy("doc_id").collect()] == ["en", "de"]


def test_links_at_the_threshold_in_crowded_bands(spark, monkeypatch):
    """300 texts around a passage share bands, among them 60 pairs of a similarity from 0.75 to 0.80 that nothing else leads to."""
    monkeypatch.setattr(minhash, "CROWD", 8)
    rng = random.Random(3)
    passage, rows, pairs = prose(900, 80), [], []
    for k in range(180):
        own = [f"own{k}x{n}" for n in range(rng.randint(40, 90))]
        rows.append((10 * k, f"{' '.join(own)} {passage}"))
        if k % 3 == 0:
            best = None
            for cut in range(1, 14):
                w = list(own)
                for c in range(cut):
                    w[(c * 7) % len(w)] = f"new{k}x{c}"
                text = f"{' '.join(w)} {passage}"
                a, b = shingle_set(rows[-1][1]), shingle_set(text)
                if 75 <= 100 * len(a & b) / len(a | b) < 80:
                    best = text
            if best:
                rows.append((10 * k + 5, best))
                pairs.append((10 * k, 10 * k + 5))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df.withColumn("rank", F.lit("x"))).collect()}
    assert len(pairs) > 40 and got == brute_components(rows)
