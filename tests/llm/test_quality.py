import os
import random
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm.quality import fit_label_model, fit_quality, good_documents, quality_classifier, text_features, votes
from pairloom.llm.words import shingle_sets, word_hashes

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    out = {r.doc_id: r for r in quality_classifier(docs).collect()}
    good = [out[i].kept for i, q in labels.items() if q == 1]
    bad = [not out[i].kept for i, q in labels.items() if q == 0]
    assert len(out) == docs.count() and np.mean(good) >= 0.99 and np.mean(bad) >= 0.9
    kept = good_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in out.items() if r.kept}


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    accuracy = [0.95, 0.9, 0.8, 0.7]
    v = np.column_stack([np.where(rng.random(4000) < 0.2, 2, np.where(rng.random(4000) < a, truth, ~truth)) for a in accuracy]).astype(int)
    patterns, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, rate, share = fit_label_model(patterns, counts.astype(float), kinds=1, false_alarm=0.5)
    assert abs(share - 0.2) < 0.04 and np.mean((post[inverse.ravel()] > 0.5) == truth) > 0.95
    assert np.allclose((rate[:, 1] + 1 - rate[:, 0]) / 2, accuracy, atol=0.06)


def test_statistics_by_hand():
    stats, grams = text_features(["Ab ab ab! |", "", "x"])
    s = dict(zip(("words", "symbols", "upper", "distinct", "repeats", "length", "stops", "lone", "shouts", "digits"), stats[0]))
    assert s["words"] == 4 and s["distinct"] == 1 and s["repeats"] == 0 and s["shouts"] == 0.25 and s["lone"] == 0.25
    assert np.isclose(s["symbols"], 1 / 8) and np.isclose(s["upper"], 1 / 6) and grams.sum() == 9 and stats[1].sum() == 0
    assert votes(stats).shape == (3, 7)


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as score", "2 as pattern")
    assert quality_classifier(docs).count() == len(ODD)
    assert quality_classifier(documents(spark, [])).count() == 0
    kept = good_documents(docs)
    assert kept.columns == docs.columns
    assert good_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("lower", [True, False])
def test_word_hashes_tell_words_apart(lower):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abAB é\t\n\x0b漢") for _ in range(rnd.randrange(60))) for _ in range(200)]
    h, bounds = word_hashes([t.encode() for t in texts], lower)
    import re

    seen = {}
    for k, t in enumerate(texts):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = h[bounds[k] : bounds[k + 1]].tolist()
        assert len(own) == len(words)
        for w, x in zip(words, own):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets_by_hand(monkeypatch):
    import re

    from pairloom.llm import words

    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["a", "b", "Cc", "dé"]) for _ in range(rnd.randrange(40))) for _ in range(100)] + ["", " ", "one two", "one  TWO"]
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        want.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    for block in (1 << 20, 16):
        monkeypatch.setattr(words, "BLOCK", block)
        sets = shingle_sets([t.encode() for t in texts])
        assert [len(s) for s in sets] == [len(w) for w in want]
        for i in range(0, 100, 7):
            for j in range(100, 104):
                assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])
        for i in range(99):
            assert len(np.intersect1d(sets[i], sets[i + 1])) == len(want[i] & want[i + 1])
