"""The plans that broadcast nothing, which large tables get, give the same rows."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import test_dedup
import test_lines as line_cases
import test_ngram_join
from cases import ODD, documents

from pairloom.llm import components, dedup, lines, mixing, ngram_join


@pytest.fixture(autouse=True)
def nothing_is_broadcast(monkeypatch):
    for m in (components, dedup, lines, mixing, ngram_join):
        monkeypatch.setattr(m, "BROADCAST_ROWS", 0)


def test_similar_lines(spark):
    line_cases.check(spark, line_cases.rows(3))


def test_lines_far_down_their_lists(spark, monkeypatch):
    """Short heads, salted lists: what pivots and salts leave over is met in the second round."""
    monkeypatch.setattr(lines, "HEAD", 1)
    monkeypatch.setattr(lines, "LIST", 1)
    monkeypatch.setattr(lines, "CELLS", 1 << 10)
    line_cases.check(spark, line_cases.rows(4, hot=70))


def test_exact_copies(spark):
    rnd = random.Random(7)
    data = ODD + [(10 + k, f"text {rnd.randrange(30)}") for k in range(200)] + [(1000 + k, "hot") for k in range(100)]
    assert test_dedup.got(dedup.exact_dedup(documents(spark, data))) == test_dedup.brute(data)


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ASKS", 16)
    data = test_ngram_join.planted(5, groups=6, lone=20, hot=30)
    assert test_ngram_join.got(ngram_join.near_duplicates(documents(spark, data).repartition(3))) == test_ngram_join.brute(data)


def test_several_fragments_a_task(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_TASKS", 3)
    data = test_ngram_join.planted(6, groups=6, lone=20, hot=20)
    assert test_ngram_join.got(ngram_join.near_duplicates(documents(spark, data).repartition(3), fragments=17)) == test_ngram_join.brute(data)


@pytest.mark.parametrize("n", [1, 2, 5, 20, 200])
def test_fragments_are_even(n):
    """Prefixes of documents with few shingles, or with many, fill no fragment to over twice the mean."""
    rng = np.random.default_rng(n)
    sets = np.sort(rng.integers(0, 1 << 64, (max(4000, 200_000 // n), n), np.uint64, endpoint=False), axis=1)
    keep = n - int(ngram_join.needed(np.int64(n), 80)) + int(ngram_join.margin(np.int64(n), 80))
    count = np.bincount(ngram_join._prefix_fragment(sets[:, :keep].ravel(), 100), minlength=100)
    assert count.max() <= 2.4 * count.mean()
