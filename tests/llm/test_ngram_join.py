import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm.components import components
from pairloom.llm.ngram_join import near_duplicates


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=80):
    sets = [sets_of(t) for _, t, *_ in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if rows[i][0] == rows[j][0] or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    return sorted(((r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets)), key=str)


def planted(seed, groups=12, lone=40, hot=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(60)
    rows = [(k, " ".join(text(rnd.randrange(1, 80)) + (passage if k % 2 else []))) for k in range(lone)]

    def change(w, share):
        w = list(w)
        for k in range(len(w)):
            if rnd.random() < share:
                w[k] = word()
        return w

    for _ in range(groups):
        base = text(rnd.randrange(3, 150)) + (passage if rnd.random() < 0.3 else [])
        for _ in range(rnd.randrange(2, 8)):
            rows.append((len(rows), " ".join(change(base, rnd.choice([0, 0.005, 0.02, 0.04])))))
    base = text(150)
    rows += [(len(rows) + k, " ".join(change(base, 0.018)).upper() if k % 3 else " ".join(base)) for k in range(hot)]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(order[k] * 7, t) for k, (_, t) in enumerate(rows)]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 4)])
def test_against_all_pairs(spark, seed, parts):
    rows = planted(seed)
    want = brute(rows)
    assert len({w[2] for w in want}) < len(want)
    assert got(near_duplicates(documents(spark, rows).repartition(parts))) == want


def test_odd_rows(spark):
    rows = ODD + [(8, "a b c d"), (9, "A B\tc  d"), (10, "a b c"), (3, "another text of some six words"), (11, "another text of some six words"), (2, "one two three")]
    docs = documents(spark, rows).selectExpr("*", "1 as n", "'x' as fp", "2 as component")
    assert got(near_duplicates(docs)) == brute(rows)
    assert near_duplicates(documents(spark, [])).count() == 0


def test_threshold_is_exact(spark):
    """Sets of 8 to 12 shingles around an overlap of 80 in 100."""
    rows, words = [], [f"w{k}" for k in range(40)]
    for a in range(6):
        for n in range(8, 14):
            rows.append((len(rows), " ".join(words[a : a + n + 4])))
    assert got(near_duplicates(documents(spark, rows).repartition(3))) == brute(rows)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 501 + k) for k in range(40)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got_ = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got_ == {x: root(x) for e in edges for x in e if any(y != z for y, z in edges if x in (y, z))}
