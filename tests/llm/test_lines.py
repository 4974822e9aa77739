import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm import lines
from pairloom.llm.common import stored
from pairloom.llm.lines import CELLS, dedup_lines, kept_lines, keyed, prefixes, verified


def brute(rows, percent=80):
    lines = []
    seen = {}
    for i, t, *_ in rows:
        seen.setdefault((i, t or ""), None)
    order = sorted(seen, key=lambda x: (x[0] is not None, x[0] or 0))
    out = {}
    for i, t in order:
        kept, removed = [], 0
        for line in t.split("\n"):
            s = frozenset(re.split(r"[\x20\x09-\x0D]+", line)) - {""}
            hit = bool(s) and any(100 * len(s & o) >= percent * len(s | o) for o in lines)
            if s:
                lines.append(s)
            if not hit:
                kept.append(line)
            removed += hit
        out[(i, t)] = ("\n".join(kept), len(t.split("\n")), removed)
    return out


def rows(seed, hot=40):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "to"] * 20 + ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base = [line(rnd.randrange(1, 25)) for _ in range(25)]
    common = line(20)

    def change(w):
        w = list(w)
        for k in range(len(w)):
            if rnd.random() < 0.05:
                w[k] = rnd.choice(vocabulary)
        rnd.shuffle(w)
        return w

    out = []
    for k in range(90):
        doc = [line(rnd.randrange(0, 20)) if rnd.random() < 0.5 else change(rnd.choice(base)) for _ in range(rnd.randrange(1, 8))]
        if k < hot:
            doc.append(change(common) if k % 2 else common)
        out.append((k * 3, "\n".join(" ".join(w) for w in doc)))
    rnd.shuffle(out)
    return out


def check(spark, data, **extra):
    want = brute(data)
    docs = documents(spark, data)
    for k, v in extra.items():
        docs = docs.selectExpr("*", f"{v} as {k}")
    got = dedup_lines(docs.repartition(3)).collect()
    assert len(got) == len(data)
    left = [((i, want[(i, t or "")][0] if t is not None else None), 0 if t is None else want[(i, t)][1], want[(i, t or "")][2]) for i, t, *_ in data]
    assert sorted(left, key=str) == sorted((((r.doc_id, r.text), r.n_lines, r.n_removed) for r in got), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    check(spark, rows(seed))


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    data = ODD + [(8, "one three two\n\n\none three two"), (9, long), (10, long + " more"), (8, "one three two\n\n\none three two")]
    check(spark, data, gone="1", codes="2", h="3")
    assert dedup_lines(documents(spark, [])).count() == 0


def test_levels_are_no_column(spark):
    """The table of levels stands inside one projection: as a column it is copied to each row."""
    docs = keyed(documents(spark, [(1, "one two three\nfour")]), True)
    levels = spark.range(1).selectExpr(f"array_repeat(cast(8 as tinyint), {CELLS}) as levels")
    found = prefixes(kept_lines(docs, None), levels, 80)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sort_array(transform(array_distinct(" in plan and not re.search(r"Subquery \S+, \[id=#\d+\] AS levels", plan)
    assert sorted((r.n, r.skip, len(r.prefix)) for r in found.collect()) == [(1, 0, 1), (3, 0, 1)]


def test_few_whole_sets_move(spark, monkeypatch):
    """Lines that differ in too many words for their bitmaps to tell meet by short hashes; their
    whole sets stay."""
    base = [f"w{k}" for k in range(300)]
    text = lambda k: " ".join(base[:240] + [f"x{k}_{i}" for i in range(60)])
    docs = keyed(documents(spark, [(k, text(k)) for k in range(6)] + [(9, text(3) + " more")]), True)
    pairs = spark.createDataFrame([(x, 0, 0, y, 0, 0) for x in (*range(6), 9) for y in range(6) if y < x], "doc long, h long, line_no int, y_doc long, y_h long, y_line_no int")
    tables = {}
    monkeypatch.setattr(lines, "stored", lambda df, name, sort=None: tables.setdefault(name, stored(df, name, sort)))
    monkeypatch.setattr(lines, "discard", lambda *a: None)
    assert [r.doc for r in verified(docs, pairs, 80, "t").collect()] == [9]
    assert tables["t-pairs"].count() == 21 and tables["t-first-ends"].count() == 2
