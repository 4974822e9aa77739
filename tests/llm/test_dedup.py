import hashlib
import random
import sys, os

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm.dedup import DIGEST, Bloom, LsmIndex, Run, exact_dedup


def brute(rows, best=max):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        g = groups[t or ""]
        ids = [x for x in g if x is not None]
        k = best(ids) if ids and len(g) > 1 else i
        out.append((i, k, len(g), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep,best,width", [("largest", max, 32), ("smallest", min, 32), ("largest", max, 1)])
def test_matches_brute_force(spark, keep, best, width):
    rnd = random.Random(3)
    rows = ODD + [(10 + k, f"text {rnd.randrange(40)}") for k in range(300)] + [(1000 + k, "hot") for k in range(150)]
    assert got(exact_dedup(documents(spark, rows), keep, width)) == brute(rows, best)


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup(documents(spark, [])).count() == 0
    df = documents(spark, ODD).selectExpr("*", "'x' as digest", "1 as keep_id", "2 as group_size", "true as kept", "'y' as sha")
    assert got(exact_dedup(df)) == brute(ODD)


def test_lsm_index_counts_and_filters():
    rnd = random.Random(5)
    want, index = {}, LsmIndex("smallest", fanout=3)
    for run in range(11):
        memtable = {}
        for _ in range(50):
            d, i = hashlib.sha256(str(rnd.randrange(200)).encode()).digest(), rnd.randrange(10_000)
            old = memtable.get(d, (i, 0))
            memtable[d] = (min(old[0], i), old[1] + 1)
            w = want.get(d, (i, 0))
            want[d] = (min(w[0], i), w[1] + 1)
        keys = sorted(memtable)
        index.add(Run(np.frombuffer(b"".join(keys), DIGEST), np.array([memtable[k][0] for k in keys]), np.array([memtable[k][1] for k in keys])))
    probe = sorted(want) + [hashlib.sha256(b"absent").digest()]
    ids, counts = index.get(np.frombuffer(b"".join(probe), DIGEST))
    assert counts[-1] == 0 and [(int(a), int(b)) for a, b in zip(ids[:-1], counts[:-1])] == [want[k] for k in probe[:-1]]
    run = index.compact()
    assert len(run) == len(want) and list(run.ids) == [want[k][0] for k in sorted(want)]


def test_bloom_has_no_false_negatives():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(2000)), DIGEST)
    bloom = Bloom.of(keys[:1000])
    assert bloom.may_hold(keys[:1000]).all() and bloom.may_hold(keys[1000:]).mean() < 0.05
