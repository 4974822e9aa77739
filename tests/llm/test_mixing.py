import heapq
import os
import random
import re
import sys

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm.mixing import _turn, capped_targets, mix, mixed_documents, sainte_lague


def one_by_one(weights, seats, caps):
    got = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w > 0 and caps[k] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 12)), min_size=1, max_size=8), st.integers(0, 60))
def test_apportionment_is_seat_by_seat(items, seats):
    w, caps = [float(a) for a, _ in items], [b for _, b in items]
    assert list(sainte_lague(w, seats, caps)) == one_by_one(w, seats, caps)


def test_tied_seats_go_to_the_earlier_item():
    for w, seats, caps in (([11.0, 33.0], 6, [2, 5]), ([33.0, 11.0], 6, [5, 2]), ([7.0, 21.0, 35.0], 11, [9, 9, 9])):
        assert list(sainte_lague(w, seats, caps)) == one_by_one(w, seats, caps)


def test_targets_stop_at_cap_and_keep_the_total():
    t = capped_targets([100, 10, 50, 0], [5, 2, 1, 5], 240, 2)
    assert np.isclose(t.sum(), 240) and (t <= [200, 20, 100, 0]).all() and t[1] == 20


def rows():
    rnd = random.Random(2)
    return ODD + [(100 + k, " ".join(["w"] * rnd.randrange(1, 400)), rnd.choice(["hot", "hot", "s1", "s2", "s3", "s4"])) for k in range(900)]


def test_against_brute_force_stream(spark):
    data = rows()
    out = mix(documents(spark, data)).collect()
    size = {}
    for i, t, s in data:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = capped_targets([size[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))], 1.5 * sum(size.values()), 2)
    taken = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"] and 0 <= r.copies <= 2
        assert r.source_size == size[r.source] and np.isclose(r.target, want[order.index(r.source)])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(out) == len(data)
    for s, t in zip(order, want):
        assert abs(taken[s] - t) <= max(3, 0.01 * t)
    key = lambda r: (str(r.doc_id), r.taken, r.copies)
    again = mix(documents(spark, data[::-1]).repartition(7)).collect()
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert 0 <= _turn(1, 2, 3, 10) < 10


def test_words_taken_are_those_in_taken_blocks():
    """The closed formula against blocks laid out one by one."""
    block, sizes, seats, turn = 4, [3, 9, 1, 0, 14, 2], 11, 5
    n = -(-sum(sizes) // block)
    times = [((j + 1) * seats + turn) // n - (j * seats + turn) // n for j in range(n)]
    assert sum(times) == seats and max(times) <= 2
    before = lambda j: (j * seats + turn) // n
    to = lambda x: block * before(x // block) + x % block * (before(x // block + 1) - before(x // block))
    start = 0
    for s in sizes:
        assert to(start + s) - to(start) == sum(times[w // block] for w in range(start, start + s))
        start += s


def test_empty_and_whole_documents(spark):
    assert mix(documents(spark, [])).count() == 0
    docs = documents(spark, rows()).dropDuplicates(["doc_id"])
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    per = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.copies for r in mix(docs).collect() if r.copies}
    assert per == want
