import hashlib
import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm.secrets import KINDS, Automaton, Formats, base_spans, scan_secrets

RULES = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (rule, ok) in enumerate(RULES) for m in rule.finditer(text or "") if ok(m)]
    return sorted(spans)


def key(rnd, symbols, n):
    return "".join(rnd.choice(symbols) for _ in range(n))


def rows():
    rnd = random.Random(9)
    parts = ["token = ", "Secret:'", "api_key=", "APIKEY = \"", "pasſword=abcdefgh", "toKen=abcdefgh", "secret=token:abcdefgh ", "AKIA", "AKIAAKIA", " ", "é", "word ", "password=ab token=abcdef12 "]
    out = list(ODD)
    for i in range(300):
        t = "".join(rnd.choice(parts) + key(rnd, rnd.choice(["0123456789abcdef", "ABCDEFGHIJ0123456789", "xyz="]), rnd.choice([3, 5, 6, 15, 16, 23, 24, 40])) for _ in range(rnd.randrange(6)))
        out.append((100 + i, t))
    return out


def test_base_spans_are_the_rules():
    for _, t, *_ in rows():
        assert [s[:3] for s in base_spans(t or "")] == brute(t)


def test_documents(spark):
    data = rows()
    got = {}
    for r in scan_secrets(documents(spark, data).selectExpr("*", "1 as base", "2 as tokens")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(data)
    for i, t, *_ in data:
        r, want = got[i][0], brute(t)
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        if len(got[i]) == 1:
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
            assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert scan_secrets(documents(spark, [])).count() == 0


def test_automaton_learns_a_format():
    rnd = random.Random(1)
    fixed = lambda: "sk" + key(rnd, "0123456789", 8) + "-" + key(rnd, "ABCDEF", 12)
    formats = Formats({"assign": [fixed() for _ in range(300)], "access": [], "hex": []})
    hits = sum(formats.best(fixed()) == "assign" for _ in range(200))
    assert hits >= 180
    for other in (key(rnd, "0123456789", 16), "mail1.example.com", key(rnd, "0123456789abcdef", 23), "sk12345678-ABCDEFABC", "2024-01-01T00:00:00"):
        assert formats.best(other) is None
    a = formats.automata["assign"][0]
    reached, todo = {0}, [0]
    while todo:
        for t, _ in a.next[todo.pop()].values():
            if t not in reached:
                reached.add(t)
                todo.append(t)
    assert len(reached) < 60  # merged: the tree has thousands of states


def test_counts_survive_merging():
    a = Automaton()
    for v in ("ab", "ab", "cb", "c"):
        a.add(v)
    assert a.visits(0) == 4
    a.fit()
    assert a.visits(0) == 4 and a.score("ab") < 0


def test_long_values_are_scored_whole():
    rnd = random.Random(3)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    jwt = lambda n: "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + key(rnd, symbols, n)
    formats = Formats({"assign": [jwt(rnd.randrange(120, 300)) for _ in range(300)], "access": [], "hex": []})
    longer = [jwt(rnd.randrange(120, 300)) for _ in range(100)]
    assert sum(formats.best(v) == "assign" for v in longer) >= 90
    assert not any(formats.best(v + "/+" * 200) for v in longer)
    assert sum(formats.automata["assign"][0].stops) == 0


def test_short_and_embedded_keys_are_found(spark):
    rnd = random.Random(4)
    fixed = lambda: "kx" + key(rnd, "qwz", 6) + "-" + key(rnd, "HJK", 3)
    keys = [fixed() for _ in range(5)]
    rows = [(i, f"token: {fixed()}") for i in range(300)]
    rows += [(1000, f"a letter {keys[0]} alone"), (1001, f"?auth={keys[1]}&x"), (1002, f"see host/x/{keys[2]}."), (1003, f"{keys[3]}/token={keys[4]}"), (1004, "some ordinary words of longer sentences here")]
    got = {r.doc_id: r for r in scan_secrets(documents(spark, rows)).filter("doc_id >= 1000").collect()}
    for i, at in ((1000, 9), (1001, 6), (1002, 11)):
        assert got[i].spans == f"like_assign:{at}:{at + 12}", got[i]
    assert got[1003].spans == "like_assign:0:12,assign:13:31" and got[1003].n_added == 1
    assert got[1004].spans == ""
