import hashlib
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from cases import documents
from test_ngram_join import brute as near
from test_ngram_join import planted

import corpus_pipeline
from pairloom.llm.common import table
from pairloom.llm.mixing import mix
from pairloom.llm.quality import quality_classifier


def test_stages_against_brute_force(spark, tmp_path):
    rows = planted(5, groups=8, lone=30, hot=20)
    rows += [(10_000 + k, "junk### " * 40 + str(k)) for k in range(12)] + [(20_000 + k, rows[k][1]) for k in range(10)] + [(30_000, None), (30_001, "")]
    documents(spark, [(i, t, f"s{i % 4}") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    kept = {r.doc_id for r in quality_classifier(docs).collect() if r.kept}
    stage, seen = docs, {}
    for name, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, str(tmp_path))
        stage.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        seen[name] = stage.collect()
        if name != "bpe":
            assert stage.columns == docs.columns
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    left = [r for r in rows if r[0] in kept]
    assert ids("quality_classifier") == sorted(r[0] for r in left) and not any(10_000 <= r[0] < 20_000 for r in left)
    best = {}
    for i, t in left:
        best[t or ""] = max(i, best.get(t or "", i))
    left = [r for r in left if best[r[1] or ""] == r[0]]
    assert ids("exact_dedup") == sorted(r[0] for r in left)
    roots = {i: c for i, _, c in near(left)}
    left = [r for r in left if roots[r[0]] == r[0]]
    assert ids("ngram_jaccard_join") == sorted(r[0] for r in left)
    copies = {r.doc_id: r.copies for r in mix(spark.read.parquet(str(tmp_path / "ngram_jaccard_join"))).collect()}
    assert ids("mixing") == sorted(i for i, n in copies.items() for _ in range(n))
    text = dict(rows)
    assert sorted((r.doc_id, r.decoded_sha256) for r in seen["bpe"]) == sorted((i, hashlib.sha256((text[i] or "").encode()).hexdigest()) for i in ids("mixing"))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids("mixing")
