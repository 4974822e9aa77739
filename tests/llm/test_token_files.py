import os
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm import elias_fano, token_counts
from pairloom.llm.common import scratch
from pairloom.llm.elias_fano import TOKENIZER, EliasFano, IdFile, library_encoder, pack_file, read_token_files, write_token_files
from pairloom.llm.files import Writer, folder

LIBRARY = Tokenizer.from_file(P.path(TOKENIZER))
LIBRARY.encode_special_tokens = True


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=200))
def test_elias_fano_selects_every_number(values):
    values = np.sort(np.array(values, np.int64))
    f = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert f.all().tolist() == values.tolist() == [f.select(i) for i in range(len(values))]
    for i in range(0, len(values) + 1, max(1, len(values) // 9)):
        for j in (i, min(len(values), i + 1), min(len(values), i + 130), len(values)):
            assert f.select_range(i, j).tolist() == values[i:j].tolist()


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000))
    bits = len(EliasFano.of(values).to_bytes()) * 8 / len(values)
    assert bits < np.log2(values[-1] / len(values)) + 3.5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_cached_pieces_give_the_librarys_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [np.frombuffer(x, "<u2").tolist() for x in library_encoder(TOKENIZER).encode(texts)]
    assert got == [ids_of(t) for t in texts]


def test_file_round_trip():
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (1, 0, 300, 2)]
    f = IdFile(pack_file([None, -5, -5, 1 << 40], ids, 2))
    assert f.doc_ids(0, f.docs) == [None, -5, -5, 1 << 40]
    assert [f.ids[slice(*f.bounds(i))].tobytes() for i in range(4)] == ids


@pytest.mark.parametrize("shard,limit", [(4096, 1 << 24), (3, 1 << 24), (3, 50)])
def test_token_files(spark, monkeypatch, shard, limit):
    monkeypatch.setattr(elias_fano, "SHARD_DOCS", shard)
    monkeypatch.setattr(elias_fano, "FILE_IDS", limit)
    docs = documents(spark, ODD).selectExpr("*", "'c' as shard", "1 as ids").repartition(3)
    manifest = write_token_files(docs)
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for i, t, *_ in rows:
        ids = ids_of(t) + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in read_token_files(manifest).collect()), key=lambda r: r[1]) == want
    assert (manifest.count() == 1) == (shard == 4096)


def test_token_files_of_an_empty_table(spark):
    assert read_token_files(write_token_files(documents(spark, []))).count() == 0


def test_token_counts(spark, monkeypatch):
    want = sorted((str(i), len(ids_of(t))) for i, t, *_ in ODD)
    docs = documents(spark, ODD).selectExpr("*", "'c' as file", "1 as ordinal").repartition(2)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(docs).collect()) == want
    assert token_counts.token_counts(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separators_across_blocks(spark, block):
    path = scratch(spark, "flat")
    folder(path)
    streams = [[9, 9, 7, 7, 9, 7, 9], [7], [9, 9, 9, 9, 9, 9, 9, 9, 7, 7]]
    files, want = [], []
    for k, s in enumerate(streams):
        w = Writer(f"{path}/{k}.bin")
        w.write(np.array(s, "<u4").tobytes())
        w.close()
        files.append((f"{k}.bin", len(s), 4))
        last, ordinal = -1, 0
        for j, x in enumerate(s):
            if x == 7:
                want.append((f"{k}.bin", ordinal, j - last - 1))
                last, ordinal = j, ordinal + 1
    df = spark.createDataFrame(files, "file string, n_ids long, width int")
    assert sorted(tuple(r) for r in token_counts.separator_scan(df, path, 7, block).collect()) == sorted(want)
