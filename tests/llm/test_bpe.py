import base64
import hashlib
import os
import random
import sys

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm.bpe import VOCABULARY, codec, decode_documents, encode_documents, load_ranks, merge_piece, round_trip
from pairloom.llm.scanner import class_table, piece_starts, split_texts

PATTERN = regex.compile(P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})


def pieces_of(texts):
    pieces, numbers, bounds = split_texts(texts)
    return [[pieces[k] for k in numbers[a : b - 1]] for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("stmdrvleaZé'  \t\n 　12!?")), max_size=40).map("".join), min_size=1, max_size=5))
def test_pieces_are_the_patterns(texts):
    assert pieces_of(texts) == [PATTERN.findall(t) for t in texts]


def test_blocks_carry_their_state():
    rnd = random.Random(4)
    text = "".join(rnd.choice("stre'lvl  \t\n12!?ab") for _ in range(5000))
    classes = class_table()[np.array([ord(c) for c in text])]
    whole = piece_starts(classes)
    for block in (1, 7, 64, 65, 1000):
        assert (piece_starts(classes, block) == whole).all()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    c = codec(VOCABULARY)
    ids = np.frombuffer(c.encode([text])[0], "<u4").astype(np.int64)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert c.decode(ids) == text.encode() and (not len(ids) or c.offsets(ids)[-1] == len(text.encode()))


def test_long_pieces():
    for piece in (b"x" * 3001, b"ab" * 2000, bytes(range(256)) * 4, "é漢".encode() * 500):
        assert merge_piece(piece, load_ranks(VOCABULARY)) == LIBRARY._encode_single_piece(piece)


def test_documents(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as ids", "2 as n_tokens")
    want = sorted(
        (str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, *_ in ODD
        for ids in [LIBRARY.encode_ordinary(t or "")]
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(docs).collect()) == want
    encoded = encode_documents(docs)
    back = {(r.doc_id, bytes(r.decoded)) for r in decode_documents(encoded).collect()}
    assert back == {(i, (t or "").encode()) for i, t, *_ in ODD}
    assert round_trip(documents(spark, [])).count() == 0
