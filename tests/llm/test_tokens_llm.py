"""Packing and token counts against the libraries themselves."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import packing, tokencount, tokens
from geoloom.llm.queries import op1_harmonic_packing, vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
LETTERS = "abcXYZ \n\t\x0b\x1c\x85\xa0'sStTreé\u0301ÉßſŸİıΣς²½3!<|endoftext|>\x00中ª"
SCHEMA = "doc_id long, text string"


def library_ids(text):
    return tokens.tokenizer(WORD).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=120))
def test_ids_and_counts_are_the_librarys(text):
    assert np.frombuffer(tokens.word_ids(WORD)(text), "<u4").tolist() == library_ids(text)
    count = len(tokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids)
    assert tokencount.count_tokens(BYTE, text, chunk=20, overlap=4)[0] == count
    assert tokencount.count_tokens(BYTE, text)[0] == count


@pytest.mark.parametrize("text", ["a" * 30_000, "é" * 20_000, " " * 20_000, "x<|endoftext|>" * 2000, ("word " * 3 + "z" * 200) * 200, "ab\n" * 9000])
def test_long_texts_without_a_place_to_splice(text):
    n, chunks, widened = tokencount.count_tokens(BYTE, text, chunk=1000, overlap=16)
    assert n == len(tokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids)
    assert widened or chunks > 1


def test_counts_of_edge_rows(spark):
    rows = [(1, None), (None, "two words"), (1, ""), (1, "é é"), (1, "é é")]
    got = tokencount.count(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_tokens string"), BYTE, limit=1).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens > 0, r.over_limit) for r in got] == [(1, 0, False, False), (None, 9, True, True), (1, 0, False, False), (1, 5, True, True), (1, 5, True, True)]
    assert tokencount.count(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30_000), st.sampled_from([64, 1024, 4096]))
def test_cuts_are_whole_and_fit_their_class(length, capacity):
    made = list(packing.cut(length, capacity))
    assert sum(n for _, n in made) == length
    assert all(k * n <= capacity for k, n in made)
    assert all(k * n >= packing.FILL * capacity - k for k, n in made)


def check_pieces(rows, texts, capacity=4096):
    """Every id in one piece, sequences gapless, and little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array([*library_ids(text), 2], dtype="<u4")
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.02 * total


def test_packing_query_against_brute_force(spark):
    rows = op1_harmonic_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    check_pieces(rows, texts)


def test_packing_edge_rows(spark):
    random.seed(5)
    texts = {i: " ".join(random.choice("abcdefgh") for _ in range(n)) for i, n in enumerate([0, 1, 5, 4095, 4096, 4097, 9000, 2047, 2048, 1364, 70])}
    texts[100] = None
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], SCHEMA + ", length int").repartition(3)
    check_pieces(packing.digest(packing.pack(docs, WORD)).collect(), texts)
    assert packing.pack(docs.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORD, capacity=1000)


def test_packed_ids_round_trip(spark):
    rows = packing.pack(spark.createDataFrame([(None, "one two three"), (7, "four")], SCHEMA), WORD).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.length == r.doc_tokens}.get(7) == [*library_ids("four"), 2]
    assert sorted(sum((np.frombuffer(r.ids, "<u4").tolist() for r in rows), [])) == sorted([*library_ids("one two three"), 2, *library_ids("four"), 2])
