"""Token counts and packing against the library, text by text."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.conftest import ODD_TEXTS
from turnloom.llm import bpe, packing, token_counts
from turnloom.llm.storage import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = bpe.ByteBpe(PATH)


def _ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("'strevlmd \n\t1aé　 ")), max_size=40), max_size=6))
def test_ids_equal_the_library(texts):
    flat, at = CODER.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [_ids(t) for t in texts]


def test_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 50)
    coder = bpe.ByteBpe(PATH)
    for k in range(20):
        texts = [f"word{k} other{k * 7} {k}" for _ in range(3)]
        flat, at = coder.encode(texts)
        assert flat[at[0] : at[1]].tolist() == _ids(texts[0])
        assert len(coder.keys) <= 50


@pytest.mark.parametrize("extra", [False, True])
def test_counts_of_odd_texts(make, extra):
    rows = [*ODD_TEXTS, ODD_TEXTS[3]]
    got = sorted(map(tuple, token_counts.token_counts(make(rows, extra), PATH).collect()))
    want = sorted((i, len((t or "").encode()), len(_ids(t)), len(_ids(t)) > 512) for i, t in rows)
    assert got == want


def test_counts_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens) == (len(r.text.encode()), len(_ids(r.text)))


def test_cache_is_used_and_appended(spark, make):
    cache = new_path(spark, "cache-test")
    first = token_counts.token_counts(make([(1, "a b"), (2, "a b"), (3, "c")]), PATH, cache).collect()
    assert len(first) == 3
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    # a stored count wins over encoding: what is known is not encoded again
    spark.read.parquet(cache).where("n_tokens = 2").withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(moved := new_path(spark, "cache-moved"))
    again = {r.doc_id: r.n_tokens for r in token_counts.token_counts(make([(1, "a b"), (4, "d e f")]), PATH, moved).collect()}
    assert again == {1: 77, 4: 3}
    assert spark.read.parquet(moved).count() == 2


def test_empty_tables(make):
    assert token_counts.token_counts(make([]), PATH).count() == 0
    assert packing.best_fit_packing(make([]), PATH).count() == 0


def _check_packing(rows, docs, capacity):
    ids = {i: [*_ids(t), 2] for i, t in docs}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.ids_crc32 == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
    assert {i: sum(r.length for r in v) for i, v in by_doc.items()} == {i: len(v) for i, v in ids.items()}
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == [*range(len(own))]
        assert (len(own) == 1) == (len(ids[i]) <= capacity)
        assert all(r.length == capacity for r in own[1:])
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert sum(r.length for r in own) <= capacity
    return len(by_bin), sum(map(len, ids.values()))


def test_packing_of_odd_texts(make):
    _check_packing(packing.best_fit_packing(make(ODD_TEXTS, extra=True), PATH).collect(), ODD_TEXTS, 1024)


def test_packing_is_tight(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bins, total = _check_packing(packing.best_fit_packing(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert bins <= 1.02 * total / 1024 + 1


def test_repeated_rows_are_packed_each(make):
    rows = packing.best_fit_packing(make([(1, "a b c")] * 5), PATH).collect()
    assert len(rows) == 5 and sum(r.length for r in rows) == 5 * (len(_ids("a b c")) + 1)


def test_open_bins_stay_bounded():
    rng = np.random.default_rng(1)
    bins = packing.OpenBins(100, 8)
    used = {}
    for length in rng.integers(1, 101, 3000).tolist():
        number, offset = bins.put(length)
        assert used.get(number, 0) == offset
        used[number] = offset + length
        assert used[number] <= 100 and bins.count <= 8
