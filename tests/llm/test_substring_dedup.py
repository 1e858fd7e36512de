"""Substring dedup and its FM-index against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.conftest import ODD_TEXTS
from turnloom.llm.fm_index import FMIndex
from turnloom.llm.substring_dedup import digests, substring_dedup

NONE = np.iinfo(np.int64).max


def _brute(rows, window=50):
    """(n_words, n_removed, digest) of each (id, text), in order."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s : s + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(docs, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in digests(substring_dedup(docs, **options)).collect()), key=repr)


def _flat(sequences):
    return np.array([w for s in sequences for w in s], dtype=np.uint64) * np.uint64(7919), np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics(seed):
    """Sequences of the index and others, with words it lacks, empty sequences and one-word alphabets."""
    rng = random.Random(seed)
    alphabet, most = rng.choice([1, 2, 3, 10]), rng.choice([1, 2, 3, 5, 8])
    held = [[rng.randrange(alphabet) for _ in range(rng.randrange(20))] for _ in range(rng.randrange(1, 12))]
    owner = [rng.randrange(100) for _ in held]
    streamed = [[rng.randrange(alphabet + 1) for _ in range(rng.randrange(25))] for _ in range(6)] + held
    runs = {}
    for s, o in zip(held, owner, strict=True):
        for i in range(len(s)):
            for n in range(1, min(most, len(s) - i) + 1):
                runs[tuple(s[i : i + n])] = min(runs.get(tuple(s[i : i + n]), NONE), o)
    want = []
    for s in streamed:
        for i in range(len(s)):
            n = max(n for n in range(min(most, len(s) - i) + 1) if not n or tuple(s[i : i + n]) in runs)
            want.append((n, runs[tuple(s[i : i + n])] if n == most else NONE))
    length, least = FMIndex(*_flat(held), np.array(owner), most).matching_statistics(*_flat(streamed))
    assert list(zip(length.tolist(), least.tolist(), strict=True)) == want


def test_index_is_compressed():
    """Frequent words take few bits: the tree's bits are within one a word of the entropy."""
    words = np.random.default_rng(1).zipf(1.5, 40_000).clip(0, 5000)
    index = FMIndex(words.astype(np.uint64), np.arange(0, 40_001, 50), np.arange(800), 10)
    share = np.unique(np.append(words, np.full(800, -1)), return_counts=True)[1] / 40_800
    bits = sum(64 * len(v.units) for v in index.tree.levels)
    assert bits <= 40_800 * (1 - (share * np.log2(share)).sum()) + 64 * len(index.tree.levels)


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert _got(docs) == _brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("window", "most_segments", "shard_words"), [(50, 4096, 1 << 18), (5, 3, 200), (1, 2, 50), (100, 4, 500)])
def test_planted(make, window, most_segments, shard_words):
    """Passages at, under and over the window's length in many documents, whole copies, runs of one word, cases and separators; small shards, so that anchors are split."""
    rng = random.Random(window)
    word = lambda: "".join(rng.choice("abcdeAB") for _ in range(rng.randint(1, 4)))
    passages = [[word() for _ in range(n)] for n in (window - 1, window, window + 1, window + 30, 3 * window)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 3)):
            text += [word() for _ in range(rng.randint(0, 40))] + rng.choice([*passages, ["x"] * (window + 5), []])
        rows.append((i * 7 % 61, rng.choice([" ", "\n", "\t ", " \x0b"]).join(text)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, rows[4][1].upper()), (3, rows[5][1] + " end"), (None, rows[3][1]), (None, None), (-5, rows[6][1])]
    assert _got(make(rows, extra=True), window=window, most_segments=most_segments, shard_words=shard_words) == _brute(rows, window)


def test_odd(make):
    rows = [*ODD_TEXTS, (10, "Word " * 3000), (11, "word " * 200 + "é" * 30000 + " end"), (12, "word " * 200)]
    assert _got(make(rows)) == _brute(rows)
    assert _got(make([])) == []
