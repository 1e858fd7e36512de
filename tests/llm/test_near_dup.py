"""Near-duplicates and components against brute force."""

import random
import re

import pytest

from tests.conftest import SMALL
from tests.llm.conftest import ODD_TEXTS
from turnloom.llm.components import connected_components
from turnloom.llm.near_dup import keep_one, near_duplicates


def _sets(rows):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    return out


def _brute(rows, least=85):
    sets = _sets(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def _got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert _got(near_duplicates(docs)) == _brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1])
def test_planted_copies(make, seed):
    """Groups of copies with more and fewer changed words, many near the limit, and passages that differing texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(8):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join([*passage, *[word() for _ in range(rng.randint(3, 60))]])) for k in range(30)]
    rows += [(1000, rows[0][1].upper()), (1001, rows[0][1].replace(" ", "\n\t"))]
    assert _got(near_duplicates(make(rows))) == _brute(rows)


def test_odd_texts(make):
    got = _got(near_duplicates(make(ODD_TEXTS, extra=True)))
    assert got == _brute(ODD_TEXTS)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[8] == (4, 7, False)


def test_empty_repeated_and_null_ids(spark, make):
    assert near_duplicates(make([])).count() == 0
    rows = near_duplicates(make([(3, "a b c d e f g")] * 3 + [(None, "a b c d e f g"), (None, "z")])).collect()
    assert len(rows) == 5 and {r.component_id for r in rows if r.doc_id == 3} == {3}


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (100, 60), (70, 60), (9, 9), (1, 0), (0, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 50, 50: 50, 60: 50, 70: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("total", range(7))
def test_few_words_alone(make, total):
    """A batch of few words in all, in one text or in several, one row a partition."""
    words = ["two", "Words", "and", "more", "of", "them"][:total]
    for rows in ([(1, " ".join(words))], list(enumerate(words)), [(1, " ".join(words[:1])), (2, " ".join(words[1:])), (3, "")]):
        docs = make(rows)
        assert _got(near_duplicates(docs.repartition(max(1, len(rows))))) == _brute(rows)


def test_short_text_between_very_long_ones(make):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, long + " x"), (2, "two words"), (3, long + " y"), (4, "z")]
    assert len(long) > 1 << 20
    assert _got(near_duplicates(make(rows).coalesce(1))) == _brute(rows)


BASE = [f"b{k}" for k in range(60)]
#: one id with two texts, one of them near to another id's; a repeated row; rows without id and without words
CLASHING = [
    (5, " ".join(BASE)),
    (5, "quite another text that nobody else has here"),
    (5, "quite another text that nobody else has here"),
    (3, " ".join([*BASE[:-1], "changed"])),
    (9, "quite another text that nobody else has here"),
    (None, " ".join(BASE)),
    (7, ""),
    (7, None),
    (7, ""),
    (8, " \t"),
]


def test_one_id_with_several_texts(make):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(make(CLASHING)).collect())
    assert got == sorted(
        [(5, 56, 3, False), (5, 4, 5, True), (5, 4, 5, True), (3, 56, 3, True), (9, 4, 5, False), (-1, 56, -1, True), (7, 0, 7, True), (7, 0, 7, True), (7, 0, 7, True), (8, 0, 8, True)]
    )


def test_keep_one(spark, make):
    docs = make(CLASHING).selectExpr("*", "1 AS kept_id", "2 AS own_id", "3 AS own_text", "4 AS component")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert got == sorted([(3, CLASHING[3][1]), (5, CLASHING[1][1]), (-1, CLASHING[5][1]), (7, ""), (7, ""), (7, ""), (8, " \t")])
    assert keep_one(docs.limit(0)).count() == 0


def test_other_thresholds(spark):
    """Links from 0.8 on, with bands for that: against brute force over a whole table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert _got(near_duplicates(docs, least=80, bands=64)) == _brute([(r.doc_id, r.text) for r in docs.collect()], 80)
