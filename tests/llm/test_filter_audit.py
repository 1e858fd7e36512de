"""Decision diagrams of filter failures against counting by hand."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tests.llm.conftest import ODD_TEXTS
from turnloom.llm.filter_audit import Diagram, adjacent_swaps, audit_rows, failure_masks, filter_audit


def _plain(names, rows):
    """rows: (mask, good, toxic) of each document of a part."""
    out, shapley = [], Counter()
    for order in permutations(range(len(names))):
        before = set()
        for step, k in enumerate(order, 1):
            bit = lambda m, f: m >> f & 1
            reaches = [r for r in rows if not any(bit(r[0], f) for f in before)]
            gone = [r for r in reaches if bit(r[0], k)]
            fails = sum(bit(r[0], k) for r in rows)
            shapley[k] += len(gone)
            out.append(["".join(names[f] for f in order), step, len(reaches) - len(gone), len(gone), fails - len(gone), sum(r[0] == 1 << k for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), k])
            before.add(k)
    return sorted((*r[:-1], shapley[r[-1]]) for r in out)


def _counted(rows):
    out = {}
    for m, g, t in rows:
        out[m] = tuple(a + b for a, b in zip(out.get(m, (0, 0, 0)), (1, g, t), strict=True))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_swaps_visit_all_orders(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for k in adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


@pytest.mark.parametrize("seed", range(6))
def test_audit_rows(seed):
    rng = random.Random(seed)
    names = "ABCDE"[: rng.choice([1, 2, 3, 5])]
    rows = [(rng.choice([0, rng.randrange(1 << len(names))]), rng.random() < 0.5, rng.random() < 0.1) for _ in range(rng.choice([1, 10, 300]))]
    assert sorted(audit_rows(names, _counted(rows))) == _plain(names, rows)


def test_diagram_shares_and_swaps():
    """Equal subdiagrams are one node; after any swaps the diagram is the one built in that order."""
    diagram = Diagram(5, {0: (7,), 31: (2,), 5: (2,)})
    assert [len(x) for x in diagram.nodes] == [1, 2, 4, 4, 4] and diagram.counts[0] == [(11,)]
    for level in adjacent_swaps(5):
        diagram.swap(level)
        assert diagram.counts[0] == [(11,)] and len(diagram.nodes[0]) == 1
        assert all(len(set(x)) == len(x) for x in diagram.nodes)


def _masks(rows):
    """{doc number: mask} of (id, text)."""
    out = []
    for i, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        conditions = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and any(j is not None and j < i and (x or "") == t for j, x in rows))
        out.append(sum(c << k for k, c in enumerate(conditions)))
    return out


def test_odd(spark, make):
    rows = [*ODD_TEXTS, (10, "Word " * 3000), (11, "a#b " + "words " * 250), (12, "a#b " + "words " * 250), (12, "a#b " + "words " * 250), (None, "one"), (None, None), (-1, "ONE two"), (13, "ONE two"), (14, " ".join(f"w{k}" for k in range(300)) + "| é中"), (15, " ".join(f"W{k}" for k in range(300)))]
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 1), (8, 0, None), (12, 1, 1), (None, 1, 1), (13, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make(rows, extra=True).selectExpr("* except (source)", "CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN '' END AS source")
    got = sorted(map(tuple, filter_audit(failure_masks(docs, labels), "ABCDE").collect()))
    good, toxic = {1, 8, 12}, {8, 12, 13}
    want = []
    for part in ("a", ""):
        own = [(m, i in good, i in toxic) for m, (i, _) in zip(_masks(rows), rows, strict=True) if ("a" if i is not None and i % 3 == 0 else "") == part]
        want += [(part, *r) for r in _plain("ABCDE", own)]
    assert got == sorted(want) and len(got) == 2 * 600
    assert filter_audit(failure_masks(make([]), labels), "ABCDE").count() == 0


def test_names():
    for names in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            filter_audit(None, names)
