"""Operator 12: interaction of filters, by decision diagrams of failure masks.

1. Each row's failures are the bits of a mask; rows are counted by part and mask, and so are the good and the toxic ones. A part has at most
   two to the number of filters rows from then on, whatever its share of the table.
2. For each part a decision diagram is built over the masks: a level for each filter, a pass and a fail branch at each node, equal
   subdiagrams shared, and at each node the counts of the rows that come through it.
3. All orders of the filters are visited by swapping two adjacent levels at a time, each swap touching these two levels only. In each
   order the all-pass path gives the steps: the fail branch of its node holds what the step removes, the pass branch what it keeps.

Defined cases: a null text is empty, so it fails A and, if another id below has an empty or null text, E; a null part is the empty string; a
row without id fails E never and has no labels; of rows with one id and text none fails E for another; several labels of one id count
once, as 1 if any of them is 1; an empty table gives no rows; a very long text is one value of a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.storage import materialise

WEIGHTS = ("docs", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
SEPARATORS = r"[\x20\x09-\x0D]+"
#: All orders are visited: 5,040 of 7 filters.
MOST_FILTERS = 7

Weights = tuple[int, ...]


def _sum(a: Weights, b: Weights) -> Weights:
    return tuple(x + y for x, y in zip(a, b, strict=True))


class Diagram:
    """order[l] is the filter (a bit number) of level l; nodes[l] has (pass, fail) of each node, places in level l + 1; counts[l] their counts. The last level holds the leaves."""

    def __init__(self, n_filters: int, counts: dict[int, Weights]):
        none = tuple(0 for _ in next(iter(counts.values())))
        self.order = list(range(n_filters))
        # masks in the order of the levels: the first filter is the leading bit
        leaves = [counts.get(sum((path >> (n_filters - 1 - k) & 1) << k for k in range(n_filters)), none) for path in range(1 << n_filters)]
        self.counts: list[list[Weights]] = [[] for _ in range(n_filters + 1)]
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in range(n_filters)]
        shared = {w: k for k, w in enumerate(dict.fromkeys(leaves))}
        self.counts[n_filters] = list(shared)
        below = [shared[w] for w in leaves]
        for level in range(n_filters - 1, -1, -1):
            pairs = list(zip(below[::2], below[1::2], strict=True))
            place = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
            self._fill(level, list(place))
            below = [place[p] for p in pairs]

    def _fill(self, level: int, nodes: list[tuple[int, int]]) -> None:
        after = self.counts[level + 1]
        self.nodes[level], self.counts[level] = nodes, [_sum(after[p], after[f]) for p, f in nodes]

    def swap(self, level: int) -> None:
        """Exchanges a level with the next. Nodes above keep their places, and so do those of the level itself."""
        lower: dict[tuple[int, int], int] = {}
        upper = []
        for passed, failed in self.nodes[level]:
            (pp, pf), (fp, ff) = self.nodes[level + 1][passed], self.nodes[level + 1][failed]
            upper.append(tuple(lower.setdefault(pair, len(lower)) for pair in ((pp, fp), (pf, ff))))
        self._fill(level + 1, list(lower))
        self.nodes[level] = upper
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Weights, Weights]]:
        """(filter, kept, removed) along the all-pass path."""
        node = 0
        for level, own in enumerate(self.order):
            node, failed = self.nodes[level][node]
            yield own, self.counts[level + 1][node], self.counts[level + 1][failed]

    def failing(self) -> Weights:
        """Counts of the rows that fail the first filter."""
        return self.counts[1][self.nodes[0][0][1]]

    def failing_only(self) -> Weights:
        """Counts of the rows that fail the first filter alone."""
        node = self.nodes[0][0][1]
        for level in range(1, len(self.order)):
            node = self.nodes[level][node][0]
        return self.counts[-1][node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places whose exchange with the next, one after another, leads through all orders of n things: the last goes back and forth through the orders of the others."""
    if n < 2:
        return
    back, inner = True, adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if back else range(n - 1)
        place = next(inner, None)
        if place is None:
            return
        yield place + back
        back = not back


def audit_rows(names: str, counts: dict[int, Weights]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    diagram = Diagram(len(names), counts)
    fails, alone, found = {}, {}, []
    total = [0] * len(names)

    def visit() -> None:
        first = diagram.order[0]
        fails[first], alone[first] = diagram.failing()[0], diagram.failing_only()[0]
        order = "".join(names[k] for k in diagram.order)
        for step, (own, kept, removed) in enumerate(diagram.steps(), 1):
            total[own] += removed[0]
            found.append((order, step, own, kept[0], removed))

    visit()
    for level in adjacent_swaps(len(names)):
        diagram.swap(level)
        visit()
    return [(order, step, kept, removed[0], fails[own] - removed[0], alone[own], removed[1], removed[2], total[own]) for order, step, own, kept, removed in found]


def filter_audit(masks: DataFrame, names: str) -> DataFrame:
    """masks: (part, mask, docs, good, toxic), a row for each part and mask; bit k of a mask: fails the filter names[k]."""
    if not 1 <= len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"names are 1 to {MOST_FILTERS} different letters")

    def audit(group):
        import pandas as pd

        counts = {int(m): tuple(map(int, w)) for m, *w in group[["mask", *WEIGHTS]].itertuples(index=False)}
        rows = [(group["part"].iloc[0], *r) for r in audit_rows(names, counts)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return masks.groupBy("part").applyInPandas(audit, SCHEMA)


def _bits(*conditions: Column) -> Column:
    out = F.lit(0)
    for k, c in enumerate(conditions):
        out = out + F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    return out


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic) for filters A to E of `documents`: few words, few different words, capitals, marks, repeated text."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SEPARATORS), "")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"), F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    # sizes go first into the diagram's bits, so that the words are split once
    light = own.select("doc_id", "part", _bits(F.col("n") < 200, 100 * F.col("d") < 50 * F.col("n"), 100 * capitals > 2 * F.length("t"), F.col("t").rlike(r"[#$%&*|]")).alias("bits"), F.unhex(F.sha2("t", 256)).alias("digest"))
    light = materialise(light, "failures")
    repeated = light.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1").select("digest", "least")
    # a table of its own, so that the join can split a text that very many rows have
    repeated = materialise(repeated, "repeated-texts")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    joined = light.join(repeated, "digest", "left").join(marked, "doc_id", "left")
    mask = F.col("bits") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return joined.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("docs"), count("good"), count("toxic"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marked AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id
), failures AS (
  SELECT part, good, toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marked USING (doc_id)
), cells AS MATERIALIZED (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failures GROUP BY part, mask
), letters(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1 : step - 1]), 0) AS earlier FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)
), counted AS (
  SELECT part, filter_order, step, b,
    coalesce(sum(n) FILTER (WHERE mask & (CAST(earlier AS INT) | b) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & b > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & b > 0 AND mask & CAST(earlier AS INT) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = b), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & b > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & b > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, b
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM counted
"""
