"""Operator 7: MinHash near-duplicate detection with exact links.

1. A task computes each text's set of word shingles, a digest of the set, its minima under many universal hashes, and band keys.
2. Texts of equal sets are one class, found by a grouped minimum over the digest; only classes go on.
3. Classes that share a band key are candidates. Each is first compared with a leader of its bucket; more rounds with other leaders
   skip pairs that the links found so far already connect. What is left is every pair in a bucket that lies in different
   components, compared in blocks of signatures; so no pair that could join two components is left out.
4. Signatures sort out pairs far under the threshold; all others are confirmed on the full sets, read again from the texts.
5. Components by alternating large-star and small-star.

With 32 bands of 8 minima, a pair of similarity 0.85 shares no band with probability 4e-5, one of 0.9 with 2e-8; its estimate from
512 minima falls below `estimate` with probability 4e-6 or less.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer words than a shingle has one
shingle, all its words; equal texts (repeated rows included) are linked; rows of one id with different texts are judged each by its own
text, and have each the least id of its own component; a row without id is linked with nothing (component_id null, kept); ties of leaders go
to the least id, then class number, which changes no result; a very long text is a slice of its own; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.components import connected_components
from turnloom.llm.storage import materialise
from turnloom.llm.textops import Words, mix, shingles, slices, unique_sets, utf8_of

BLOCK = 512
PAIRS_PER_TASK = 2000
WORD = r"[^\x20\x09-\x0D]"
SKETCH_SCHEMA = "doc_id long, text_key long, n_shingles long, set_digest binary, bands array<long>, signature binary"


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(flat: np.ndarray, first: np.ndarray, n_hashes: int) -> np.ndarray:
    """(sets, n_hashes) least hash values; sets must not be empty."""
    a, b = hash_family(n_hashes)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n_hashes, len(first) - 1), dtype=np.uint32)
    h = np.empty_like(x)
    for k in range(n_hashes):
        np.multiply(x, a[k], out=h)
        np.add(h, b[k], out=h)
        np.minimum.reduceat(h, first[:-1], out=out[k])
    return out.T


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key + parts[:, :, r] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(r))
    return key.view(np.int64)


def text_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    values, owner = shingles(Words(data, offsets), words)
    return unique_sets(values, owner, len(offsets) - 1)


def _sketcher(words: int, bands: int, rows: int, hashes: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column("text"))
            for i, j in slices(offsets, 1 << 20):
                flat, first = text_sets(data, offsets[i : j + 1], words)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                keys, small = np.zeros((0, bands), dtype=np.int64), np.zeros((0, hashes), dtype=np.uint8)
                if len(full):
                    least = minima(flat, np.append(first[full], first[-1]), hashes)
                    keys, small = band_keys(least[:, : bands * rows], bands, rows), (least >> np.uint32(24)).astype(np.uint8) ^ least.astype(np.uint8)
                digest, signature, at = [], [], 0
                for k in range(j - i):
                    digest.append(hashlib.blake2b(flat[first[k] : first[k + 1]].tobytes(), digest_size=16).digest())
                    signature.append(small[at].tobytes() if sizes[k] else b"")
                    at += sizes[k] > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * bands)]), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(signature, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "set_digest", "bands", "signature"],
                )

    return sketch


def _alike(batches: Iterator[pa.RecordBatch], estimate: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least that share of places."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("signature_a", "signature_b"))
            batch = batch.filter(pa.array((one == two).mean(axis=1) >= estimate))
        yield batch.select(["a", "b"])


def _block_pairs(estimate: float, least: int, most: int):
    def compare(left, right):
        """Pairs whose first common band is this bucket's, so that each is found in one bucket; of two rows outside the largest component, from the greater number."""
        import pandas as pd

        found = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
        if len(left) and len(right):
            key = left["key_"].iloc[0]
            one, two = (np.frombuffer(b"".join(x), dtype=np.uint8).reshape(len(x), -1) for x in (left["signature_"], right["signature"]))
            bands_one, bands_two = np.stack(left["bands_"]), np.stack(right["bands"])
            ids, sizes, component, outside = (right[c].to_numpy() for c in ("node", "n", "component", "outside"))
            for i, (node, n, own) in enumerate(zip(left["node_"], left["n_"], left["component_"], strict=True)):
                near = np.flatnonzero((component != own) & (most * sizes >= least * n) & (most * n >= least * sizes) & (~outside | (ids < node)))
                shared = bands_two[near] == bands_one[i]
                near = near[bands_one[i][shared.argmax(axis=1)] == key]
                near = near[(two[near] == one[i]).mean(axis=1) >= estimate]
                if len(near):
                    found.append(pd.DataFrame({"a": np.maximum(ids[near], node), "b": np.minimum(ids[near], node)}))
        return pd.concat(found)

    return compare


def _confirmer(words: int, least: int, most: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (b, salt, a), first b's own text with a null; one set of b is held."""
        held = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            data, offsets = utf8_of(batch.column("text"))
            a = batch.column("a").to_pylist()
            b = batch.column("b").to_pylist()
            out: list[tuple[int, int]] = []
            for i, j in slices(offsets, 1 << 20):
                flat, first = text_sets(data, offsets[i : j + 1], words)
                for k in range(i, j):
                    own = flat[first[k - i] : first[k - i + 1]]
                    if a[k] is None:
                        held = own
                        continue
                    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    common = int((held[at] == own).sum()) if len(held) else 0
                    if common and most * common >= least * (len(held) + len(own) - common):
                        out.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return confirm


class NearDuplicates:
    """least / most is the similarity from which two texts are linked, as a fraction of whole numbers."""

    def __init__(self, docs: DataFrame, words: int = 5, least: int = 85, most: int = 100, bands: int = 32, rows: int = 8, hashes: int = 512, estimate: float | None = None, leader_rounds: int = 1, salt_pairs: int = 512, id_col: str = "doc_id", text_col: str = "text"):
        self.words, self.least, self.most, self.bands, self.rows, self.hashes = words, least, most, bands, rows, hashes
        share = least / most
        self.estimate = share - 4.5 * (share * (1 - share) / hashes) ** 0.5 if estimate is None else estimate
        self.leader_rounds, self.salt_pairs = leader_rounds, salt_pairs
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def _sketches(self) -> DataFrame:
        return self.docs.mapInArrow(_sketcher(self.words, self.bands, self.rows, self.hashes), SKETCH_SCHEMA)

    def _candidates(self, classes: DataFrame, bucketed: DataFrame) -> DataFrame:
        """(node, n, bands, signature, text) of the classes that share a band key: all that later steps read. The texts are dealt out by id once."""
        wanted = classes.drop("set_digest").join(bucketed.select("node").distinct().hint("merge"), "node")
        texts = self.docs.dropna(subset=["doc_id"])
        found = texts.join(wanted.hint("merge"), ["doc_id", "text_key"]).select("node", "n", "bands", "signature", "text")
        return materialise(found.dropDuplicates(["node"]), "candidates")

    def _confirmed(self, pairs: DataFrame, candidates: DataFrame) -> DataFrame:
        """Links among distinct pairs (a > b): by signature, then on full sets. A node's pairs are dealt over as many tasks as their number asks for."""
        signed = candidates.select("node", "signature")
        near = pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("signature_a")), "a").join(signed.select(F.col("node").alias("b"), F.col("signature").alias("signature_b")), "b")
        estimate = self.estimate
        near = materialise(near.select("a", "b", "signature_a", "signature_b").mapInArrow(lambda it: _alike(it, estimate), "a long, b long"), "near-pairs")
        hot = near.groupBy("b").agg(F.ceil(F.count("*") / self.salt_pairs).alias("salts")).where("salts > 1")
        salted = near.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).alias("salt"))
        wanted = salted.select(F.col("a").alias("node"), "a", "b", "salt").unionByName(salted.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("a"), "b", "salt").distinct())
        texts = wanted.join(candidates.select("node", "text"), "node").select("b", "salt", "a", "text")
        # the work of a pair is large next to its bytes, so the number of tasks follows the pairs
        tasks = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), near.count() // PAIRS_PER_TASK)
        dealt = texts.repartition(tasks, F.col("b"), F.col("salt")).sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
        return materialise(dealt.mapInArrow(_confirmer(self.words, self.least, self.most), "a long, b long").distinct(), "confirmed")

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(membership, classes): (doc_id, n_shingles, set_digest) of each row; and of each distinct set its number, its least row and sketches.

        The numbers are given while the table is written, so later reads agree on them.
        """
        sketches = materialise(self._sketches(), "sketches")
        sets = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("set_digest")
        least = sets.agg(F.min(F.struct("doc_id", "text_key")).alias("own"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        classes = least.select(F.monotonically_increasing_id().alias("node"), "own.doc_id", "own.text_key", "set_digest", "n", "bands", "signature")
        return sketches.select("doc_id", "n_shingles", "set_digest"), materialise(classes, "classes")

    def components(self, classes: DataFrame) -> DataFrame:
        """(node, component) of every class that is linked with another."""
        keyed = classes.select("node", "doc_id", "n", F.explode("bands").alias("key"))
        shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "shared-keys")
        bucketed = materialise(keyed.join(shared.hint("merge"), "key"), "buckets")
        candidates = self._candidates(classes, bucketed)
        found = components = tried = None
        for turn in range(self.leader_rounds):
            members = bucketed if components is None else self._open_buckets(bucketed, components)
            if components is not None and members.isEmpty():
                return components
            # the least id first: it is often the text that the others were made from
            order = F.col("doc_id") if components is None else F.xxhash64("node", F.lit(turn))
            rank = F.struct(order.alias("at"), *[c for c in ("node", "n", "component") if c in members.columns])
            leaders = materialise(members.groupBy("key").agg(F.min(rank).alias("lead")), "leaders")
            pairs = members.join(leaders, "key").where(F.col("node") != F.col("lead.node"))
            if components is not None:
                pairs = pairs.where(F.col("component") != F.col("lead.component"))
            pairs = pairs.where((F.col("n") * self.most >= F.col("lead.n") * self.least) & (F.col("lead.n") * self.most >= F.col("n") * self.least))
            pairs = pairs.select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = materialise(pairs, "leader-pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
            links = self._confirmed(pairs, candidates)
            found = links if found is None else found.unionByName(links)
            components = materialise(connected_components(found), "components")
        members = self._open_buckets(bucketed, components)
        if members.isEmpty():
            return components
        rest = self._confirmed(materialise(self._rest(members, candidates).join(tried, ["a", "b"], "left_anti"), "rest-pairs"), candidates)
        return components if rest.isEmpty() else connected_components(found.unionByName(rest))

    def _open_buckets(self, bucketed: DataFrame, components: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        known = materialise(bucketed.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
        several = materialise(known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "open-keys")
        return materialise(known.join(several, "key"), "open-buckets")

    def _rest(self, members: DataFrame, candidates: DataFrame) -> DataFrame:
        """Pairs of one bucket in different components that may pass: members outside the bucket's largest component against all, in blocks."""
        sizes = members.groupBy("key", "component").agg(F.count("*").alias("c"))
        largest = materialise(sizes.groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("largest"), F.sum("c").alias("all"), F.max("c").alias("most")), "bucket-sizes")
        blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
        joined = members.join(largest, "key").join(candidates.select("node", "bands", "signature"), "node")
        joined = joined.withColumns({"n_right": blocks(F.col("all")), "n_left": blocks(F.col("all") - F.col("most")), "outside": F.col("component") != F.col("largest")})
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = joined.where("outside").withColumn("l", own("n_left")).withColumn("r", every("n_right"))
        right = joined.withColumn("r", own("n_right")).withColumn("l", every("n_left"))
        columns = ["key", "l", "r", "node", "n", "component", "outside", "bands", "signature"]
        # new names on one side, as both come from one table
        left = left.select(*[F.col(c).alias(f"{c}_") for c in columns]).groupBy("key_", "l_", "r_")
        pairs = left.cogroup(right.select(*columns).groupBy("key", "l", "r"))
        return pairs.applyInPandas(_block_pairs(self.estimate, self.least, self.most), "a long, b long").distinct()

    def labelled(self, classes: DataFrame) -> DataFrame:
        """(set_digest, doc_id, text_key, component) of every class, with its least row."""
        joined = classes.select("set_digest", "node", "doc_id", "text_key").join(self.components(classes), "node", "left")
        return materialise(joined.select("set_digest", "doc_id", "text_key", F.coalesce("component", "node").alias("component")), "labelled-classes")

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) of every row."""
        membership, classes = self.classes()
        labelled = self.labelled(classes)
        least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = materialise(labelled.join(least, "component").select("set_digest", "component_id"), "named-classes")
        # rows without words, or without id, are past the join: they would all meet in one key
        grouped = F.col("n_shingles") > 0
        inside = membership.where(grouped & F.col("doc_id").isNotNull()).join(named, "set_digest").select("doc_id", "n_shingles", "component_id")
        outside = membership.where(~grouped | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return inside.unionByName(outside).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    def representatives(self) -> DataFrame:
        """(doc_id, text_key) of the least row of each component."""
        _, classes = self.classes()
        return self.labelled(classes).groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("own")).select("own.doc_id", "own.text_key")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(docs, **options).result()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, but one of each component: that of the least id. Rows without words or without id stay."""
    taken = {c.lower() for c in docs.columns}
    names = [next(f"{stem}{'_' * k}" for k in range(len(taken) + 1) if f"{stem}{'_' * k}" not in taken) for stem in ("own_id", "own_text")]
    own = NearDuplicates(docs, id_col=id_col, text_col=text_col, **options).representatives().toDF(*names)
    keyed = docs.withColumns({names[0]: F.col(id_col).cast("long"), names[1]: F.xxhash64(text_col)})
    grouped = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)) & F.col(names[0]).isNotNull()
    first = keyed.where(grouped).join(own, names, "left_semi").dropDuplicates(names)
    return first.unionByName(keyed.where(~grouped)).drop(*names)
