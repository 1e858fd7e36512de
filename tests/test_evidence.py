"""Audits that meet in one aggregation, answers from a model, tables of a session, image files."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.operators import audit, hooks, session_tables
from turnloom.sources import pictures, sessions, shared
from turnloom.sources.shared import new_folder, stored


def test_compare_runs(spark):
    schema = "s string, t long, a string, b long"
    original = spark.createDataFrame([("x", 1, "p", 1), ("x", 2, "q", None), ("y", 1, None, 3), ("z", 1, "r", 4), ("w", 1, "o", 1)], schema)
    repeat = [("x", 1, "p", 1, 0), ("x", 2, "q", 5, 0), ("x", 3, "n", 1, 0), ("y", 1, None, 3, 1), ("y", 1, "other", 3, 1), ("w", 1, "o", 1, 7)]
    found = audit.compare_runs(original, spark.createDataFrame(repeat, schema + ", shard long"), ["s", "t"], ["a", "b"], shard=F.when(F.col("s") == "y", 1).otherwise(0))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [("w", 1, "wrong shard"), ("x", 2, "b differs"), ("x", 3, "foreign"), ("y", 1, "a differs"), ("y", 1, "repeated"), ("z", 1, "missing")]
    same = audit.counted(audit.compare_runs(original, original, ["s", "t"], ["a", "b"]), {"coverage": ["missing", "foreign"], "one row": ["repeated"], "same": ["a differs", "b differs"]})
    assert sorted(map(tuple, same.collect())) == [("coverage", 0), ("one row", 0), ("same", 0)]


def test_reconcile(spark):
    jobs = spark.createDataFrame([("receipt", "h1"), ("source", "h2"), ("lost", "h3"), ("early", None), ("none", None), ("bad", None), ("tie", None)], "job string, source string")
    held = [("receipt", "h1", 5), ("receipt", "h2", 1), ("source", "h1", 1), ("source", "h2", 9), ("lost", "h1", 1), ("early", "h2", 3), ("early", "h1", 4), ("bad", "h1", 2), ("tie", "h2", 1), ("tie", "h1", 1)]
    receipts = spark.createDataFrame([("receipt", "h2", True), ("bad", "h2", False)], "job string, receipt_host string, valid boolean")
    got = {r.job: (r.state, r.owner, r.rule, len(r.candidates), r.problem) for r in audit.reconcile(jobs, spark.createDataFrame(held, "job string, host string, at long"), receipts).collect()}
    assert got == {
        "receipt": ("completed", "h2", "receipt", 2, None), "source": ("pending", "h2", "source", 2, None), "lost": ("pending", None, None, 1, "source without inventory"), "early": ("pending", "h2", "earliest", 2, None),
        "none": ("pending", None, None, 0, None), "bad": ("pending", "h1", "earliest", 1, "invalid receipt"), "tie": ("pending", "h1", "earliest", 2, None),
    }


def test_worker_batches(spark):
    assigned = spark.createDataFrame([("b", 0, "ok"), ("b", 0, "twice"), ("b", 1, "twice"), ("b", 1, "extra"), ("b", 1, "short"), ("b", 0, "again")], "batch string, worker long, session string")
    expected = spark.createDataFrame([("b", s) for s in ("ok", "twice", "out", "short", "again")], "batch string, session string")
    done = [("b", w, s, t) for w, s, ts in ((0, "ok", (1, 2, 3)), (0, "twice", (1, 2, 3)), (1, "twice", (1, 2, 3)), (1, "extra", (1, 2, 3)), (1, "short", (1, 3)), (0, "again", (1, 2, 2, 3))) for t in ts]
    found = audit.worker_batches(assigned, expected, spark.createDataFrame(done, "batch string, worker long, session string, turn long"), ["batch"], [1, 2, 3])
    assert sorted((r.session, r.violation) for r in found.collect()) == [("again", "turns differ"), ("extra", "unexpected"), ("out", "omitted"), ("short", "turns differ"), ("twice", "assigned twice")]
    lags = audit.start_lags(spark.createDataFrame([("b", 0, 10.0), ("b", 1, 10.05), ("b", 2, 10.3), ("c", 0, 1.0)], "batch string, worker long, started double"), ["batch"])
    assert {r.batch: (round(r.start_lag, 6), r.late) for r in lags.collect()} == {"b": (0.3, 1), "c": (0.0, 0)}


class _Lengths:
    """A model that can't answer long texts, and counts how often it was made."""

    def __init__(self, most, log):
        self.most = most
        with open(log, "a") as f:
            f.write("made\n")

    def __call__(self, rows):
        kept = rows[rows["text"].str.len() <= self.most]
        return pd.DataFrame({"request": kept["request"], "length": kept["text"].str.len()})


def test_model_hook(spark, tmp_path):
    """Each distinct request is asked once; what stays open is asked in the next run and nothing else; one set-up a task."""
    rows = spark.createDataFrame([(f"r{k % 40}", "x" * (k % 40)) for k in range(200)], "request string, text string").repartition(6)
    store = hooks.AnswerStore(spark, new_folder(spark, "answers"), "request", "length long")
    log = str(tmp_path / "log")
    assert store.run(rows, lambda: _Lengths(29, log), tasks=3) == 10
    assert store.read().count() == 30 and len((tmp_path / "log").read_text().split()) == 3
    assert store.answered(rows).where("length is null").count() == 50
    asked = spark.read.parquet(store.folder).count()
    assert store.run(rows, lambda: _Lengths(99, log), tasks=3) == 0
    assert spark.read.parquet(store.folder).count() == asked + 10 == 40
    assert {(r.request, r.length) for r in store.answered(rows).collect()} == {(f"r{k}", k) for k in range(40)}
    assert store.run(rows.limit(0), lambda: _Lengths(1, log)) == 0


POSITIONS = "session long, position long, masses array<double>, tokens array<long>"


def test_session_tables(spark):
    rows = [(s, p, [0.1 * (g + 1) * (p + 1) for g in range(8)], [4, 4, 0, 0, 2, 2, 8, 12]) for s in (1, 2) for p in range(s + 1)]
    got = {(r.session, r.kind, r["name"]): r for r in session_tables.session_tables(spark.createDataFrame(rows, POSITIONS).repartition(3)).collect()}
    assert len(got) == 2 * 24
    one = got[1, "group", "T2"]
    assert one.mass == pytest.approx(0.2 * 1.5) and one.density == pytest.approx(0.3 / 4) and one.enrichment == pytest.approx(0.3 / (4 / 32)) and one.role is None
    whole = got[2, "category", "history_images"]
    assert whole.mass == pytest.approx((0.5 + 0.6) * 2) and whole.tokens == 4
    empty = got[2, "object", "I0_combined"]
    assert (empty.role, empty.age, empty.tokens, empty.density, empty.null_reason) == ("original_image", 1, 0, None, "structural_zero")
    for s in (1, 2):
        assert sum(r.mass for (k, kind, _), r in got.items() if k == s and kind == "category") == pytest.approx(sum(r.mass for (k, kind, _), r in got.items() if k == s and kind == "group"))
    with pytest.raises(Exception, match="token counts of its positions differ"):
        session_tables.session_tables(spark.createDataFrame([(1, 0, [0.1] * 8, [1] * 8), (1, 1, [0.1] * 8, [2] * 8)], POSITIONS)).collect()


def test_png_files(spark):
    """Files of several shapes are decoded to their pixels; every row filter is used; a second run leaves the same files and no parts."""
    rng = np.random.default_rng(3)
    ramp = np.arange(40 * 30 * 3).reshape(40, 30, 3) // 7 % 256
    pixels = {"noise": rng.integers(0, 256, (5, 9, 3)), "flat": np.full((3, 4, 3), 200), "ramp": ramp, "dot": np.zeros((1, 1, 3)), "columns": np.tile(rng.integers(0, 256, (1, 6, 3)), (6, 1, 1))}
    rows = [(name, p.shape[1], p.shape[0], bytearray(p.astype(np.uint8).tobytes())) for name, p in pixels.items()]
    images = spark.createDataFrame(rows, "name string, width int, height int, rgb binary")
    folder = new_folder(spark, "pictures")
    receipts = [stored(pictures.write_images(images, folder), "receipts") for _ in range(2)][1]
    got = {r.origin.rsplit("/", 1)[1][:-4]: (r.width, r.height, r.pixel_hash) for r in sessions.read_images(spark, f"{folder}/*").collect()}
    assert got == {n: (w, h, hashlib.sha256(f"RGB:{w}:{h}:".encode() + bytes(rgb)).hexdigest()) for n, w, h, rgb in rows}
    files = spark.read.format("binaryFile").load(f"{folder}/*").collect()
    assert len(files) == len(rows) and {(f.length, zlib.crc32(bytes(f.content))) for f in files} == {(r.bytes, r.crc32) for r in receipts.collect()}
    kinds = set()
    for f in files:
        data = bytes(f.content)
        (size,) = struct.unpack(">I", data[33:37])
        width, height = struct.unpack(">II", data[16:24])
        kinds |= set(zlib.decompress(data[41 : 41 + size])[:: 3 * width + 1])
    assert kinds == {0, 1, 2} and math.prod(pixels["flat"].shape) == 36


def test_clear_folders(spark):
    """Only folders that this driver has named go."""
    made = new_folder(spark, "cleared")
    other = f"{shared.shared_folder(spark)}/others-folder"
    for path in (made, other):
        spark.range(3).write.mode("overwrite").parquet(path)
    assert shared.clear_folders(spark) >= 1 and shared.clear_folders(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(made)
    assert spark.read.parquet(other).count() == 3


def test_repeat_audit_moves_little(spark, monkeypatch):
    """Only the keys of the original run are stored; digests are compared as bytes, also those that are no text, and rows are not sorted before they move."""
    from turnloom.plans import audits

    kept = []
    monkeypatch.setattr(audits, "stored", lambda rows, name: kept.append(rows.columns) or stored(rows, name))
    assert audits.j15_repeat_audit(spark, "/root/testdata/sf0.001").count() and kept == [["session", "turn"]]
    schema = "k long, h binary"
    one, two = spark.createDataFrame([(1, b"\xff\x00"), (2, b"\xff\x01"), (3, None)], schema), spark.createDataFrame([(1, b"\xff\x00"), (2, b"\xff\x02"), (3, None)], schema)
    found = audit.compare_runs(one, two, ["k"], ["h"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "cast(h" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(2, "h differs")]


def test_votes_cut_tasks_by_turns(spark, tmp_path):
    """A table of more turns than the tasks at hand are given is dealt to as many tasks as its rows need."""
    from turnloom.plans import base

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    n = rows.count()
    cut = base.turns(spark, str(tmp_path), n // 20)
    assert 20 <= cut.rdd.getNumPartitions() <= 21
    assert cut.exceptAll(base.turns(spark, str(tmp_path))).count() == 0 and cut.count() == n
    assert base.turns(spark, str(tmp_path), n).rdd.getNumPartitions() <= 4
