"""Values worked out by hand, rules with counterexamples, readers of self-made files."""

import hashlib
import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import boxes, digest, parsing
from turnloom.functions import distributions as d
from turnloom.operators import history, ranking, rules, statistics, typed
from turnloom.sources import sessions, shared
from turnloom.streaming import logs


def _concentration(spark, *supports):
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(supports)], "position long, x array<double>")
    return [r.asDict() for r in d.concentration(df).orderBy("position").collect()]


def test_concentration(spark):
    uniform, point, two, single, zero, four = _concentration(spark, [0.05] * 10, [0, 0, 0.6, 0], [0.9, 0.1], [1.0], [0.0, 0.0], [8, 1, 1, 0])
    assert uniform["entropy_nats"] == pytest.approx(math.log(10)) and uniform["effective_count"] == pytest.approx(10) and uniform["top3_share"] == pytest.approx(0.3) and uniform["n90"] == 9
    assert point["entropy_nats"] == 0 and point["n90"] == 1 and point["effective_fraction"] == 0.25
    assert two["n90"] == 1
    assert single["normalized_entropy"] is None and single["entropy_nats"] == 0 and single["n90_fraction"] == 1
    assert zero["support_mass"] == 0 and all(v is None for k, v in zero.items() if k not in ("position", "x", "support_mass"))
    assert four["top10pct_share"] == pytest.approx(0.8) and four["n90_fraction"] == 0.5


def test_distances(spark):
    row = spark.createDataFrame([([0.8, 0.1, 0.1, 0.0], [0.25] * 4, [1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>, c array<double>, e array<double>")
    got = row.select(
        d.total_variation("a", "b").alias("tv"), d.jensen_shannon("c", "e").alias("js"), d.top_overlap("b", "b", 2).alias("same"), d.top_places("b", 2).alias("places"), d.argmax_place("c").alias("arg"),
        d.argmax_place(F.array(F.lit(0.0), F.lit(0.0))).alias("none"), d.cosine("c", "e").alias("cos"),
    ).first()
    assert got.tv == pytest.approx(0.55) and got.js == pytest.approx(math.log(2)) and got.same == 1 and got.places == [0, 1] and got.arg == 0 and got.none == -1 and got.cos == 0


def test_means(spark):
    rows = spark.createDataFrame([(1, 0.9, 1.0), (2, 0.1, 9.0)], "k long, s double, m double")
    got = statistics.pooled_and_equal(rows, [], "s", "m").first()
    assert got.record_equal == 0.5 and got.amount_weighted == pytest.approx(0.18)
    sessions_ = spark.createDataFrame([("s1", "x", 0.0), ("s2", "x", 0.0), ("s3", "y", 1.0)], "session string, cluster string, v double")
    drawn = statistics.draws(sessions_.select("cluster").distinct(), "cluster", 400, 1)
    ends = statistics.bootstrap_interval(sessions_, [], "v", "cluster", drawn).first()
    assert (ends.ci_low, ends.ci_high) == (0.0, 1.0)
    assert drawn.groupBy("rep").agg(F.sum("weight").alias("w")).where("w <> 2").count() == 0


def test_cumulative_and_judges(spark):
    rows = spark.createDataFrame([("s", j, t, "ok", v) for j, vs in (("a", (1.0, 0.0, 1.0)), ("b", (1.0, 1.0, 1.0))) for t, v in enumerate(vs, 1)], "session string, judge string, turn long, status string, score double")
    running = typed.cumulative_minimum(rows, ["session", "judge"]).select("session", "turn", "judge", F.col("cum_status").alias("status"), F.col("cum_score").alias("score"))
    got = typed.judge_mean(running, ["session", "turn"], ("a", "b")).orderBy("turn").collect()
    assert [r.score for r in got] == [1.0, 0.5, 0.5]
    broken = spark.createDataFrame([("s", 1, "ok", 1.0), ("s", 2, "pending_review", None), ("s", 3, "response_incomplete", None), ("s", 4, "ok", 1.0)], "session string, turn long, status string, score double")
    aware = typed.cumulative_minimum(broken, ["session"], pending_aware=True).orderBy("turn").collect()
    assert [r.cum_status for r in aware] == ["ok", "pending_review", "response_incomplete", "response_incomplete"]
    assert [r.unresolved for r in aware] == ["", "2", "2,3", "2,3"] and [r.cum_score for r in aware] == [1.0, None, None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [("yes", "yes"), ("No.", "no"), ("**Yes**", "yes"), ("No, it is absent.", "no"), ("Therefore, the final answer is YES", "yes"), ("The answer is: yes", None), ("thus no", "no"), ("yes\nno", None), ("it may be yes", None), ("", None), ("I say\nAnswer: `no`", "no")],
)
def test_decision(spark, text, want):
    assert spark.range(1).select(parsing.decision(F.lit(text)).alias("a")).first().a == want


@pytest.mark.parametrize(
    ("ids", "values", "final", "turns", "score"),
    [((1, 2), ("yes", "yes"), ("yes",), 2, 1.0), ((1, 2), ("yes", "no"), ("no",), 3, 0.0), ((1,), ("yes",), ("yes",), 2, None), ((1, 2), ("no", "no"), ("no",), 2, None), ((2, 3), ("yes", "no"), ("no",), 3, None), ((1,), ("no",), ("no", "no"), 1, None), ((), (), ("yes",), 1, None)],
)
def test_verdict(spark, ids, values, final, turns, score):
    text = "".join(f"<answer_turn_{i}>{v}</answer_turn_{i}>" for i, v in zip(ids, values, strict=True)) + "".join(f"<answer_final> {f} </answer_final>" for f in final)
    got = spark.range(1).select(parsing.verdict(F.lit(text), F.lit(turns)).alias("v")).first().v
    assert got.score == score and (got.status == "ok") == (score is not None)


def test_instructions(spark):
    cases = [
        ("subject_add", "Add [cat] on the [left] of [dog]", ["cat", "left", "dog"]),
        ("subject_add", "Add [cat]", ["cat"]),
        ("background_change", "Change the background to sea, remain the cat,dog unchanged", ["sea", "cat", "dog"]),
        ("background_change", "Change the background to [sea]", ["sea"]),
        ("text_change", "Replace the text '[a]' on [sign] with '[b]'", ["a", "sign", "b"]),
        ("subject_remove", "Take [cat]", None),
        ("unknown", "Remove [cat]", None),
    ]
    rows = spark.createDataFrame([(t, x) for t, x, _ in cases], "task string, text string")
    assert [r.p for r in rows.select(parsing.parse_instruction("task", "text").alias("p")).collect()] == [p for _, _, p in cases]
    words = spark.createDataFrame([("boxes",), ("cats",), ("fish",)], "w string")
    assert [r.s for r in words.select(parsing.singular("w").alias("s")).collect()] == ["box", "cat", "fish"]


def test_boxes(spark):
    a, b, c = [0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 0.9], [0.5, 0.0, 1.5, 1.0]
    got = spark.createDataFrame([(a, b, c)], "a array<double>, b array<double>, c array<double>").select(
        boxes.iou(F.col("a"), F.col("b")).alias("ab"), boxes.iou(F.col("a"), F.col("c")).alias("ac"), boxes.count_distinct_boxes(F.array("a", "b", "c", "a")).alias("n"), boxes.count_distinct_boxes(F.slice(F.array("a"), 1, 0)).alias("z")
    ).first()
    assert got.ab == pytest.approx(0.9) and got.ac == pytest.approx(1 / 3) and got.n == 2 and got.z == 0


def test_rules(spark):
    left, right, far = [0.0, 0.0, 0.2, 0.2], [0.8, 0.0, 1.0, 0.2], [0.8, 0.8, 1.0, 1.0]
    none = []
    cases = [
        ("subject_remove", "Remove [cat]", "", [left], none, none, none, [none], 1.0),
        ("subject_remove", "Remove [cat]", "", [left], none, [left], none, [none], 0.0),
        ("subject_remove", "Remove [cat]", "", [left], none, [far], none, [none], 1.0),
        ("subject_remove", "Remove [cat]", "", none, none, none, none, [none], 0.0),
        ("subject_add", "Add [cat] on the [left] of [dog]", "yes", none, [right], [left], none, [none], 1.0),
        ("subject_add", "Add [cat] on the [right] of [dog]", "yes", none, [right], [left], none, [none], 0.0),
        ("subject_replace", "Replace [cat] with [dog]", "yes", [left], none, none, [left], [none], 1.0),
        ("subject_replace", "Replace [cat] with [dog]", "no", [left], none, none, [left], [none], 0.0),
        ("count_change", "Change the count of [cat] to [2]", "", [left], none, [left, right, left], none, [none], 1.0),
        ("count_change", "Change the count of [cat] to [two]", "", [left], none, [left, right], none, [none], None),
        ("position_change", "Change the position of [cat] to [left] of [dog]", "", [right], [left], [left], [right], [none], 1.0),
        ("position_change", "Change the position of [cat] to [left] of [dog]", "", [right], [left, far], [left], [right], [none], 0.0),
        ("text_change", "Add text '[Hello]' on the image", "says hello", none, none, none, none, [none], 1.0),
        ("background_change", "Change the background to [sea]", "yes", none, none, none, none, [[left]], 1.0),
        ("background_change", "Change the background to [sea]", "yes", none, none, none, none, [[[0.0, 0.0, 1.0, 1.0]]], 0.0),
    ]
    box = "array<array<double>>"
    df = spark.createDataFrame([c[:8] for c in cases], f"task string, instruction string, answer string, src_one {box}, src_two {box}, dst_one {box}, dst_two {box}, dst_kept array<{box}>")
    assert [r.score for r in rules.rule_score(df).collect()] == [c[8] for c in cases]


def test_digests(spark):
    text = 'a"b\\c\né'
    row = spark.range(1).select(digest.json_object({"b": digest.json_text(F.lit(text)), "a": F.lit("1")}).alias("j"), digest.seed63(F.lit("f" * 64)).alias("s")).first()
    assert row.j == json.dumps({"a": 1, "b": text}, sort_keys=True, ensure_ascii=False) and row.s == (1 << 63) - 1


def test_history(spark):
    row = spark.createDataFrame([(["one", "two"],)], "i array<string>").select(history.history_segments(F.col("i")).alias("s")).select("s", history.render("s").alias("r"), history.prefix_length("s").alias("n")).first()
    assert row.r == "[IMAGE_0]one\n\n[IMAGE_1]\n\ntwo" and row.n == 6 and [s.role for s in row.s][6:] == ["label", "current"]


def test_halves_and_windows(spark):
    clusters = spark.range(101).select(F.col("id").cast("string").alias("c"))
    split = ranking.halves(clusters.union(clusters), "c", "x").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"discovery": 50, "confirmation": 51}
    cells = spark.createDataFrame([(s, y, float(s == 2)) for s in range(4) for y in range(4)], "step int, layer int, value double")
    means = ranking.window_means(cells, [], 3, 4, 4, 4).collect()
    assert {(r.step0, r.layer0): (r.mean, r.n) for r in means} == {(0, 0): (1 / 3, 12), (1, 0): (1 / 3, 12)}


def _lines(folder, name, rows):
    (folder / name).mkdir(parents=True)
    (folder / name / "part.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")


def test_json_readers(spark, tmp_path):
    good = {"image": "a.png", "instruction": ["1", "2", "3"]}
    _lines(tmp_path / "m", "cm", [good, good | {"image": "b.png", "instruction": ["1", " ", "3"]}, good | {"image": "c.png", "instruction": ["1"]}, good | {"image": "../d.png"}])
    _lines(tmp_path / "m", "cu", [good, good])
    rows, bad = sessions.read_three_turns(spark, str(tmp_path / "m"))
    assert [r.session_id for r in rows.collect()] == ["cm/a"]
    assert sorted((r.split, r.reason) for r in bad.collect()) == [("cm", "bad image path"), ("cm", "blank instruction"), ("cm", "not three turns"), ("cu", "repeated id"), ("cu", "repeated id")]
    _lines(tmp_path / "v", "x", [{"id": "1", "turn1": "a", "turn2": "b"}, {"id": "2", "turn1": "a", "turn3": "c"}, {"id": "3", "turn1": "a"}])
    rows, bad = sessions.read_variable_turns(spark, str(tmp_path / "v"))
    assert [r.instructions for r in rows.collect()] == [["a", "b"]] and sorted(r.reason for r in bad.collect()) == ["fewer than two turns", "gap in turns"]


def test_prefix_csv_and_zip(spark, tmp_path):
    lines = ["image_index,turns,instructions"]
    for i, chain in ((4, ["a, b", 'say "x"', "c\nd"]), (5, ["p", "q", "r"])):
        for k in (3, 1, 2):
            own = chain[:k] if (i, k) != (5, 2) else ["other", "q"]
            lines.append(f'{i},{k},"' + repr(own).replace('"', '""') + '"')
    lines += ['07,1,"[\'a\']"', '8,1,"not a list"']
    (tmp_path / "p.csv").write_text("\n".join(lines))
    rows, bad = sessions.read_prefix_csv(spark, str(tmp_path / "p.csv"))
    assert [(r.sample_id, r.instructions) for r in rows.collect()] == [("4", ["a, b", 'say "x"', "c\nd"])]
    assert {r.sample_id: r.reason for r in bad.collect()} == {"5": "prefixes in conflict", "07": "bad id", "8": "bad literal"}
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        z.writestr("4_input_raw.jpg", b"123")
        z.writestr("unused.jpg", b"1")
    members = sessions.read_zip_members(spark, str(tmp_path / "i.zip"))
    assert {r.member: (r.size, r.copies) for r in members.collect()} == {"4_input_raw.jpg": (3, 1), "unused.jpg": (1, 1)}
    wanted = spark.createDataFrame([("csv/4", "4"), ("csv/9", "9")], "session_id string, sample_id string")
    assert [(r.session_id, r.reason) for r in sessions.zip_coverage(wanted, members, F.concat("sample_id", F.lit("_input_raw.jpg"))).collect()] == [("csv/9", "missing member")]


def test_arrays_and_run_tree(spark, tmp_path):
    x = np.arange(2 * 3 * 2 * 4, dtype=np.float32).reshape(2, 3, 2, 4)
    buffer = io.BytesIO()
    np.savez(buffer, wanted=x, other=np.zeros(3))
    (tmp_path / "s.npz").write_bytes(buffer.getvalue())
    got = {(r.step, r.layer, r["head"]): r["values"] for r in sessions.read_arrays(spark, str(tmp_path / "s.npz"), "wanted").collect()}
    assert len(got) == 12 and got[1, 2, 0] == x[1, 2, 0].tolist()
    (tmp_path / "run" / "s1").mkdir(parents=True)
    (tmp_path / "run" / "s1" / "session.json").write_text(json.dumps({"session_id": "s1"}, indent=1))
    for k in (1, 2):
        (tmp_path / "run" / "s1" / f"turn_{k}.json").write_text(json.dumps({"turn": k}, indent=1))
    own, turns = sessions.read_run_tree(spark, str(tmp_path / "run"), "session_id string", "turn long")
    assert [tuple(r) for r in own.collect()] == [("s1", "s1")] and sorted(tuple(r) for r in turns.collect()) == [("s1", 1, 1), ("s1", 2, 2)]


def test_images(spark, tmp_path):
    import hashlib
    import struct
    import zlib

    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (row,) = sessions.read_images(spark, str(tmp_path)).collect()
    assert (row.width, row.height) == (3, 2) and row.pixel_hash == hashlib.sha256(b"RGB:3:2:" + rgb.tobytes()).hexdigest()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan"))], "k long, v double")
    with pytest.raises(Exception, match="not finite"):
        sessions.write_tables([rows], str(tmp_path / "t"))
    sessions.write_manifest(rows, str(tmp_path / "m"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sessions.write_manifest(rows, str(tmp_path / "m"))


def test_gate_stays_open_over_a_gap(spark, tmp_path):
    """Turns arrive over several files; a session with a gap is not sent."""
    for k, turns in enumerate([[("a", 0), ("b", 0)], [("a", 2), ("b", 2)], [("a", 1), ("a", 1)]]):
        spark.createDataFrame(turns, "s string, turn long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = logs.drain(logs.session_gate(logs.stream_of(spark, str(tmp_path / "in")), "s", 3), "gate-test").collect()
    assert [tuple(r) for r in got] == [("a", 3)]


def test_first_answers_within(spark, tmp_path):
    spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "c", 12)], "k long, v string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    got = logs.drain(logs.first_answers_within(logs.stream_of(spark, str(tmp_path / "in")), ["k"], "ts", "1 hour").select("k"), "within-test")
    assert sorted(r.k for r in got.collect()) == [1, 2]


def test_quantiles_against_sorted_values(spark):
    """Exact quantiles and trimmed means: ties, negative values, zeros, very different sizes, nulls, one value, and a group without any."""
    rng = random.Random(3)
    groups = {
        "mixed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(501)] + [0.0] * 7,
        "ties": [float(rng.randint(0, 4)) for _ in range(200)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "none": [],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double").withColumn("c", F.lit(1))
    got = {r.g: r for r in statistics.describe(rows, ["g"], "v", "c").collect()}
    trimmed = {r.g: r for r in statistics.trimmed_mean(rows, ["g"], "v").collect()}
    for g, vs in groups.items():
        assert got[g].n_total == len(vs) + 1 and got[g].n_valid == len(vs)
        if not vs:
            assert got[g].p50 is None and g not in trimmed
            continue
        ordered, cut = sorted(vs), int(len(vs) * 0.05)
        for q in statistics.QUANTILES:
            place = (len(ordered) - 1) * q
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            assert got[g][f"p{round(q * 100)}"] == pytest.approx(low + (high - low) * (place - math.floor(place)), rel=1e-9, abs=1e-12)
        kept = ordered[cut : len(ordered) - cut]
        assert trimmed[g].n == len(kept) and trimmed[g]["mean"] == pytest.approx(sum(kept) / len(kept), rel=1e-6, abs=1e-3)
    whole = statistics.describe(rows, [], "v", "c").first()
    assert whole.n_valid == sum(map(len, groups.values())) and whole.n_clusters == 1


def test_greedy_cover(spark):
    """Tags first, most new first, ties by digest; then predicates that nobody chosen meets."""
    rows = [(1, ["a"], "x", False), (2, ["a", "b"], "x", False), (3, ["c"], "x", False), (4, ["c"], "x", True), (5, ["a"], "y", False)]
    items = spark.createDataFrame(rows, "id long, tags array<string>, split string, odd boolean")
    first = min((3, 4), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    assert ranking.greedy_cover(items, "id", "tags") == [2, first]
    chosen = ranking.greedy_cover(items, "id", "tags", [F.col("split") == "x", F.col("split") == "y", F.col("odd")])
    assert chosen == [2, first, 5] + ([4] if first == 3 else [])
    assert ranking.greedy_cover(items.limit(0), "id", "tags") == []


def test_detection_requests(spark):
    """Each rule's requests as (image, object, threshold, all boxes, large boxes dropped), by hand."""
    forms = {
        "subject_add": ("Add [cat] on the [left] of [dog]", [("before", "dog", 0.3, True, False), ("after", "cat", 0.3, True, False)]),
        "subject_remove": ("Remove [cat]", [("before", "cat", 0.35, False, True), ("after", "cat", 0.35, False, True)]),
        "subject_replace": ("Replace [boxes] with [cars]", [("before", "box", 0.3, True, False), ("after", "car", 0.3, True, False)]),
        "color_alter": ("Change the color of [cat] to [red]", []),
        "text_change": ("Replace the text '[a]' on [sign] with '[b]'", [("before", "sign", 0.3, False, False)]),
        "position_change": ("Change the position of [cat] to [left] of [cat]", [("before", "cat", 0.4, True, False), ("after", "cat", 0.4, True, False)]),
        "count_change": ("Change the count of [cat] to [2]", [("before", "cat", 0.3, False, False), ("after", "cat", 0.3, True, False)]),
        "background_change": ("Change the background to sea, remain the cat,dog,cat unchanged", [("after", "cat", 0.25, False, False), ("after", "dog", 0.25, False, False)]),
    }
    rows = [(k, task, text) for k, (task, (text, _)) in enumerate(forms.items())] + [(90, "subject_add", "Add [cat]"), (91, "text_change", "Add text '[b]' on the image"), (92, "count_change", "Change the count of [cat] to [two]"), (93, "background_change", "Change the background to [sea]")]
    parsed = spark.createDataFrame(rows, "id long, task string, instruction string").withColumn("parts", parsing.parse_instruction("task", "instruction"))
    needed = rules.detection_requests(parsed.withColumn("valid", parsing.valid_instruction("task", "parts")))
    got = {}
    for r in needed.collect():
        got.setdefault(r.id, []).append(tuple(r.need))
    assert {k: sorted(v) for k, v in got.items()} == {**{k: sorted(want) for k, (_, want) in enumerate(forms.values()) if want}, 90: [("after", "cat", 0.3, True, False)]}
    found = spark.createDataFrame([(90, "after", "cat", 0.3, True, False, [[0.1, 0.1, 0.2, 0.2]])], "id long, image string, object string, threshold double, all_boxes boolean, drop_large boolean, boxes array<array<double>>")
    answered = {(r.id, r.image, r.object): r.boxes for r in rules.requested_detections(needed, found, ["id"]).collect()}
    assert answered[90, "after", "cat"] == [[0.1, 0.1, 0.2, 0.2]] and answered[1, "before", "cat"] is None


def test_shared_folder(spark):
    """A session on a cluster without a shared folder is refused."""

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        shared.new_folder(Cluster(), "x")
    assert shared.new_folder(spark, "x") != shared.new_folder(spark, "x")
