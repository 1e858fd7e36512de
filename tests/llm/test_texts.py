"""Chat formatting, licences, media columns, classifiers, language model and decontamination on small tables."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.conftest import ODD_TEXTS
from turnloom.llm import chat, decontaminate, language_model, licences, media, quality, registry, toxicity
from turnloom.llm.textops import utf8_of

TURNS = "conv_id long, turn long, role string, text string"


# -- 4: chat formatting


def _digests(turns):
    by = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        all_text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        out[c] = (len(own), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    nasty = ["", "a\\", "\\<|im_end|>", "<|im_sep|>", "</s>[INST] ok [/INST]", "<\\|x", "<", "|im_end|>", "\\\\<|", "é中\n", "$1 \\1", None, "<<|im_start|>"]
    rows = [(1, k, ("user", "assistant", None, "tool\n<|im_body|>")[k // 2 % 4], x) for k, x in enumerate(nasty)]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "a"), (2, None, "user", "first"), (2, 0, "assistant", "x"), (None, 1, "user", "no id")]
    formatted = chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", turns int"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert got == _digests(rows)
    for r in formatted.collect():
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)
        at, loss = 0, ""
        for m in r.loss_mask:
            loss += r.formatted[at : at + m.chars] if m.in_loss else ""
            at += m.chars
        assert "<|im_start|>" not in loss
    merged = {r.conv_id: r.formatted for r in formatted.collect()}[2]
    assert merged.count("<|im_start|>") == 2 and merged.count("<|im_sep|>") == 2


def test_chat_mask_is_the_texts(spark):
    """What the mask cuts out is each assistant text, escaped, and nothing between them."""
    rows = [(1, 0, "user", "Q"), (1, 1, "assistant", "A1"), (1, 2, "assistant", "B<|2"), (1, 3, "assistant", ""), (1, 4, "user", "x"), (1, 5, "assistant", "é中"), (2, 0, "assistant", ""), (3, 0, None, "A"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    for r in chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect():
        texts, at = [], 0
        for m in r.loss_mask:
            assert m.start == at
            at += m.chars
            if m.in_loss:
                texts.append(r.formatted[m.start : at])
        assert at == len(r.formatted)
        assert texts == {1: ["A1", "B<\\|2", "", "é中"], 2: [""], 3: [], 4: ["same", "same"]}[r.conv_id]


def test_chat_empty(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


# -- 1: licences


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "import os\nprint()"),
        (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/y.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "code here\n" * 50),
        (5, "z/x.py", "nothing"),
        (6, None, None),
        (7, "a/top.py", "hello the license of nobody"),
        (7, "a/top.py", "hello the license of nobody"),
        (8, "ab/x.py", ""),
    ]
    got = licences.licence_scan(spark.createDataFrame([(*r, "n") for r in rows], "id long, path string, text string, dir string")).collect()
    by = {r.id: (r.licence, r.origin, r.from_dir) for r in got}
    assert len(got) == 9
    assert by == {
        1: ("MIT", "file", None),
        2: ("Apache-2.0", "inherited", "a/b"),
        3: ("Apache-2.0", "file", None),
        4: ("GPL-3.0", "header", None),
        5: (None, "none", None),
        6: (None, "none", None),
        7: ("MIT", "inherited", "a"),
        8: (None, "none", None),
    }
    assert licences.licence_scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


MIT_FILE = """MIT License

Copyright (c) 2024 Ada Example

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_NOTICE = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version {}
of the License, or (at your option) any later version.
"""
ISC_NOTICE = """Permission to use, copy, modify, and/or distribute this
software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this
permission notice appear in all copies.
"""


def test_wrapped_licences(spark):
    """Files and headers as they are in real trees, wrapped at the usual width."""
    code = "".join(f"value_{k} = compute(value_{k - 1})\n" for k in range(200))
    marked = lambda mark, text: "".join(f"{mark} {line}\n" for line in text.splitlines())
    rows = [
        (1, "m/LICENSE", MIT_FILE),
        (2, "m/src/x.py", code),
        (3, "g/three.py", marked("#", GPL_NOTICE.format(3)) + code),
        (4, "g/two.c", "/*\n" + marked(" *", GPL_NOTICE.format(2)) + " */\n" + code),
        (5, "g/isc.c", "/*\n" + ISC_NOTICE + "*/\n" + code),
        (6, "g/mit.js", marked("//", MIT_FILE) + "\n" + code),
        (7, "g/other.py", "# permission software copyright notice conditions\n" + code),
    ]
    got = {r.id: (r.licence, r.origin) for r in licences.licence_scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    header = {3: "GPL-3.0", 4: "GPL-2.0", 5: "ISC", 6: "MIT"}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 7: (None, "none"), **{k: (v, "header") for k, v in header.items()}}


def test_long_licence_files(spark):
    """Files of long licences by a paragraph that only they have, wrapped, amid much other text; and their directories."""
    other = "\n\n".join(" ".join(f"clause{(7 * k + j) % 301}" for j in range(80)) for k in range(60))
    wrap = lambda text: "\n".join(textwrap.wrap(text, 60, initial_indent="  "))
    rows = [(k, f"{licence}/COPYING", f"   Title\n\n{wrap(text)}\n\n{other}") for k, (licence, text) in enumerate(licences.OPENINGS)]
    rows += [(100 + k, f"{licence}/src/deep/x.py", "import os") for k, (licence, _) in enumerate(licences.OPENINGS)]
    got = {r.id: (r.licence, r.origin) for r in licences.licence_scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    for k, (licence, _) in enumerate(licences.OPENINGS):
        assert got[k] == (licence, "file") and got[100 + k] == (licence, "inherited")


def test_licences_of_clashing_ids(spark):
    """Rows of one id, or of none, are judged each by its own text; a text over 1 MB is searched to its end."""
    long = "plain words here\n" * 80_000 + "Released under the MIT License."
    rows = [(1, "a/x", "Released under the MIT License. " + "code " * 90), (1, "b/x", "nothing " * 20), (None, "c/x", "Licensed under CC BY 4.0."), (None, "d/x", "none"), (2, "e/x", long)]
    got = sorted((r.path, r.licence, r.origin) for r in licences.licence_scan(spark.createDataFrame(rows, "id long, path string, text string")).collect())
    assert got == [("a/x", "MIT", "header"), ("b/x", None, "none"), ("c/x", "CC-BY-4.0", "file"), ("d/x", None, "none"), ("e/x", "MIT", "header")]


def test_trigger_words_cover_every_template():
    weights, _, _ = licences.template_weights()
    chosen = set(licences.trigger_words(weights, 0.75))
    for k in range(len(licences.TEMPLATES)):
        assert sum(w * w for n, _, t, w in weights if n == k and t not in chosen) < 0.75**2


# -- 6: media columns


def test_media_columns(make):
    rows = [*ODD_TEXTS, ODD_TEXTS[6]]
    got = media.media_columns(make(rows, extra=True)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        payload = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = {r.doc_id: bytes(r.media) for r in media.stored_media(make(rows)).collect()}
    assert all(hashlib.sha256(stored[r.doc_id]).hexdigest() == r.media_sha256 and len(stored[r.doc_id]) == r.media_bytes for r in got)
    one, two = (next(r for r in got if r.doc_id == i) for i in (7, 8))
    assert one[1:] == two[1:]
    assert media.media_columns(make([])).count() == 0


# -- 5 and 8: classifiers


def _accuracy(rows, labels, column):
    pairs = [(labels[r.doc_id], r[column]) for r in rows if r.doc_id in labels]
    return sum(bool(a) == bool(b) for a, b in pairs) / len(pairs)


def test_toxicity_learns_pairs(spark, make):
    """An insult with a group's name is toxic; either alone is not: no additive weights can say so."""
    rng = np.random.default_rng(4)
    filler = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [*rng.choice(filler, 12), *(["vile"] if insult else ["fine"]), *(["martians"] if group else ["people"])]
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(insult and group)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(make(rows), table, usable=~toxicity.held_out())
    scored = [r for r in toxicity.score(make(rows, extra=True), machine).collect() if r.held_out]
    assert _accuracy(scored, dict(labels), "predicted") > 0.97


def test_toxicity_learns_agreement(spark, make):
    """Toxic exactly when both markers are there or neither is: each marker alone tells nothing."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for k in range(4000):
        one, two = rng.random(2) < 0.5
        words = [f"filler{x}" for x in rng.integers(0, 60, 8)] + ["red"] * int(one) + ["north"] * int(two)
        rows.append((k, " ".join(rng.permutation(words))))
        labels.append((k, int(one == two)))
    machine = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), usable=~toxicity.held_out())
    marks = [r for r in toxicity.score(make(rows), machine, threshold=0.5).collect() if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in marks]) >= 0.95


def test_machine_against_all_pairs(make):
    """Scores by sums of squares equal those by a loop over all pairs of terms."""
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(0.3, np.arange(40), rng.normal(size=40), rng.normal(size=(40, toxicity.RANK)))
    texts = [sorted(rng.choice(40, k, replace=False)) for k in (0, 1, 2, 7, 20)]
    want = [0.3 + sum(machine.weights[t] for t in x) + sum(machine.vectors[a] @ machine.vectors[b] for i, a in enumerate(x) for b in x[i + 1 :]) for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    assert machine.logits(owner, np.concatenate(texts).astype(int), len(texts)) == pytest.approx(want)


def test_machine_gradient():
    """The first step goes against the gradient of the plain loss, taken by differences."""
    rng = np.random.default_rng(6)
    n, k = 60, 5
    held = rng.random((n, k)) < 0.4
    labels = (held[:, 0] & held[:, 1]).astype(float)
    first, slots = np.concatenate([[0], np.cumsum(held.sum(axis=1))]), np.nonzero(held)[1]
    b0, v0 = np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)), np.random.Generator(np.random.PCG64(5)).normal(0, 0.05, (k, toxicity.RANK))

    def loss(b, w, v):
        z = np.array([b + sum(w[i] for i in np.flatnonzero(x)) + sum(v[i] @ v[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j) for x in held])
        return np.mean(np.log1p(np.exp(-z * (2 * labels - 1)))) + 0.5e-5 * ((w**2).sum() + (v**2).sum())

    bias, w, v = toxicity._train(labels, slots, first, k, epochs=1, batch=1000, rate=1e-3)
    h = 1e-6
    for i in range(k):
        e = np.eye(k)[i] * h
        slope = (loss(b0, e, v0) - loss(b0, -e, v0)) / (2 * h)
        assert w[i] == pytest.approx(-1e-3 * np.sign(slope), rel=1e-2)
        for r in range(toxicity.RANK):
            d = np.zeros_like(v0)
            d[i, r] = h
            slope = (loss(b0, np.zeros(k), v0 + d) - loss(b0, np.zeros(k), v0 - d)) / (2 * h)
            if abs(slope) > 1e-5:
                assert v[i, r] - v0[i, r] == pytest.approx(-1e-3 * np.sign(slope), rel=1e-2)


def test_toxicity_edges(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = make([*ODD_TEXTS, ODD_TEXTS[0]], extra=True)
    scored = toxicity.score(docs, toxicity.fit(make(ODD_TEXTS), none)).collect()
    assert len(scored) == 10 and {r.score for r in scored} == {0.5}
    one = spark.createDataFrame([(4, 0), (5, 0), (5, None)], "doc_id long, toxic int")
    machine = toxicity.fit(make(ODD_TEXTS), one)
    assert all(0 < r.score < 0.3 and r.predicted == 0 for r in toxicity.score(docs, machine).collect())
    assert toxicity.score(make([]), machine).count() == 0
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns and kept.count() == 10


def test_quality_on_the_table(spark):
    model = registry.quality_model(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(toxicity.held_out()).collect()}
    scored = quality.score(docs, model).collect()
    assert len(scored) == docs.count() and _accuracy(scored, labels, "kept") > 0.9
    assert np.all(np.diff(model.thresholds) > 0)
    assert all(0 <= r.expected_grade <= 2 for r in scored)


def test_quality_edges(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(make(ODD_TEXTS), none, F.col("quality"), 4)
    docs = make([*ODD_TEXTS, ODD_TEXTS[0]], extra=True)
    scored = quality.score(docs, model).collect()
    assert len(scored) == 10 and all(abs(r.expected_grade - 1.5) < 1e-9 for r in scored)
    assert quality.score(make([]), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def test_ordinal_gradient():
    """Grades that follow one feature are told apart, with thresholds in order."""
    rng = np.random.default_rng(0)
    x = rng.random(800)
    grade = (x * 4).astype(int)
    model = quality.train(grade, np.arange(800), np.zeros(800, dtype=np.int64), x, 4, epochs=60)
    s = x * model.weights[0]
    assert np.mean((model.tails(s) >= 0.5).sum(axis=1) == grade) > 0.85


def test_ordinal_optimum():
    """At the end of full-batch training the plain penalised loss, written anew, has next to no slope left."""
    rng = np.random.default_rng(4)
    n, k = 300, 3
    x = rng.normal(size=(n, k))
    grade = np.digitize(x @ [1.0, -0.5, 0.2] + rng.logistic(size=n), [-0.5, 1.0])
    model = quality.train(grade, np.repeat(np.arange(n), k), np.tile(np.arange(k), n), x.ravel(), 3, epochs=3000, batch=n, rate=0.01)
    sigma = lambda z: 1 / (1 + np.exp(-z))

    def loss(p):
        s, edges = x @ p[:k], np.array([-1e9, p[k], p[k + 1], 1e9])
        return -np.mean(np.log(sigma(np.clip(edges[grade + 1] - s, -700, 700)) - sigma(np.clip(edges[grade] - s, -700, 700)))) + 0.5e-4 * (p[:k] ** 2).sum()

    at = np.concatenate([model.weights[:k], model.thresholds])
    slopes = [(loss(at + e) - loss(at - e)) / 2e-5 for e in np.eye(k + 2) * 1e-5]
    assert np.abs(slopes).max() < 2e-3 and not model.weights[k:].any()


# -- 9: language model


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


@pytest.mark.parametrize("head_words", [1 << 19, 5])
def test_lm_base_score(spark, make, head_words):
    rows = [*ODD_TEXTS, *[(100 + k, f"word{k % 7} the of Word{k} the. end{k % 3}") for k in range(60)], (4, "one")]
    got = language_model.score(make(rows, extra=True), head_words=head_words, vocabulary=4, n_classes=2).collect()
    training = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 10 for t in _tokens(x))
    n, v = sum(training.values()), len(training)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        own = _tokens(text[r.doc_id])
        want = sum(math.log10((training[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(training[t] > 0 for t in own), n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and math.isfinite(r.score)


def test_lm_beats_its_counts(spark):
    got = language_model.score(spark.read.parquet(f"{SMALL}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def _plain_scores(model, ids):
    """log10 P(class | state) - log10 share of the class, summed over tokens, one text, one step at a time."""
    h, total, sig = np.zeros(32), 0.0, lambda v: 1 / (1 + np.exp(-v))
    for token in ids:
        own = model.class_of[token]
        logits = h @ model.output + model.output_bias
        if own >= 0:
            total += (logits[own] - np.log(np.exp(logits).sum())) / math.log(10) - math.log10(model.class_share[own])
        x, u = model.inputs[token], h @ model.recurrent
        z, r = sig(x[:32] + u[:32]), sig(x[32:64] + u[32:64])
        h = z * h + (1 - z) * np.tanh(x[64:] + r * u[64:])
    return total


@pytest.mark.parametrize("head_words", [1 << 19, 40])
def test_lm_score_is_a_probability(spark, make, head_words):
    """score equals a plain pass over each text; and what may come first adds up to 1."""
    long = " ".join(f"w{k * k % 211}" for k in range(5000))
    rows = [*ODD_TEXTS, *[(100 + k, f"word{k % 7} the of Word{k} the. end{k % 3} unseen{k}") for k in range(60)], (300, long)]
    options = {"head_words": head_words, "vocabulary": 20, "n_classes": 3}
    model, counts, parts = language_model.learn(make(rows), **options)
    ids = {r.doc_id: np.frombuffer(r.ids, dtype=np.uint16) for r in parts.collect()}
    for r in language_model.score(make(rows), **options).collect():
        want = _plain_scores(model, ids[r.doc_id])
        assert abs(r.score - r.base_score - want) < 1e-3 * max(1, abs(want))
    # words of head by model; the end; all other words and the unknown by counts
    word = model.head_surface < language_model.SURFACES
    own = np.where(model.head_id >= 0, model.head_id, model.vocabulary + model.head_surface)[word]
    share = lambda token: 10 ** _plain_scores(model, [token])
    head = sum(share(t) * (n + 0.1) / model.scale for t, n in zip(own, model.head_count[word], strict=True))
    end = share(model.vocabulary + language_model.SURFACES) * (model.end_count + 0.1) / model.scale
    known = set(model.head.view(np.int64).tolist()) | {int(language_model.END.view(np.int64))}
    rest = sum(r.n + 0.1 for r in counts.collect() if r.word not in known) + 0.1
    assert abs(head + end + rest / model.scale - 1) < 1e-6


def test_lm_gradients():
    """Backpropagation through a window against differences of the loss."""
    rng = np.random.default_rng(7)
    n_ids, n_classes, width = 12, 4, 2 * language_model.SURFACES + 1
    class_of = np.concatenate([rng.integers(0, n_classes, n_ids + language_model.SURFACES + 1), np.full(language_model.SURFACES, -1)])
    weights = language_model.initial_weights(np.full(n_classes, 0.25), n_ids + language_model.SURFACES + 1)
    weights[2] = rng.normal(0, 0.3, weights[2].shape).astype(np.float32)
    own, start = rng.integers(0, n_ids, (5, 9)), np.zeros((5, 9), dtype=bool)
    own[0, 7:], own[2, 3], start[1, 4] = -1, n_ids + width - 1, True
    h = rng.normal(0, 0.3, (5, 32)).astype(np.float32)

    def loss(k, at, by):
        moved = [w.astype(np.float64) for w in weights]
        moved[k][at] += by
        trainer = language_model.Trainer(moved, class_of, 0.01)
        return trainer.gradients(own, start, h)[4]

    tokens, dx, others, _, _ = language_model.Trainer(weights, class_of, 0.01).gradients(own, start, h)
    inputs = np.zeros(weights[0].shape)
    np.add.at(inputs, tokens, dx)
    for k, grad in enumerate([inputs, *others]):
        for at in zip(*np.unravel_index(np.abs(grad).ravel().argsort()[[-1, -5, -20]] if grad.size > 20 else [0, 1], grad.shape), strict=True):
            slope = (loss(k, at, 1e-2) - loss(k, at, -1e-2)) / 2e-2
            assert abs(slope - grad[at]) < 0.02 * max(abs(slope), 1e-3), (k, at, slope, grad[at])


def test_lm_streams():
    """Every token of every text is in one stream, in order; long texts in pieces."""
    size = np.array([5, 0, 700, 33, 1, 0, 90])
    first = np.concatenate([[0], np.cumsum(size)])
    ids = np.arange(first[-1])
    pieces = language_model.segments(first, 100)
    assert np.diff(pieces).max() == 100 and pieces[0] == 0 and pieces[-1] == first[-1] and set(first) <= set(pieces)
    token, fresh = language_model._streams(ids, pieces, 4, 1)
    assert sorted(token[token >= 0].tolist()) == ids.tolist()
    assert int(fresh.sum()) == int((np.diff(pieces) > 0).sum())
    follows = (token[:, 1:] != token[:, :-1] + 1) & (token[:, 1:] >= 0) & ~fresh[:, 1:]
    assert not follows.any()


def test_lm_ended_streams(monkeypatch):
    """Texts of unequal length: a window is worked on by the streams that still have tokens, and every token is learned from once."""
    rng = np.random.default_rng(3)
    size = np.append(rng.integers(1, 40, 300), 1500)
    class_of = np.concatenate([rng.integers(0, 4, 60), 4 + np.arange(language_model.SURFACES + 1), np.full(language_model.SURFACES, -1)])
    ids, first = rng.integers(0, 60, size.sum()), np.concatenate([[0], np.cumsum(size)])
    share = np.full(5 + language_model.SURFACES, 1 / (5 + language_model.SURFACES))
    trainer, seen, plain = language_model.Trainer(language_model.initial_weights(share, 61 + language_model.SURFACES), class_of, 0.02), [], language_model.Trainer.gradients

    def spied(self, own, start, h):
        assert (own[:, 0] >= 0).all()
        seen.append(own[own >= 0])
        # streams that have ended change nothing but the time
        more = [np.concatenate([x, np.full((3, *x.shape[1:]), fill, dtype=x.dtype)]) for x, fill in ((own, -1), (start, False), (h, 0))]
        found, padded = plain(self, own, start, h), plain(self, *more)
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(found[2], padded[2], strict=True)) and np.array_equal(found[0], padded[0])
        return found

    monkeypatch.setattr(language_model.Trainer, "gradients", spied)
    trainer.chunk(ids, first, 1)
    assert np.array_equal(np.sort(np.concatenate(seen)), np.sort(ids)) and trainer.met.sum() == len(ids)


def test_lm_sums():
    """Sums of changes by block and id, in two steps, against plain ones."""
    rng = np.random.default_rng(8)
    rows = [(b, p, np.sort(rng.choice(10, 4, replace=False)), rng.random(4), rng.random((4, 3)).astype(np.float32)) for b in (0, 0, 0) for p in (1,)]
    out = language_model._sum_block(pa.Table.from_batches([language_model._sum_batch(rows)])).to_pylist()
    ids, weight = np.frombuffer(out[0]["ids"], dtype=np.int64), np.frombuffer(out[0]["weights"])
    want, change = np.zeros(10), np.zeros((10, 3))
    for _, _, own, w, c in rows:
        want[own] += w
        change[own] += c
    assert np.allclose(want[ids], weight) and np.allclose(change[ids].ravel(), np.frombuffer(out[0]["changes"], dtype=np.float32)) and want.sum() == pytest.approx(weight.sum())


def test_lm_empty(make):
    assert language_model.score(make([])).count() == 0


def test_gru_windows_carry_the_state():
    """Scores do not depend on how a text is cut into windows, or on the other texts of a group."""
    rng = np.random.default_rng(2)
    n_ids, n_classes = 30, 7
    model = language_model.Model(
        np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0), 5, 1, 1, rng.integers(0, n_classes, n_ids), np.full(n_classes, 1 / n_classes),
        rng.normal(size=(n_ids, 96)).astype(np.float32), rng.normal(size=(32, 96)).astype(np.float32) * 0.2, rng.normal(size=(32, n_classes)).astype(np.float32), np.zeros(n_classes, dtype=np.float32),
    )
    size = np.array([5, 0, 200, 33, 1])
    first = np.concatenate([[0], np.cumsum(size)])
    ids = rng.integers(0, n_ids, first[-1])
    one = language_model.log_shares(model, ids, first, width=1024, window=32)
    two = language_model.log_shares(model, ids, first, width=2, window=7)
    assert np.allclose(one, two, atol=1e-3) and one[1] == 0


# -- 10: decontamination

ITEM = "Which river runs past the old mill near the granite bridge of Avelorn? It is the slow green Thessaly river."


def test_decontamination(spark, make):
    filler = " ".join(f"filler{k % 97} text{k % 31}" for k in range(300))
    paraphrase = ITEM.replace("Which river", "What stream").replace("slow", "quiet")
    rows = [(1, filler), (2, f"{filler} {ITEM} {filler}"), (3, filler + ITEM.upper()), (4, f"{filler} {paraphrase}"), (5, None), (6, ""), (7, " ".join(ITEM.split()[:4])), (8, "the of is it near"), (2, f"{filler} {ITEM} {filler}")]
    items = spark.createDataFrame([(10, ITEM), (11, "quite another passage about sailing ships and harbour lights at dawn"), (12, None), (13, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(make(rows, extra=True), items).collect())
    assert got == [(2, 10), (2, 10), (3, 10), (4, 10)]
    kept = decontaminate.keep_unmatched(make(rows), items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7, 8] and kept.columns == make(rows).columns
    blocks = decontaminate.contaminated(make(rows), items, block_items=2).collect()
    assert sorted((r.doc_id, r.item_id) for r in blocks) == got


def test_decontamination_large_benchmark(spark, make):
    """More passages than the rank of a space: exact copies and copies with two other words are all found, each as its own passage only."""
    rng = np.random.Generator(np.random.PCG64(3))
    words = np.array([f"w{k:x}q" for k in range(3000)])
    passages = [" ".join(rng.choice(words, 24)) for _ in range(1500)]
    rows = []
    for k in range(0, 1500, 5):
        own = passages[k].split()
        if k % 2:
            own[3], own[12] = "changed", "words"
        rows.append((k, " ".join([*rng.choice(words, 10), *own, *rng.choice(words, 10)])))
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").coalesce(2)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(make(rows), items).collect())
    assert got == [(k, k) for k in range(0, 1500, 5)]


def test_decontamination_diluted_and_hidden_copies(spark, make):
    """A short passage amid repeated rare words; and a reordered copy, alike in all words, before or after a complete one."""
    words = re.findall(r"\w+", ITEM)
    reordered = " ".join(words[10:] + words[:10])
    short = "seven copper lanterns"
    gap = " ".join(f"gap{k}" for k in range(200))
    changed = ITEM.replace("granite", "wooden").replace("mill", "tower")
    rows = [(1, f"{'zyx ' * 40}{short}{' zyx' * 40}"), (2, f"{reordered} {gap} {changed}"), (3, f"{changed} {gap} {reordered}"), (4, f"{reordered} {gap}"), (5, gap)]
    items = spark.createDataFrame([(10, ITEM), (11, short)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(make(rows), items).collect())
    assert got == [(1, 11), (2, 10), (3, 10)]


def test_least_product():
    """No text with the least common weight has a smaller product."""
    rng = np.random.Generator(np.random.PCG64(4))
    idf = rng.uniform(0.05, 6, 50)
    for _ in range(200):
        item = rng.integers(0, 50, 20)
        least = decontaminate.least_product(item, idf, 0.7)
        order, some = rng.permutation(20), 0
        while idf[item[order[:some]]].sum() < 0.7 * idf[item].sum():
            some += 1
        assert np.bincount(item, minlength=50) * idf @ (np.bincount(item[order[:some]], minlength=50) * idf) >= least - 1e-9


def test_decontamination_empty(spark, make):
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert decontaminate.contaminated(make([]), items).count() == 0
    assert decontaminate.contaminated(make([(1, ITEM)]), items.limit(0)).count() == 0


def _plain_subsequence(item, part, w):
    """Places in item of a common subsequence of greatest weight, by the table of all prefixes."""
    n, m = len(item), len(part)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i] if item[i] == part[j] else 0.0)
    out, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _plain_cosine(item, part, idf):
    whole = Counter(item)
    shared = whole & Counter(part)
    dot = sum(whole[b] * shared[b] * idf[b] ** 2 for b in shared)
    length = lambda c: math.sqrt(sum((n * idf[b]) ** 2 for b, n in c.items()))
    return dot / (length(whole) * length(shared)) if shared else 0.0


def _plain_matches(texts, passages, idf, least_cosine=0.4, least_common=0.7, least_answer=0.5):
    """(text, passage) accepted in any window at all, tried at every word; only windows whose common words weigh too little are passed over."""
    words = lambda x: decontaminate.word_buckets(*utf8_of(pa.array([x]), lower=True))[0]
    found, items = set(), {k: words(x) for k, x in passages.items()}
    for t, text in texts.items():
        own = words(text)
        for k, item in items.items():
            w = idf[item]
            value = np.concatenate([[0], np.cumsum(np.where(np.isin(own, item), idf[own], 0))])
            size = len(item) + max(4, len(item) // 2)
            begin = np.arange(max(1, len(own) - size + 1))
            answer = np.arange(len(item)) >= len(item) - max(1, len(item) // 4)
            for a in begin[value[np.minimum(begin + size, len(own))] - value[begin] >= least_common * w.sum() - 1e-9].tolist():
                part = own[a : a + size]
                common = np.array(_plain_subsequence(item.tolist(), part.tolist(), w.tolist()), dtype=int)
                if _plain_cosine(item.tolist(), part.tolist(), idf) >= least_cosine and w[common].sum() >= least_common * w.sum() and w[common][answer[common]].sum() >= least_answer * w[answer].sum():
                    found.add((t, k))
                    break
    return found


def test_decontamination_against_all_windows(spark):
    """Whole table of the smallest size with passages planted whole, with words left out, put in and changed: recall against every window."""
    rng = np.random.Generator(np.random.PCG64(12))
    passages = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    planted = {}
    for n, (k, passage) in enumerate(sorted(passages.items()) * 3):
        own = passage.split()
        for _ in range(n % 4 * len(own) // 20):
            place = int(rng.integers(len(own)))
            own[place : place + 1] = ([], ["other"], [own[place], "besides"])[int(rng.integers(3))]
        host = list(texts.values())[int(rng.integers(len(texts)))].split()[:400]
        at = int(rng.integers(len(host) + 1))
        planted[10**6 + n] = " ".join(host[:at] + own + host[at:])
    every = {**texts, **planted}
    table = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = _plain_matches(every, passages, decontaminate.inverse_frequencies(table))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, items).collect()}
    assert len(want) > 100 and len(want & got) >= 0.98 * len(want)
    assert len(got - want) <= 0.02 * len(got)


def test_decontamination_without_ids(spark, make):
    """Rows and passages without an id match, too."""
    items = spark.createDataFrame([(None, ITEM), (1, ITEM)], "item_id long, text string")
    got = decontaminate.contaminated(make([(None, f"before {ITEM} after"), (2, None)]), items).collect()
    assert sorted((r.doc_id is None, r.item_id or 0) for r in got) == [(True, 0), (True, 1)]
    assert decontaminate.keep_unmatched(make([(None, f"before {ITEM} after"), (2, None)]), items).count() == 1


def test_decontamination_blocks_change_nothing(spark, make):
    """Cosines and shares, too, are the same whatever the blocks."""
    words = [f"word{k}" for k in range(90)]
    passages = [(k, " ".join(words[k * 9 : k * 9 + 18])) for k in range(9)]
    rows = [(k, f"x y z {text} a b") for k, text in passages] + [(50, " ".join(words))]
    items = spark.createDataFrame(passages, "item_id long, text string")
    result = lambda **o: sorted((r.doc_id, r.item_id, round(r.cosine, 9), round(r.common_share, 9), round(r.answer_share, 9)) for r in decontaminate.contaminated(make(rows), items, **o).collect())
    assert result(block_items=2) == result() and len(result()) >= 18


def test_very_long_texts(spark, make):
    """Texts over a slice of 1 MB are read to their end, and do not change what stands beside them."""
    long = "plain words go on and on\n" * 60_000
    assert len(long) > 1 << 20
    rows = [(1, "short"), (2, long + ITEM), (3, long + "vile martians"), (4, "vile martians"), (5, long)]
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    docs = make(rows).coalesce(1)
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(2, 10)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    machine = toxicity.fit(make([(k, f"w{k % 13} " + ("vile martians" if k % 2 else "fine people")) for k in range(400)]), labels)
    marks = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert marks[3] > 0.9 > marks[5] and marks[4] > 0.9 and marks[5] == pytest.approx(marks[1])
    assert marks == pytest.approx({r.doc_id: r.score for k in range(5) for r in toxicity.score(make(rows[k : k + 1]), machine).collect()})
    counts = {r.doc_id: r.n_tokens for r in language_model.score(docs, vocabulary=8, n_classes=2).collect()}
    assert counts == {i: len(x.split()) + 1 for i, x in rows}
    model = quality.fit(make(rows), spark.createDataFrame([(4, 0), (5, 1)], "doc_id long, quality int"), F.col("quality"), 2)
    alone = {r.doc_id: r.expected_grade for k in range(5) for r in quality.score(make(rows[k : k + 1]), model).collect()}
    assert {r.doc_id: r.expected_grade for r in quality.score(docs, model).collect()} == pytest.approx(alone)


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 2, 1, 3, 9, 5, 4])
    places = decontaminate.common_subsequence(a, b, np.array([1.0, 1, 1, 5, 1]))
    assert a[places].tolist() in ([1, 3, 4], [2, 3, 4])
