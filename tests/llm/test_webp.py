"""Round trips through every feature of the format."""

import cProfile
import heapq
import itertools
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SMALL
from turnloom.llm import media, webp


def _picture(kind: str, height: int, width: int) -> np.ndarray:
    rng = np.random.default_rng(3)
    if kind == "noise":
        return rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    if kind == "few":
        return rng.integers(0, 256, (5, 4)).astype(np.uint8)[rng.integers(0, 5, (height, width))]
    if kind == "one":
        return np.full((height, width, 4), 7, dtype=np.uint8)
    return np.stack(np.broadcast_arrays(np.arange(width)[None, :] * 3, np.arange(height)[:, None] * 5, 9, 255), axis=-1).astype(np.uint8)


@pytest.mark.parametrize("kind", ["noise", "few", "one", "ramp"])
@pytest.mark.parametrize("size", [(1, 1), (1, 9), (7, 1), (13, 11)])
def test_round_trip(kind, size):
    pixels = _picture(kind, *size)
    for transforms in [(), (0,), (1,), (2,), (0, 1, 2), (2, 1, 0)] + ([(3,), (3, 0)] if kind in ("few", "one") else []):
        for cache_bits, references, meta in itertools.product((0, 4), (False, True), (0, 2)):
            stored = webp.encode(pixels, transforms, cache_bits=cache_bits, references=references, meta_block=meta)
            (back,) = webp.decode(stored)
            assert np.array_equal(back, pixels), (transforms, cache_bits, references, meta)


def test_near_offsets():
    assert len(webp.near_offsets()) == 120
    assert webp.near_offsets()[:6] == ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0))
    assert webp.near_offsets()[-1] == (8, 7)


def test_bad_data():
    with pytest.raises(ValueError):
        webp.decode_vp8l(b"\x2f\0\0\0\0")
    with pytest.raises(ValueError):
        webp.decode(b"RIFF" + b"\0" * 20)


@pytest.mark.parametrize("raw", [b"", b"a", b"x" * 64, "é中".encode() * 50, b"long " * 300_000])
def test_payload(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    pixels = media.load(media.store(payload))
    assert pixels.tobytes() == payload
    assert media.feature(pixels) == media.feature(media.load(media.store(payload)))


@pytest.mark.parametrize("kind", ["noise", "few", "one", "ramp"])
@pytest.mark.parametrize("size", [(1, 1), (1, 9), (7, 1), (13, 11), (90, 16)])
def test_best_round_trip(kind, size):
    pixels = _picture(kind, *size)
    stored = webp.encode_best(pixels)
    (back,) = webp.decode(stored)
    assert np.array_equal(back, pixels)


def _features(pixels):
    trace, stored = Counter(), webp.encode_best(pixels)
    (back,) = webp.decode(stored, trace)
    assert np.array_equal(back, pixels) and len(stored) < pixels.nbytes
    return set(trace)


def test_choice_of_transforms():
    """Each transform is chosen for data that it suits, and undone."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (1, 16, 4)).repeat(200, axis=0).astype(np.uint8)
    rows[::7] = rng.integers(0, 256, (29, 16, 4))
    assert "predictor" in _features(rows)
    grey = rng.integers(0, 60, (200, 16, 4)).astype(np.uint8)
    grey[..., 0], grey[..., 2], grey[..., 3] = grey[..., 1] + 1, grey[..., 1], 255
    assert "subtract-green" in _features(grey)
    half = rng.integers(0, 120, (200, 16, 4)).astype(np.uint8)
    half[..., 0], half[..., 3] = half[..., 1] >> 1, 255
    assert "cross-colour" in _features(half)
    assert "palette" in _features(rng.integers(0, 256, (5, 4)).astype(np.uint8)[rng.integers(0, 5, (200, 16))])


def test_row_modes():
    """The inverse by rows equals the inverse by pixels."""
    rng = np.random.default_rng(2)
    argb = rng.integers(0, 1 << 32, 40 * 16, dtype=np.uint64).astype(np.uint32)
    for mode in webp.ROW_MODES:
        modes = np.full(-(-40 // 16), mode)
        left = webp.apply_predictor(argb, 16, 4, modes)
        assert np.array_equal(webp.channels(left), webp.residuals(argb, 16, mode).reshape(-1, 4))
        assert np.array_equal(webp.undo_predictor(left, 16, 4, modes.astype(np.uint32)), argb)


def test_features_of_documents(spark):
    """What the query stores for whole documents: fitted codes, copies, cache and palettes, smaller than the texts; other transforms do not pay on prose."""
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    trace, stored, payload = Counter(), 0, 0
    for raw in texts:
        own, used = media.padded(raw), Counter()
        file = media.store(own)
        assert np.concatenate(webp.decode(file, used)).tobytes() == own
        trace.update(used.keys())
        stored, payload = stored + len(file), payload + len(own)
    assert stored < 0.6 * payload
    assert trace["literal"] > 150 and trace["copy"] > 100 and trace["cache"] > 100 and trace["palette"] > 0


def test_long_payload():
    """More rows than a file may have, more bits than a window."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(4000)]
    raw = b" ".join(words[k] for k in rng.integers(0, 4000, 300_000))
    payload = media.padded(raw)
    assert len(payload) > 64 * webp.MAX_SIDE
    stored = media.store(payload)
    assert media.load(stored).tobytes() == payload and len(stored) < len(payload)


def test_writer():
    """Numbers of up to 32 bits, end to end, as bits written one by one; numbers of no bits leave none."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(0, 33, 500)
    values = [int(rng.integers(0, 1 << int(n))) if n else 7 for n in sizes]
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in zip(values, sizes.tolist(), strict=True) if n)
    out = webp.Writer()
    for v, n in zip(values[:100], sizes[:100].tolist(), strict=True):
        out.write(v, n)
    out.add(np.array(values[100:]), sizes[100:])
    assert out.bytes() == int(bits[::-1], 2).to_bytes((len(bits) + 7) // 8, "little")


def test_code_lengths():
    """Fitted codes are as short as merging the two least counts makes them, and read back as written, also with long runs and rare symbols."""
    rng = np.random.default_rng(7)
    for counts in [rng.integers(0, 9, 256) * rng.integers(0, 2, 256), np.array([0] * 900 + [1, 0, 3] + [0] * 401), 1 + (rng.pareto(1.0, 300) * 5).astype(np.int64), np.repeat([4, 0, 4, 0], 70)]:
        lengths, heap, total = webp.huffman(counts, 15), [int(c) for c in counts if c], 0
        while len(heap) > 1:
            heapq.heapify(heap)
            two = heapq.heappop(heap) + heapq.heappop(heap)
            total += two
            heap.append(two)
        assert int(counts @ lengths) == total
        out = webp.Writer()
        webp._write_prefix(out, lengths)
        code = webp._read_prefix(webp.Reader(out.bytes() + b"\xff"), len(lengths))
        assert np.array_equal(code.table, webp.Prefix(lengths).table)


def test_work_of_a_document():
    """Documents are short, so calls are what one costs. Counted, not timed: the same on every machine (2,789 a document; 4,216 before codes and tokens were trimmed)."""
    texts = [(r or "").encode() for r in pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist()][:200]
    payloads = [media.padded(raw) for raw in texts]
    media.load(media.store(payloads[0]))
    counted = cProfile.Profile()
    counted.enable()
    for payload in payloads:
        media.feature(media.load(media.store(payload)))
    counted.disable()
    calls = sum(s.callcount for s in counted.getstats())
    assert calls < 3400 * len(payloads)


def _odd_payloads():
    """Short and long texts, runs, few colours, channels that go together, rows that repeat, noise."""
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[k] for k in rng.integers(0, 300, n)) for n in rng.integers(1, 400, 150)]
    texts += [b"", b"a", b"\0" * 64, b"x" * 5000, b"abcd" * 700, bytes(range(256)) * 9, "é中".encode() * 333, b" ".join(words) * 30]
    texts += [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 63, 64, 65, 4096, 30_000)]
    grey = rng.integers(0, 60, (2000, 4)).astype(np.uint8)
    grey[:, 0], grey[:, 2], grey[:, 3] = grey[:, 1] + 1, grey[:, 1], 255
    half = rng.integers(0, 120, (2000, 4)).astype(np.uint8)
    half[:, 0], half[:, 3] = half[:, 1] >> 1, 255
    few = rng.integers(0, 256, (5, 4)).astype(np.uint8)[rng.integers(0, 5, 3200)]
    rows = np.tile(rng.integers(0, 256, (1, 64)).astype(np.uint8), (200, 1))
    rows[::7] = rng.integers(0, 256, (29, 64))
    return [media.padded(x) for x in texts + [x.tobytes() for x in (grey, half, few, rows)]]


def test_together():
    """Texts coded together are stored as each alone is, and read back as each alone is; what they use is told alike."""
    payloads = _odd_payloads()
    alone = [media.store(x) for x in payloads]
    order = np.random.default_rng(9).permutation(len(payloads)).tolist()
    assert media.store_all([payloads[k] for k in order]) == [alone[k] for k in order]
    one, all_ = Counter(), Counter()
    for stored in alone:
        webp.decode(stored, one)
    got = webp.decode_all([alone[k] for k in order], all_)
    assert [np.concatenate(x).tobytes() for x in got] == [payloads[k] for k in order]
    assert one == all_ and {"predictor", "palette", "subtract-green", "cross-colour", "literal", "cache", "copy"} <= set(all_)
    # several files in one string, beside others
    assert [len(x) for x in webp.decode_all([alone[3] + alone[4], *alone])] == [2] + [1] * len(alone)


def test_any_stream_together():
    """Streams that the encoder chooses for no document: each transform, several groups of codes, other cache sizes and widths."""
    pixels = [_picture(kind, *size) for kind in ("noise", "few", "one", "ramp") for size in ((1, 9), (7, 1), (13, 11), (40, 16))]
    stored, want = [], []
    for own in pixels:
        for transforms, cache_bits, references, meta in itertools.product(((), (0,), (2, 1)), (0, 1, 4, 11), (False, True), (0, 2)):
            stored.append(webp.encode(own, transforms, cache_bits=cache_bits, references=references, meta_block=meta))
            want.append(own)
    for got, own in zip(webp.decode_all(stored), want, strict=True):
        assert np.array_equal(got[0], own)


def test_bad_data_together():
    """A file cut short among good ones is refused, whatever stands behind it."""
    stored = [media.store(x) for x in _odd_payloads()[:150]]
    data = next(webp._files(stored[70]))
    for n in range(len(data) // 2, len(data), 7):
        with pytest.raises(ValueError):
            webp.decode_all([*stored[:70], webp._file(data[:n]), *stored[71:]])


def test_work_together():
    """Calls a document where documents are coded together: 1,672 (2,789 one by one)."""
    texts = [(r or "").encode() for r in pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist()] * 5
    rows = [[media.padded(texts[i]) for i in part] for part in media._parts(np.array([len(x) for x in texts]))]
    media.load_all(media.store_all(rows[0]))
    counted = cProfile.Profile()
    counted.enable()
    for payloads in rows:
        for pixels in media.load_all(media.store_all(payloads)):
            media.feature(pixels)
    counted.disable()
    calls = sum(s.callcount for s in counted.getstats())
    assert calls < 2000 * len(texts)
