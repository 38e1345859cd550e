"""Pictures with known pixels, verifiers by name, prompt masks, batches of like length, grids that stop and go on."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.operators import collation as k
from verisift.operators import grid as g
from verisift.operators import images as im
from verisift.operators import verifiers as v
from verisift.operators.layers import hashed_features, verify_lexical
from verisift.operators.responses import head_probabilities
from verisift.plans.responses import example_weights


def png(width, height, depth, colour, raw, palette=None, interlaced=0):
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = im.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    body += part(b"PLTE", palette) if palette else b""
    half = zlib.compress(raw)
    return body + part(b"IDAT", half[:5]) + part(b"IDAT", half[5:]) + part(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("shape", [(7, 5, 3), (6, 9), (1, 1), (1, 40, 3)])
def test_filters_are_undone(kind, shape):
    x = np.random.default_rng(kind).integers(0, 256, shape).astype(np.uint8)
    want = x if x.ndim == 3 else np.repeat(x[:, :, None], 3, axis=2)
    assert np.array_equal(im.decode_png(im.encode_png(x, kind)), want)


def test_depths_and_colours():
    grey = lambda x: np.repeat(np.array(x, np.uint8)[:, :, None], 3, axis=2)
    assert np.array_equal(im.decode_png(png(10, 1, 1, 0, b"\0" + bytes([0b10110010, 0b01000000]))), grey([[255, 0, 255, 255, 0, 0, 255, 0, 0, 255]]))
    assert np.array_equal(im.decode_png(png(3, 1, 4, 0, b"\0" + bytes([0x0F, 0x70]))), grey([[0, 255, 119]]))
    assert np.array_equal(im.decode_png(png(2, 1, 16, 0, b"\0" + bytes([200, 1, 7, 255]))), grey([[200, 7]]))
    assert np.array_equal(im.decode_png(png(3, 1, 2, 3, b"\0" + bytes([0b00011000]), palette=bytes(range(9)))), np.array([[[0, 1, 2], [3, 4, 5], [6, 7, 8]]], np.uint8))
    assert np.array_equal(im.decode_png(png(1, 2, 8, 6, b"\0" + bytes([1, 2, 3, 9]) + b"\2" + bytes([1, 1, 1, 0]))), np.array([[[1, 2, 3]], [[2, 3, 4]]], np.uint8))
    assert np.array_equal(im.decode_png(png(2, 1, 8, 4, b"\1" + bytes([5, 255, 250, 0]))), grey([[5, 255]]))


def test_reasons():
    good = im.encode_png(np.zeros((4, 4), np.uint8))
    flipped = bytearray(good)
    flipped[-20] ^= 1
    cases = {b"GIF89a": "unsupported_format", png(4, 4, 8, 0, b"\0" * 20, interlaced=1): "unsupported_format", png(0, 4, 8, 0, b""): "invalid_size", png(4, 4, 8, 0, b"\0" * 19): "decode_failed", png(4, 4, 8, 0, b"\7" * 20): "decode_failed", png(4, 4, 3, 0, b"\0" * 20): "decode_failed", png(4, 4, 8, 3, b"\0" * 20): "decode_failed", good[:30]: "decode_failed", good[:8]: "decode_failed", bytes(flipped): "decode_failed"}
    for content, reason in cases.items():
        with pytest.raises(im.Unreadable) as e:
            im.decode_png(content)
        assert str(e.value) == reason
    with pytest.raises(im.Unreadable, match="too_many_pixels"):
        im.decode_png(good, most_pixels=15)


def test_areas_and_crops():
    x = np.random.default_rng(1).random((9, 12))
    assert np.allclose(im.area_resized(x, 3, 4), x.reshape(3, 3, 4, 3).mean(axis=(1, 3))) and np.allclose(im.area_resized(x, 9, 12), x)
    assert np.allclose(im.area_resized(x, 1, 1), x.mean()) and np.allclose(im.area_resized(x, 18, 24), np.repeat(np.repeat(x, 2, axis=0), 2, axis=1))
    odd = im.area_resized(x, 2, 5)
    assert np.isclose(odd[0, 0], (x[:4, :2].sum() + x[4, :2].sum() / 2 + 0.4 * (x[:4, 2].sum() + x[4, 2] / 2)) / (4.5 * 2.4))
    assert im.center_crop(np.arange(100).reshape(10, 10, 1))[:, :, 0].tolist() == np.arange(100).reshape(10, 10)[1:8, 1:8].tolist() and im.center_crop(np.zeros((1, 1, 3))).shape == (1, 1, 3)
    assert im.shrunk_pixels(np.zeros((4, 10, 3), np.uint8), 5).shape == (2, 5, 3)


def test_scan(spark):
    picture = np.random.default_rng(2).integers(0, 256, (16, 8, 3)).astype(np.uint8)
    rows = [("a", im.encode_png(picture, 4)), ("b", b"no picture"), ("c", b""), ("d", None), ("e", b"x" * 3000), ("a", im.encode_png(picture, 1)), (None, im.encode_png(picture[:, :, 0]))]
    files = spark.createDataFrame([(p, len(c) if c is not None else None, c, "x") for p, c in rows], "path string, length long, content binary, reason string")
    out = im.scan_images(files, most_bytes=2000).collect()
    assert sorted((r["path"] or "-", r["reason"]) for r in out) == [("-", "ok"), ("a", "ok"), ("a", "ok"), ("b", "unsupported_format"), ("c", "empty"), ("d", "missing"), ("e", "oversize_bytes")]
    assert all(np.array_equal(np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(16, 8, 3), picture) for r in out if r["path"] == "a")
    small = im.scan_images(files, longest=8).where("path = 'a'")
    assert {(r["height"], r["width"]) for r in small.collect()} == {(8, 4)}
    features = im.grey_features(im.scan_images(files), side=4, crop=0.7).where("path = 'a'").first()["features"]
    middle = im.center_crop(picture)
    assert np.allclose(features, im.area_resized(im.grey(middle), 4, 4).ravel() / 255, atol=1e-6)
    assert im.grey_features(im.scan_images(files), side=4).where("features is null").count() == 4 and im.scan_images(files.limit(0)).count() == 0
    assert {r["reason"]: r["n"] for r in im.scan_counts(im.scan_images(files)).collect()}["ok"] == 3


def test_failed_attempts_are_counted(spark, monkeypatch):
    files = spark.createDataFrame([("a", 3, b"abc")], "path string, length long, content binary")

    def broken(content, most):
        raise MemoryError

    monkeypatch.setattr(im, "decode_png", broken)
    row = im.scan_images(files, attempts=3).first()
    assert (row["reason"], row["retries"]) in {("unexpected_error", 2), ("unsupported_format", 0)}  # the latter where a worker has its own copy


def test_verifiers(spark):
    claims = spark.createDataFrame([("p", 0, "Model A reaches 90 points."), ("p", 1, "Model B is fast."), ("q", 0, "Model C wins."), ("r", 0, None)], "paper_id string, claim_ord int, sentence string")
    evidence = spark.createDataFrame([("p", "Model A has 90 points"), ("q", "")], "paper_id string, evidence string")
    weights = example_weights(16, 4) | {"t1": example_weights(9, 4)["t1"]}
    rewards = lambda df: {(r["paper_id"], r["claim_ord"]): r["reward2"] for r in df.collect()}
    lexical = rewards(verify_lexical(claims, evidence))
    cache = spark.createDataFrame([("p", [0.5] * 16), ("q", [1.0] * 15), ("x", [1.0] * 16)], "paper_id string, visual array<double>")
    for name, inputs in (("text_only", {}), ("cached", {}), ("full", {"checkpoint": (weights, {})}), ("cached", {"cache": cache})):
        assert rewards(v.verify_by(name, claims, evidence, **inputs)) == lexical
    got = rewards(v.verify_by("cached", claims, evidence, checkpoint=(weights, {}), cache=cache))
    text = np.array(claims.where("paper_id = 'p' and claim_ord = 0").select(hashed_features(F.col("sentence"), 9)).first()[0])
    p = head_probabilities(np.full((1, 16), 0.5), text[None], weights)[0]
    assert got["p", 0] == pytest.approx((1.0, 0.0, -0.8)[p.argmax()] * p.max()) and {c: got[c] for c in (("q", 0), ("r", 0))} == {c: lexical[c] for c in (("q", 0), ("r", 0))}
    picture = spark.createDataFrame([("p", 1, im.encode_png(np.full((8, 8), 51, np.uint8))), ("q", 1, b"bad")], "path string, length long, content binary")
    got = rewards(v.verify_by("full", claims, evidence, checkpoint=(weights, {}), scanned=im.scan_images(picture)))
    p = head_probabilities(np.full((1, 16), 0.2), text[None], weights)[0]
    assert got["p", 0] == pytest.approx((1.0, 0.0, -0.8)[p.argmax()] * p.max(), abs=1e-6) and got["q", 0] == lexical["q", 0]
    with pytest.raises(ValueError, match="cached, full, text_only"):
        v.verify_by("other", claims, evidence)
    with pytest.raises(ValueError, match="already"):
        v.verifier("full")(v.full)


def test_prompt_masks(spark):
    cases = [([1, 7, 8, 2, 7, 8, 3, 4], 6), ([7, 8], 2), ([7], 0), ([1, 2, 3, 4, 5, 6], 4), ([], 0), ([8, 7], 1), (None, None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, ids array<int>")
    got = {r["i"]: r["l"] for r in df.select("i", k.masked_labels(F.col("ids"), [7, 8]).alias("l")).collect()}
    assert got == {i: None if x is None else [-100] * n + x[n:] for i, (x, n) in enumerate(cases)}


def test_batches_of_like_length(spark):
    rows = [(i, list(range((i * 37) % 90))) for i in range(500)] + [(1000 + i, [1] * 40) for i in range(400)] + [(None, [5]), (7, [1, 2]), (2000, None)]
    df = spark.createDataFrame([(i, x, "c", 3) for i, x in rows], "id int, ids array<int>, `a.b` string, _n int").withColumn("labels", F.col("ids"))
    out = k.padded(k.length_batches(df.withColumn("labels", F.coalesce("labels", F.array().cast("array<int>"))), "id", "ids", 32, 60).withColumn("labels", F.slice("labels", 1, 60)), "ids", "labels", pad=-1).collect()
    assert len(out) == len(rows) and set(df.columns) <= set(out[0].asDict())
    widths = {}
    for r in out:
        assert len(r["ids"]) == len(r["labels"]) == len(r["attention"]) == widths.setdefault(r["batch"], len(r["ids"]))
    real = sorted((r["id"] is None, r["id"] or 0, tuple(r["ids"][: sum(r["attention"])])) for r in out)
    assert real == sorted((i is None, i or 0, tuple((x or [])[:60])) for i, x in rows)
    sizes = [sum(r["batch"] == b for r in out) for b in sorted(widths)]
    assert set(sizes[:-1]) == {32} and sorted(widths) == list(range(len(sizes)))
    spent, useful = sum(len(r["ids"]) for r in out), sum(sum(r["attention"]) for r in out)
    assert (spent - useful) / spent < 0.05
    assert k.length_batches(df.limit(0), "id", "ids", 4, 9).count() == 0


def test_grid_goes_on_where_it_stopped(spark, tmp_path):
    df, seen = spark.range(100).withColumn("x", F.col("id") / 100), []

    def measure(gate, scale):
        seen.append((gate, scale))
        if len(seen) == 4:
            raise RuntimeError("stopped")
        return {"n": F.count_if(F.col("x") >= gate), "mean": F.avg(F.when(F.col("x") >= gate, F.col("x") * scale))}

    grid = {"gate": [0.5, 0.9, 2.0], "scale": [1, 10]}
    with pytest.raises(RuntimeError):
        g.run_grid(df, grid, measure, str(tmp_path / "g"), at_once=2)
    assert g.finished_runs(spark, str(tmp_path / "g")).count() == 2
    got = {(r["run"], r["figure"]): r["value"] for r in g.run_grid(df, grid, measure, str(tmp_path / "g"), at_once=2).collect()}
    assert len(seen) == 4 + 4 and len(got) == 12
    assert got["gate=0.5,scale=1", "n"] == 50 and got["gate=0.9,scale=10", "mean"] == pytest.approx(9.45) and got["gate=2.0,scale=1", "mean"] is None
    wider = g.run_grid(df, {"gate": [0.5, 0.1], "scale": [1]}, measure, str(tmp_path / "g"))
    assert {r["run"] for r in wider.collect()} == {"gate=0.5,scale=1", "gate=0.1,scale=1"} and g.grid_summary(spark, str(tmp_path / "g")).count() == 14
    with pytest.raises(ValueError):
        g.expanded({"a": [1, 1]})
    assert g.expanded({}) == {"only": {}}
