"""Gradients against differences, training and policy steps against plain loops, checkpoints."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.operators import training as t
from verisift.operators.responses import head_inference, head_probabilities
from verisift.plans.responses import example_weights
from verisift.sources.files import read_checkpoint, write_checkpoint

SF = "/root/testdata/sf0.001"


def rows_of(n, width=6, seed=3):
    g = np.random.default_rng(seed)
    return {"key": [f"k{i}" for i in range(n)], "visual": g.normal(size=(n, width)), "text": g.normal(size=(n, width)), "label": g.integers(0, 3, n)}


def differences(loss, w, picks=12):
    g = np.random.default_rng(1)
    for name in w:
        for _ in range(picks):
            at = tuple(g.integers(0, s) for s in w[name].shape)
            step = {k: v.copy() for k, v in w.items()}
            step[name][at] += 1e-6
            up = loss(step)
            step[name][at] -= 2e-6
            yield name, at, (up - loss(step)) / 2e-6


def test_forward_is_that_of_inference():
    rows, w = rows_of(9), example_weights(6, 4)
    assert np.allclose(np.exp(t.log_softmax(t.forward(rows["visual"], rows["text"], w)[0])), head_probabilities(rows["visual"], rows["text"], w), atol=1e-12)


def test_gradients_by_differences():
    rows, w, other = rows_of(9), example_weights(6, 4), {k: v * 0.7 for k, v in example_weights(6, 4).items()}
    own = np.array([1.0, 2.0, 0.5])
    _, _, g = t.entropy_sums(rows, w, own)
    for name, at, slope in differences(lambda x: t.entropy_sums(rows, x, own)[0], w):
        assert math.isclose(g[name][at], slope, rel_tol=1e-4, abs_tol=1e-6), name

    def frozen(x):
        """The policy's loss with actions, rewards and advantages held: those of w."""
        lp, q = t.log_softmax(t.forward(rows["visual"], rows["text"], x)[0]), t.log_softmax(t.forward(rows["visual"], rows["text"], other)[0])
        total = 0.0
        for i, key in enumerate(rows["key"]):
            p = np.exp(held[i])
            actions = [min(2, int((u >= np.cumsum(p)).sum())) for u in t.drawn(key, "s", 4)]
            r = np.array([t.CLASS_REWARDS[a] * (0.5 + trust[i, a]) + 0.1 * (a == trust[i].argmax()) for a in actions])
            adv = (r - r.mean()) / (r.std(ddof=1) + 1e-6)
            now = np.exp(lp[i])
            total += -(adv * lp[i, actions]).mean() + 0.3 * (now * (lp[i] - q[i])).sum() + 0.2 * (now * lp[i]).sum() - 0.4 * lp[i, rows["label"][i]]
        return total

    held, trust = t.log_softmax(t.forward(rows["visual"], rows["text"], w)[0]), np.exp(t.log_softmax(t.forward(rows["visual"], rows["text"], other)[0]))
    loss, n, g = t.policy_sums(rows, w, other, other, 4, 0.3, 0.2, 0.4, "s")
    assert math.isclose(loss, frozen(w), rel_tol=1e-9) and n == 9
    for name, at, slope in differences(frozen, w):
        assert math.isclose(g[name][at], slope, rel_tol=1e-4, abs_tol=1e-6), name


@pytest.fixture(scope="module")
def taught(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", F.reverse("embedding").alias("other"), (F.col("label") % 3).alias("label"))
    bad = spark.createDataFrame([(10**6, None, None, 1), (10**6 + 1, [0.0] * 64, [0.0] * 64, None), (10**6 + 2, [0.0] * 64, [0.0] * 64, -1)], e.schema)
    return e.union(bad).repartition(40), e.where("vec_id % 5 = 0")


def plain(df, size):
    """Batches in hashed order, as arrays."""
    h = lambda k: int(hashlib.md5(f"{k}42".encode()).hexdigest()[:8], 16)
    rows = sorted(((h(r["vec_id"]), str(r["vec_id"]), r) for r in df.collect() if r["embedding"] is not None and (r["label"] or 0) >= 0 and r["label"] is not None), key=lambda x: x[:2])
    rows = [x[2] for x in rows]
    return [{"key": [str(r["vec_id"]) for r in part], "visual": np.array([r["embedding"] for r in part], float), "text": np.array([r["other"] for r in part], float), "label": np.array([r["label"] for r in part])} for part in (rows[i : i + size] for i in range(0, len(rows), size))]


def loop(parts, w, epochs, rate, sums):
    first, second, n = {}, {}, 0
    for e in range(epochs):
        for b in sorted(range(len(parts)), key=lambda b: hashlib.md5(f"{e}:{b}".encode()).digest()):
            _, weight, g = sums(parts[b], w, e)
            n += 1
            for k in list(w):
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g[k] / weight
                second[k] = 0.999 * second.get(k, 0) + 0.001 * (g[k] / weight) ** 2
                w = w | {k: w[k] - rate(e) * 0.01 * w[k] - rate(e) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)}
    return w


def test_training_is_a_plain_loop(spark, taught, tmp_path):
    train, validation = taught
    start, own = example_weights(64, 4), np.array([1.0, 2.0, 0.5])
    done = t.train_head(train, validation, "vec_id", "embedding", "other", "label", start, epochs=2, batch=200, rate=0.01, class_weights=own)
    parts = plain(train, 200)
    period = len(parts) * 2 - int(len(parts) * 2 * 0.1)
    rates = lambda e: 0.01 * (1 + math.cos(math.pi * e / period)) / 2
    after = [loop(parts, start, e, rates, lambda p, w, _: t.entropy_sums(p, w, own)) for e in (1, 2)]
    shares = [float(np.mean([head_probabilities(np.array([r["embedding"]], float), np.array([r["other"]], float), w).argmax() == r["label"] for r in validation.collect()])) for w in after]
    assert [h[3] for h in done.history] == pytest.approx(shares) and len(parts) > 2
    best = after[0] if shares[0] >= shares[1] else after[1]
    assert all(np.allclose(done.weights[k], best[k], rtol=1e-8, atol=1e-10) for k in best)
    path = str(tmp_path / "c")
    assert read_checkpoint(spark, path) is None
    write_checkpoint(spark, done.weights, {"latent": 4, "rate": 0.01, "labels": ["a", "b"]}, path)
    weights, config = read_checkpoint(spark, path)
    assert config == {"latent": 4, "rate": 0.01, "labels": ["a", "b"]} and all(np.array_equal(weights[k], done.weights[k]) for k in weights)
    assert head_inference(validation, "embedding", "other", weights).where("head.label is null").count() == 0


def test_a_policy_epoch_is_a_plain_loop(spark, taught):
    train, validation = taught
    start, judge = example_weights(64, 4), {k: v * 1.3 for k, v in example_weights(64, 4).items()}
    done = t.policy_training(train, validation, "vec_id", "embedding", "other", "label", start, judge, epochs=1, batch=300, rate=0.01, group=3)
    want = loop(plain(train, 300), start, 1, lambda _: 0.01, lambda p, w, e: t.policy_sums(p, w, start, judge, 3, 0.02, 0.01, 0.2, f"epoch{e}"))
    assert all(np.allclose(done.weights[k], want[k], rtol=1e-8, atol=1e-10) for k in want)


def test_training_stops_early_and_without_rows(spark, taught):
    train, validation = taught
    start = example_weights(64, 4)
    still = t.train_head(train.limit(60), validation, "vec_id", "embedding", "other", "label", start, epochs=9, batch=100, rate=0.0, patience=2)
    assert len(still.history) == 3 and all(np.array_equal(still.weights[k], start[k]) for k in start)
    none = t.train_head(train.limit(0), validation.limit(0), "vec_id", "embedding", "other", "label", start, epochs=1)
    assert none.history == [(1, 0.0, pytest.approx(1e-3), 0.0)] and none.weights is start
