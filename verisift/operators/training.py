"""M1 and M2: the head of V14 trained over Spark, and a policy step over its class probabilities.

Rows lie in batches that are written once. A step adds up, task by task and then in a tree, the gradients of its batch's rows;
the driver holds the weights, whose size does not depend on the rows, and moves them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .responses import gelu, head_inference
from .sampling import batches

Weights = dict[str, np.ndarray]
LAYERS = ("v1", "v2", "t1", "t2", "c1", "c2")
#: Partial sums that one task adds up, and that the driver adds up at last.
FAN = 16
#: Rows whose gradients are worked out at once.
BLOCK_ROWS = 1024
#: What the policy earns for a class, before confidence; the bonus for the reward model's first choice.
CLASS_REWARDS, ALIGNED = (1.0, -0.1, -0.5), 0.1


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    cdf = 0.5 * (1.0 + np.frompyfunc(math.erf, 1, 1)(x / math.sqrt(2.0)).astype(np.float64))
    return cdf + x * np.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def _lift(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def forward(visual: np.ndarray, text: np.ndarray, w: Weights) -> tuple[np.ndarray, dict]:
    """(class scores, what backward needs) of rows."""
    k: dict = {"visual": _lift(visual), "text": _lift(text)}
    k["v"], k["t"] = k["visual"] @ w["v1"], k["text"] @ w["t1"]
    k["hv"], k["ht"] = _lift(gelu(k["v"])), _lift(gelu(k["t"]))
    a, b = k["hv"] @ w["v2"], k["ht"] @ w["t2"]
    k["gap"], k["joint"] = a - b, _lift(np.hstack([a, b, np.abs(a - b)]))
    k["c"] = k["joint"] @ w["c1"]
    k["hc"] = _lift(gelu(k["c"]))
    return k["hc"] @ w["c2"], k


def backward(d: np.ndarray, k: dict, w: Weights) -> Weights:
    """Gradients of the weights from those of the class scores."""
    out = {"c2": k["hc"].T @ d}
    d = (d @ w["c2"][:-1].T) * _gelu_slope(k["c"])
    out["c1"] = k["joint"].T @ d
    d = d @ w["c1"][:-1].T
    n = k["gap"].shape[1]
    far = d[:, 2 * n :] * np.sign(k["gap"])
    for side, first, second, h, low, raw, x in (("v", "v1", "v2", "hv", d[:, :n] + far, "v", "visual"), ("t", "t1", "t2", "ht", d[:, n : 2 * n] - far, "t", "text")):
        out[second] = k[h].T @ low
        out[first] = k[x].T @ ((low @ w[second][:-1].T) * _gelu_slope(k[raw]))
    return out


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def entropy_sums(rows: dict, w: Weights, class_weights: np.ndarray) -> tuple[float, float, Weights]:
    """M1: (sum of weighted cross-entropy, sum of weights, gradient of the first) of rows (key, visual, text, label)."""
    z, kept = forward(rows["visual"], rows["text"], w)
    lp, y = log_softmax(z), rows["label"]
    own = class_weights[y]
    d = np.exp(lp)
    d[np.arange(len(y)), y] -= 1.0
    return float(-(own * lp[np.arange(len(y)), y]).sum()), float(own.sum()), backward(d * own[:, None], kept, w)


def drawn(key, salt: str, n: int) -> list[float]:
    """n numbers in [0, 1) from a row's key and a salt."""
    digest = b"".join(hashlib.md5(f"{salt}:{i}:{key}".encode()).digest() for i in range(-(-n // 4)))
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") / (1 << 32) for i in range(n)]


def policy_sums(rows: dict, w: Weights, reference: Weights, judge: Weights, group: int, kl_beta: float, entropy_coef: float, supervised: float, salt: str) -> tuple[float, float, Weights]:
    """M2: (sum of the loss, rows, gradient) of rows: actions drawn from the policy by a hash, rewards by class, scaled by the judge's
    confidence, advantages within a row's group (W2), a penalty for leaving the reference, a bonus for entropy, an anchor to labels."""
    z, kept = forward(rows["visual"], rows["text"], w)
    lp = log_softmax(z)
    p, q = np.exp(lp), log_softmax(forward(rows["visual"], rows["text"], reference)[0])
    trust = np.exp(log_softmax(forward(rows["visual"], rows["text"], judge)[0]))
    n, classes = p.shape
    u = np.array([drawn(k, salt, group) for k in rows["key"]]).reshape(n, group)
    actions = np.minimum((u[:, :, None] >= np.cumsum(p, axis=1)[:, None, :]).sum(axis=2), classes - 1)
    each = np.arange(n)[:, None]
    rewards = np.asarray(CLASS_REWARDS)[actions] * (0.5 + trust[each, actions]) + ALIGNED * (actions == trust.argmax(axis=1)[:, None])
    spread = rewards.std(axis=1, ddof=1, keepdims=True) if group > 1 else np.zeros((n, 1))
    adv = (rewards - rewards.mean(axis=1, keepdims=True)) / (spread + 1e-6)
    kl, entropy = (p * (lp - q)).sum(axis=1, keepdims=True), -(p * lp).sum(axis=1, keepdims=True)
    taken = np.zeros((n, classes))
    np.add.at(taken, (np.broadcast_to(each, actions.shape), actions), adv)
    d = -(taken - adv.sum(axis=1, keepdims=True) * p) / group
    d += kl_beta * p * (lp - q - kl) + entropy_coef * p * (lp + entropy)
    loss = -(adv * lp[each, actions]).sum() / group + kl_beta * kl.sum() - entropy_coef * entropy.sum()
    if supervised:
        y = rows["label"]
        hit = p.copy()
        hit[np.arange(n), y] -= 1.0
        d += supervised * hit
        loss -= supervised * lp[np.arange(n), y].sum()
    return float(loss), float(n), backward(d, kept, w)


def _packed(loss: float, weight: float, gradient: Weights) -> np.ndarray:
    return np.concatenate([[loss, weight], *(gradient[k].ravel() for k in LAYERS)])


def _unpacked(x: np.ndarray, like: Weights) -> tuple[float, float, Weights]:
    ends = np.cumsum([2, *(like[k].size for k in LAYERS)])
    return float(x[0]), float(x[1]), {k: x[a:z].reshape(like[k].shape) for k, a, z in zip(LAYERS, ends[:-1], ends[1:], strict=True)}


def summed(rows: DataFrame, sums: Callable[[dict], tuple[float, float, Weights]], like: Weights) -> tuple[float, float, Weights] | None:
    """The sums of all rows (key, visual, text, label), None without any: each task adds up its own, then FAN tasks' sums meet in one."""

    def own(batches_):
        total = None
        for batch in batches_:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                vectors = [np.asarray(part.column(j).flatten()).astype(np.float64).reshape(part.num_rows, -1) for j in (1, 2)]
                x = _packed(*sums({"key": part.column(0).to_pylist(), "visual": vectors[0], "text": vectors[1], "label": part.column(3).to_numpy()}))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def add(batches_):
        total = None
        for batch in batches_:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts, tasks = rows.mapInArrow(own, "total binary"), rows.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = math.ceil(tasks / FAN)
        parts = parts.repartition(tasks).mapInArrow(add, "total binary")
    got = [np.frombuffer(r["total"]) for r in parts.collect()]
    return _unpacked(sum(got), like) if got else None


@dataclass
class AdamW:
    """Moments of the weights; decay acts on the weights themselves."""

    weight_decay: float = 0.01
    betas: tuple[float, float] = (0.9, 0.999)
    steps: int = 0
    first: Weights = field(default_factory=dict)
    second: Weights = field(default_factory=dict)

    def moved(self, w: Weights, g: Weights, rate: float) -> Weights:
        self.steps += 1
        a, b = self.betas
        out = {}
        for k in w:
            self.first[k] = a * self.first.get(k, 0.0) + (1 - a) * g[k]
            self.second[k] = b * self.second.get(k, 0.0) + (1 - b) * g[k] ** 2
            step = self.first[k] / (1 - a**self.steps) / (np.sqrt(self.second[k] / (1 - b**self.steps)) + 1e-8)
            out[k] = w[k] * (1 - rate * self.weight_decay) - rate * step
        return out


def cosine_rate(rate: float, at: int, period: int) -> float:
    """The learning rate after `at` moves along a half cosine of `period`."""
    return rate * (1 + math.cos(math.pi * at / max(1, period))) / 2


def in_batches(df: DataFrame, key: str, visual: str, text: str, label: str, size: int) -> tuple[DataFrame, int]:
    """(rows key, visual, text, label and batch, number of batches), written once; a batch is read without the others. Rows with a null
    vector or label, or a label below 0, teach nothing and are left out."""
    some = df.select(F.col(key).cast("string").alias("key"), F.col(visual).cast("array<double>").alias("visual"), F.col(text).cast("array<double>").alias("text"), F.col(label).cast("int").alias("label"))
    some = some.where("visual is not null and text is not null and label >= 0")
    path = shared_folder(df.sparkSession, "batches")
    batches(some, "key", size).repartition("batch").write.partitionBy("batch").parquet(path)
    rows = df.sparkSession.read.schema("key string, visual array<double>, text array<double>, label int, batch long").parquet(path)
    return rows, (rows.agg(F.max("batch")).first()[0] + 1 if not rows.isEmpty() else 0)


def accuracy(df: DataFrame, visual: str, text: str, label: str, w: Weights) -> float:
    """The share of rows whose most likely class is theirs; 0 without rows."""
    got = head_inference(df.where(F.col(label).isNotNull()), visual, text, w)
    return got.agg(F.avg((F.col("head.label") == F.col(label)).cast("double"))).first()[0] or 0.0


@dataclass
class Trained:
    """The weights of the best epoch, and (epoch, loss, rate, accuracy) of all."""

    weights: Weights
    history: list[tuple[int, float, float, float]]


def _epochs(rows: DataFrame, n: int, w: Weights, epochs: int, patience: int, rate: Callable[[int], float], weight_decay: float, sums, score) -> Trained:
    move, history, best, since = AdamW(weight_decay), [], (None, w), 0
    for epoch in range(epochs):
        losses = []
        for b in sorted(range(n), key=lambda b: hashlib.md5(f"{epoch}:{b}".encode()).digest()):
            now = w
            loss, weight, gradient = summed(rows.where(F.col("batch") == b).drop("batch"), lambda part, now=now, e=epoch: sums(part, now, e), w)
            losses.append(loss / max(weight, 1e-12))
            w = move.moved(w, {k: g / max(weight, 1e-12) for k, g in gradient.items()}, rate(epoch))
        reached = score(w)
        history.append((epoch + 1, float(np.mean(losses)) if losses else 0.0, rate(epoch), reached))
        if best[0] is None or reached > best[0]:
            best, since = (reached, w), 0
        else:
            since += 1
            if since >= patience:
                break
    return Trained(best[1], history)


def train_head(train: DataFrame, validation: DataFrame, key: str, visual: str, text: str, label: str, start: Weights, epochs: int = 20, batch: int = 64, rate: float = 1e-3, weight_decay: float = 0.01, class_weights=(1.0, 1.0, 1.0), warmup: float = 0.1, patience: int = 5) -> Trained:
    """M1: weighted cross-entropy, AdamW, a cosine rate that moves once an epoch over as many moves as there are batches (less the
    warm-up's share), and an end after `patience` epochs without a better accuracy on `validation`; the best epoch's weights.

    Batches are runs of the hashed order of the key; they stay, their order changes with the epoch. Without rows the weights
    stay as they are."""
    rows, n = in_batches(train, key, visual, text, label, batch)
    period, own = n * epochs - int(n * epochs * warmup), np.asarray(class_weights, float)
    return _epochs(rows, n, start, epochs, patience, lambda e: cosine_rate(rate, e, period), weight_decay, lambda part, w, _: entropy_sums(part, w, own), lambda w: accuracy(validation, visual, text, label, w))


def policy_training(train: DataFrame, validation: DataFrame, key: str, visual: str, text: str, label: str, start: Weights, judge: Weights, epochs: int = 3, batch: int = 64, rate: float = 1e-4, group: int = 4, kl_beta: float = 0.02, entropy_coef: float = 0.01, supervised: float = 0.2, weight_decay: float = 0.01) -> Trained:
    """M2: epochs of policy steps from `start`, which is the reference as well; `judge` gives the rewards. The best epoch's weights by
    accuracy on `validation`."""
    rows, n = in_batches(train, key, visual, text, label, batch)
    sums = lambda part, w, e: policy_sums(part, w, start, judge, group, kl_beta, entropy_coef, supervised, f"epoch{e}")
    return _epochs(rows, n, start, epochs, epochs + 1, lambda _: rate, weight_decay, sums, lambda w: accuracy(validation, visual, text, label, w))
