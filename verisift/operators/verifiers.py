"""The learned layer by name. A verifier turns claims and evidence into `reward2`; modes fall back to the lexical one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import grey_features
from .layers import hashed_features, verify_learned, verify_lexical
from .responses import head_inference

Verifier = Callable[..., DataFrame]
VERIFIERS: dict[str, Verifier] = {}


def verifier(name: str) -> Callable[[Verifier], Verifier]:
    """Registers a verifier: f(claims, evidence, **inputs) gives claims with `reward2`. A name is given once."""

    def add(f: Verifier) -> Verifier:
        if name in VERIFIERS:
            raise ValueError(f"verifier {name} is there already")
        VERIFIERS[name] = f
        return f

    return add


def verify_by(name: str, claims: DataFrame, evidence: DataFrame, **inputs) -> DataFrame:
    """claims(paper_id, claim_ord, sentence) with `reward2` by the named verifier."""
    if name not in VERIFIERS:
        raise ValueError(f"no verifier {name}; there are {', '.join(sorted(VERIFIERS))}")
    return VERIFIERS[name](claims, evidence, **inputs)


def _widths(weights: dict[str, np.ndarray]) -> tuple[int, int]:
    return len(weights["v1"]) - 1, len(weights["t1"]) - 1


def _by_head(claims: DataFrame, evidence: DataFrame, visual: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """visual: (paper_id, visual), one vector a paper. Vectors of another length than the head takes count as none."""
    wide, long = _widths(weights)
    fits = visual.where(F.size("visual") == wide).groupBy("paper_id").agg(F.min("visual").alias("visual"))
    met = claims.select("paper_id", "claim_ord", hashed_features(F.coalesce("sentence", F.lit("")), long).alias("text")).join(fits, "paper_id")
    head = head_inference(met, "visual", "text", weights).select("paper_id", "claim_ord", F.col("head.reward").alias("reward"))
    return verify_learned(claims, evidence, head)


@verifier("text_only")
def text_only(claims: DataFrame, evidence: DataFrame, **_) -> DataFrame:
    """V10 alone."""
    return verify_lexical(claims, evidence)


@verifier("cached")
def cached(claims: DataFrame, evidence: DataFrame, checkpoint: tuple | None = None, cache: DataFrame | None = None, **_) -> DataFrame:
    """The head over cached vectors(paper_id, visual); papers without one, and all without a checkpoint, are lexical."""
    if checkpoint is None or cache is None:
        return text_only(claims, evidence)
    return _by_head(claims, evidence, cache, checkpoint[0])


@verifier("full")
def full(claims: DataFrame, evidence: DataFrame, checkpoint: tuple | None = None, scanned: DataFrame | None = None, **_) -> DataFrame:
    """The head over pictures scanned by scan_images, `path` being the paper: grey features as wide as the head takes, which must be
    a square. Papers without a readable picture, and all without a checkpoint, are lexical."""
    if checkpoint is None or scanned is None:
        return text_only(claims, evidence)
    side = int(round(_widths(checkpoint[0])[0] ** 0.5))
    features = grey_features(scanned.where("reason = 'ok'"), side)
    return _by_head(claims, evidence, features.select(F.col("path").alias("paper_id"), F.col("features").cast("array<double>").alias("visual")), checkpoint[0])
