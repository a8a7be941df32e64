"""Logistic regression by FTRL-proximal updates over hashed binary features.

The learner sees one document at a time (the method is an online one) and is
vectorised over that document's features.  It is fitted on a sample of labelled
rows whose size is bounded by a documented parameter, so it is one bounded task;
featurising and scoring run on every document, in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.6
    l2: float = 0.5
    epochs: int = 3
    positive_weight: float = 1.0
    bits: int = 20


def fit(rows: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> tuple[np.ndarray, float]:
    """Weights (2**bits, mostly zero) and bias. ``rows``: the distinct feature
    indices of each document. Without rows the model always answers 0.5."""
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias

    def weights(zi, ni, l1):
        w = (np.sign(zi) * l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    bias = np.array([size])
    for _ in range(p.epochs):
        for idx, y in zip(rows, labels):
            i = np.concatenate([idx.astype(np.int64), bias])
            l1 = np.full(len(i), p.l1)
            l1[-1] = 0.0
            zi, ni = z[i], n[i]
            w = weights(zi, ni, l1)
            s = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0)))
            g = (s - y) * (p.positive_weight if y else 1.0)
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[i] = ni + g * g
    w = weights(z, n, np.append(np.full(size, p.l1), 0.0))
    return w[:-1], float(w[-1])


def scores(weights: np.ndarray, bias: float, features: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Sparse dot products of documents with their distinct features."""
    total = np.bincount(doc, weights=weights[features], minlength=n_docs) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0)))
