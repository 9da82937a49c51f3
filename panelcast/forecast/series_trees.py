"""Gradient-boosted regression trees, one model per series, grown for a batch of series at once.

Second-order boosting of squared errors: every tree is grown level by level; a split's gain is the rise of
G^2 / (H + l2) over both sides, found on histograms of at most ``BINS`` bins per series and feature, which is an exact search
while a feature has no more different values. Histograms of all nodes of all series of a batch are one ``bincount``.

A tree is a full binary tree of fixed depth in flat arrays. A node that does not split sends everything left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 256


@dataclass
class Trees:
    """Arrays over (series, tree, node): ``feature``, ``threshold`` of inner nodes, ``value`` of leaves; ``base`` by series."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: np.ndarray

    def predict(self, series: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Prediction of every row of ``x`` by the model of its series."""
        rounds, inner = self.feature.shape[1:]
        depth = (inner + 1).bit_length() - 1
        tree, row = np.arange(rounds)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), rounds), np.int64)
        for _ in range(depth):
            f = self.feature[series[:, None], tree, node]
            right = x[row, f] > self.threshold[series[:, None], tree, node]
            node = 2 * node + 1 + right
        return self.base[series] + self.value[series[:, None], tree, node - inner].sum(1)


def binned(series: np.ndarray, x: np.ndarray, n_series: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every value within its series and feature, and the upper edge of every bin (series, feature, bin).

    An edge lies half way between the values on its two sides; the last bin of a series has no edge (infinity).
    """
    n, width = x.shape
    code = np.zeros((n, width), np.int64)
    edges = np.full((n_series, width, bins), np.inf)
    for f in range(width):
        order = np.lexsort((x[:, f], series))
        s, v = series[order], x[order, f]
        first = np.concatenate(([True], s[1:] != s[:-1]))
        step = np.concatenate(([False], v[1:] != v[:-1])) & ~first
        rank = np.cumsum(step)
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
        rank = rank - np.repeat(rank[start], size)
        distinct = np.repeat(rank[start + size - 1] + 1, size)
        bin_ = np.where(distinct > bins, rank * bins // distinct, rank)
        code[order, f] = bin_
        cut = np.flatnonzero(~first & (bin_ != np.concatenate(([0], bin_[:-1]))))
        edges[s[cut], f, bin_[cut - 1]] = (v[cut - 1] + v[cut]) / 2
    return code, edges


def fit_trees(
    series: np.ndarray, x: np.ndarray, y: np.ndarray, n_series: int, rounds: int = 100, rate: float = 0.05, depth: int = 5,
    l2: float = 1.0, least_rows: float = 1.0, bins: int = BINS,
) -> Trees:
    """Fit ``rounds`` trees to the rows of every series; ``series`` numbers the series of each row."""
    n, width = x.shape
    count = np.bincount(series, minlength=n_series)
    base = np.bincount(series, weights=y, minlength=n_series) / np.maximum(count, 1)
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = Trees(
        np.zeros((n_series, rounds, inner), np.int8), np.full((n_series, rounds, inner), np.inf),
        np.zeros((n_series, rounds, leaves)), base)
    bins = min(bins, int(count.max(initial=1)))
    code, edges = binned(series, x, n_series, bins)
    loss_slope = base[series] - y
    for t in range(rounds):
        node = np.zeros(n, np.int64)  # number within the level
        for level in range(depth):
            nodes = 1 << level
            place = series * nodes + node
            cells = n_series * nodes
            best_gain, best_feature, best_bin = np.zeros(cells), np.zeros(cells, np.int64), np.full(cells, bins - 1)
            total = np.bincount(place, weights=loss_slope, minlength=cells)
            weight = np.bincount(place, minlength=cells).astype(float)
            before = total * total / (weight + l2)
            for f in range(width):
                at = place * bins + code[:, f]
                g = np.bincount(at, weights=loss_slope, minlength=cells * bins).reshape(cells, bins).cumsum(1)
                h = np.bincount(at, minlength=cells * bins).reshape(cells, bins).cumsum(1)
                rest_g, rest_h = total[:, None] - g, weight[:, None] - h
                gain = g * g / (h + l2) + rest_g * rest_g / (rest_h + l2)
                gain[(h < least_rows) | (rest_h < least_rows)] = -np.inf
                b = gain.argmax(1)
                rise = gain[np.arange(cells), b] - before
                better = rise > best_gain + 1e-12 * (1 + np.abs(before))
                best_gain[better], best_feature[better], best_bin[better] = rise[better], f, b[better]
            split = best_gain > 0
            of = np.arange(cells) // nodes
            first = nodes - 1
            feature, threshold = (a.reshape(n_series, nodes) for a in (
                best_feature, np.where(split, edges[of, best_feature, best_bin], np.inf)))
            out.feature[:, t, first:first + nodes] = feature
            out.threshold[:, t, first:first + nodes] = threshold
            right = split[place] & (code[np.arange(n), best_feature[place]] > best_bin[place])
            node = 2 * node + right
        place = series * leaves + node
        g = np.bincount(place, weights=loss_slope, minlength=n_series * leaves)
        h = np.bincount(place, minlength=n_series * leaves)
        value = -rate * g / (h + l2)
        out.value[:, t] = value.reshape(n_series, leaves)
        loss_slope = loss_slope + value[place]
    return out
