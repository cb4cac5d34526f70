"""Logistic regression on sparse 0/1 features, fitted on a bounded sample."""

import numpy as np


class Sparse:
    """Rows of feature numbers (a text's distinct words) with a few dense columns beside them."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, rows: int, features: int):
        self.row, self.feature, self.rows, self.features = row, feature, rows, features

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.feature], self.rows)

    def transposed(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, values[self.row], self.features)

    def take(self, keep: np.ndarray) -> "Sparse":
        """The rows where ``keep`` holds, renumbered."""
        number = np.cumsum(keep) - 1
        inside = keep[self.row]
        return Sparse(number[self.row[inside]], self.feature[inside], int(keep.sum()), self.features)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def minimise(value_and_slope, start: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    x = start
    f, g = value_and_slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < 1e-6 * max(1.0, abs(f)):
            break
        d, alphas = -g, []
        for s, y in reversed(pairs):
            alphas.append(s @ d / (s @ y))
            d = d - alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y / (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            d = d + s * (alpha - y @ d / (s @ y))
        step, slope = 1.0, g @ d
        while step > 1e-10:
            new_f, new_g = value_and_slope(x + step * d)
            if new_f <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_g - g
        x, f, g = x + s, new_f, new_g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
    return x


def fit(words: Sparse, dense: np.ndarray, target: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of the features, then of the dense columns, then the intercept."""
    n, k = words.features, dense.shape[1]

    def value_and_slope(x):
        z = words.times(x[:n]) + dense @ x[n : n + k] + x[-1]
        loss = np.logaddexp(0, z).sum() - (z * target).sum() + penalty / 2 * (x[:-1] ** 2).sum()
        error = sigmoid(z) - target
        slope = np.r_[words.transposed(error), dense.T @ error, error.sum()]
        slope[:-1] += penalty * x[:-1]
        return loss, slope

    return minimise(value_and_slope, np.zeros(n + k + 1))


def margin(words: Sparse, dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = words.features
    return words.times(weights[:n]) + dense @ weights[n:-1] + weights[-1]
