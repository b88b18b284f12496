"""ARMA models in state-space form: exact likelihood and forecasts.

Harvey's form: the first state is the deviation from the mean, the others carry
what past values and shocks will add later.  The Kalman filter starts from the
stationary state covariance (the solution of ``P = T P T' + R R'``), so its
innovations give the exact Gaussian likelihood of the sample, not one that
conditions on its first values.  Where the autoregressive part is not stationary
there is no such covariance: a wide prior takes its place and the innovations
that still depend on it are left out.  Sizes are the model's lags and the
series' length, both bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDE = 1e7


def system(phi: dict[int, float], theta: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix and shock loading for AR and MA coefficients by lag."""
    r = max([1, *phi, *(q + 1 for q in theta)])
    t = np.eye(r, k=1)
    load = np.zeros(r)
    load[0] = 1.0
    for lag, c in phi.items():
        t[lag - 1, 0] = c
    for lag, c in theta.items():
        load[lag] = c
    return t, load


def stationary_covariance(t: np.ndarray, load: np.ndarray) -> np.ndarray | None:
    """Solution of P = T P T' + R R' by doubling; None where T is not stable."""
    if max(abs(np.linalg.eigvals(t))) >= 1 - 1e-8:
        return None
    p, a = np.outer(load, load), t.copy()
    for _ in range(60):
        step = a @ p @ a.T
        p = p + step
        if np.abs(step).max() <= 1e-15 * np.abs(p).max():
            break
        a = a @ a
    return (p + p.T) / 2


@dataclass
class Filtered:
    """Innovations ``v`` with relative variances ``f``; ``skip`` first ones depend on
    a wide prior.  ``state`` and ``cov`` are those of the next period."""

    v: np.ndarray
    f: np.ndarray
    skip: int
    state: np.ndarray
    cov: np.ndarray
    t: np.ndarray
    mean: float

    @property
    def sigma2(self) -> float:
        """Shock variance of greatest likelihood for these coefficients."""
        v, f = self.v[self.skip:], self.f[self.skip:]
        return float(np.mean(v * v / f)) if len(v) else 0.0

    def log_likelihood(self, sigma2: float | None = None) -> float:
        s2 = self.sigma2 if sigma2 is None else sigma2
        v, f = self.v[self.skip:], self.f[self.skip:]
        return float(-0.5 * np.sum(np.log(2 * np.pi * s2 * f) + v * v / (s2 * f)))

    def ahead(self, horizon: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and joint relative covariance of the next values."""
        means, covs = np.zeros(horizon), np.zeros((horizon, horizon))
        a, p = self.state, self.cov
        for i in range(horizon):
            means[i] = self.mean + a[0]
            right = p[0].copy()  # covariance of this value with later states
            for j in range(i, horizon):
                covs[i, j] = covs[j, i] = right[0]
                right = self.t @ right
            a, p = self.t @ a, self.t @ p @ self.t.T + self._shock
        return means, covs

    _shock: np.ndarray | None = None


def kalman(w: np.ndarray, const: float, phi: dict[int, float], theta: dict[int, float]) -> Filtered:
    """Filter ``w_t = const + sum phi w + e_t + sum theta e`` with unit shocks."""
    t, load = system(phi, theta)
    shock = np.outer(load, load)
    p = stationary_covariance(t, load)
    skip = 0
    if p is None:
        skip, p = min(len(w), len(load)), np.eye(len(load)) * WIDE
    rest = 1.0 - sum(phi.values())
    mean = const / rest if abs(rest) > 1e-8 else float(np.mean(w)) if len(w) else 0.0
    a = np.zeros(len(load))
    v, f = np.zeros(len(w)), np.zeros(len(w))
    for i, x in enumerate(w):
        v[i], f[i] = x - mean - a[0], max(p[0, 0], 1e-12)
        gain = p[:, 0] / f[i]
        a = t @ (a + gain * v[i])
        p = p - np.outer(gain, p[0])
        p = t @ ((p + p.T) / 2) @ t.T + shock
    return Filtered(v, f, skip, a, p, t, mean, shock)
