"""Running moments and exponential smoothing over numpy arrays.

These are the per-batch kernels of `operators.baseline`: no loop over values,
only over chunks of `CHUNK` values. Notation: d = 1 - alpha,

    m[i] = alpha * x[i] + d * m[i-1]
    v[i] = alpha * (x[i] - m[i])**2 + d * v[i-1]
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CHUNK = 128


@lru_cache(maxsize=16)
def _response(alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """How a chunk's outputs depend on its inputs, and on the value carried in."""
    step = np.arange(CHUNK)
    lag = step[:, None] - step[None, :]
    weights = np.where(lag >= 0, alpha * (1.0 - alpha) ** np.maximum(lag, 0), 0.0)
    return weights.T.copy(), (1.0 - alpha) ** (step + 1)


def smooth(values: np.ndarray, start: float, alpha: float) -> np.ndarray:
    """The smoothed series, `start` being its value before the first input."""
    count = len(values)
    if count == 0:
        return np.empty(0)
    weights, fade = _response(alpha)
    chunks = -(-count // CHUNK)
    padded = np.zeros(chunks * CHUNK)
    padded[:count] = values
    out = padded.reshape(chunks, CHUNK) @ weights
    carried = start
    for row in out:
        row += carried * fade
        carried = row[-1]
    return out.reshape(-1)[:count]


@dataclass
class Moments:
    """Count, mean and sum of squared deviations; two of them merge exactly."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def running(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, mean and squared-deviation sum after each further value."""
        k = np.arange(1, len(values) + 1, dtype=np.float64)
        origin = values[0] if len(values) else 0.0
        shifted = values - origin
        total = np.cumsum(shifted)
        own_mean = total / k
        own_m2 = np.maximum(np.cumsum(shifted * shifted) - total * own_mean, 0.0)
        if self.n == 0:
            return k, origin + own_mean, own_m2
        gap = origin + own_mean - self.mean
        n = self.n + k
        return n, self.mean + gap * k / n, self.m2 + own_m2 + gap * gap * self.n * k / n

    def extend(self, values: np.ndarray) -> Moments:
        if len(values) == 0:
            return self
        mean = float(values.mean())
        other = Moments(len(values), mean, float(((values - mean) ** 2).sum()))
        return self.merge(other)

    def merge(self, other: Moments) -> Moments:
        if other.n == 0:
            return self
        if self.n == 0:
            return other
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * other.n / n,
            self.m2 + other.m2 + gap * gap * self.n * other.n / n,
        )

    @property
    def variance(self) -> float:
        return self.m2 / self.n if self.n > 1 else 0.0


@dataclass
class Drift:
    """What a stretch of values does to a smoothed (mean, variance) pair, whatever comes in.

    With u = incoming mean - origin:
        outgoing mean - origin = a * u + b
        outgoing variance      = q * incoming variance + c0 + c1 * u + c2 * u**2
    """

    origin: float
    a: float = 1.0
    b: float = 0.0
    q: float = 1.0
    c0: float = 0.0
    c1: float = 0.0
    c2: float = 0.0

    def then(self, values: np.ndarray, alpha: float) -> Drift:
        """This stretch followed by further values."""
        n = len(values)
        if n == 0:
            return self
        d = 1.0 - alpha
        shifted = values - self.origin
        b = smooth(shifted, 0.0, alpha)
        residual = shifted - b
        power = d ** np.arange(1, n + 1)
        weight = alpha * d ** np.arange(n - 1, -1, -1)
        fade = power[-1]
        next_b = float(b[-1])
        k0 = float(weight @ (residual * residual))
        k1 = float(-2.0 * (weight * power) @ residual)
        k2 = float((weight * power) @ power)
        return Drift(
            self.origin,
            fade * self.a,
            fade * self.b + next_b,
            fade * self.q,
            fade * self.c0 + k0 + k1 * self.b + k2 * self.b**2,
            fade * self.c1 + k1 * self.a + 2.0 * k2 * self.a * self.b,
            fade * self.c2 + k2 * self.a**2,
        )

    def apply(self, mean: float, variance: float) -> tuple[float, float]:
        u = mean - self.origin
        return (
            self.origin + self.a * u + self.b,
            self.q * variance + self.c0 + self.c1 * u + self.c2 * u * u,
        )


@dataclass
class Baseline:
    """A learned mean and variance: running moments first, smoothed ones once warmed up."""

    moments: Moments
    mean: float = 0.0
    variance: float = 1.0
    warm: bool = False

    @classmethod
    def fresh(cls) -> Baseline:
        return cls(Moments())

    @classmethod
    def unpack(cls, packed: str) -> Baseline:
        n, mean, m2, smooth_mean, smooth_variance, warm = map(float, packed.split(","))
        return cls(Moments(int(n), mean, m2), smooth_mean, smooth_variance, bool(warm))

    def pack(self) -> str:
        m = self.moments
        cells = (m.n, m.mean, m.m2, self.mean, self.variance, self.warm)
        return ",".join(repr(float(x)) for x in cells)

    def seed_if_ready(self, min_samples: int) -> None:
        if not self.warm and self.moments.n >= min_samples:
            self.mean = self.moments.mean
            self.variance = self.moments.variance or 1.0
            self.warm = True

    def feed(self, values: np.ndarray, min_samples: int, alpha: float) -> dict[str, np.ndarray]:
        """Take in values in order; per value the state right after it and right before it."""
        n, mean, m2 = self.moments.running(values)
        count = len(values)
        out = {
            "n": n,
            "run_mean": mean,
            "run_var": np.where(n > 1, m2 / n, 0.0),
            "mean": np.full(count, np.nan),
            "var": np.full(count, np.nan),
            "mean_before": np.full(count, np.nan),
            "var_before": np.full(count, np.nan),
        }
        cold = 0 if self.warm else min(max(min_samples - self.moments.n, 0), count)
        if cold:
            self.moments = self.moments.extend(values[:cold])
            self.seed_if_ready(min_samples)
            if self.warm:
                out["mean"][cold - 1], out["var"][cold - 1] = self.mean, self.variance
        rest = values[cold:]
        if len(rest):
            means = smooth(rest, self.mean, alpha)
            variances = smooth((rest - means) ** 2, self.variance, alpha)
            out["mean"][cold:], out["var"][cold:] = means, variances
            out["mean_before"][cold:] = np.concatenate(([self.mean], means[:-1]))
            out["var_before"][cold:] = np.concatenate(([self.variance], variances[:-1]))
            self.mean, self.variance = float(means[-1]), float(variances[-1])
            self.moments = self.moments.extend(rest)
        return out
