"""Settings proposed one round after another by densities of good and other trials (a tree-structured Parzen estimator).

The better quarter of the trials and the others are each turned into a density per setting: for a number, normal bumps at the tried places, as
wide as the gap to the next ones, and a flat part that keeps every place possible; for a choice, smoothed counts. Draws from the density of the good ones are ranked
by the ratio of both densities. Trials of a round run at the same time, so those proposed but not yet measured count with the others.

Defined cases: a setting with equal ends has one value; whole numbers stay whole; nothing is proposed twice, so a space that is used up gives
fewer proposals; an objective that is not a number (a fit that failed) counts as worse than all others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np

#: Share of the trials that counts as good.
GOOD = 0.25
#: Draws ranked for one proposal.
DRAWS = 64


@dataclass(frozen=True)
class Axis:
    """A setting: a range of numbers as places from 0 to 1, or choices as places 0, 1, 2, ..."""

    name: str
    given: list[Any]

    @property
    def numeric(self) -> bool:
        return len(self.given) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in self.given)

    @property
    def wide(self) -> bool:
        """Ends a decade or more apart: even ratios instead of even steps."""
        return min(self.given) > 0 and max(self.given) / min(self.given) >= 10

    def value(self, place: float) -> Any:
        if not self.numeric:
            return self.given[int(place)]
        lo, hi = min(self.given), max(self.given)
        v = lo * (hi / lo) ** place if self.wide else lo + (hi - lo) * place
        return round(v) if all(isinstance(g, int) for g in self.given) else min(max(v, lo), hi)

    def place(self, value: Any) -> float:
        if not self.numeric:
            return float(self.given.index(value))
        lo, hi = min(self.given), max(self.given)
        if lo == hi:
            return 0.0
        return math.log(value / lo) / math.log(hi / lo) if self.wide else (value - lo) / (hi - lo)


class _Density:
    def __init__(self, axis: Axis, places: list[float]):
        self.axis, self.at = axis, np.sort(np.array(places, float))
        n = len(self.at)
        if axis.numeric:
            edges = np.concatenate([[0.0], self.at, [1.0]])
            self.wide = np.clip(np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1]), 1 / (n + 1) ** 2 if n else 1, 0.5)
        else:
            counts = np.bincount(self.at.astype(int), minlength=len(axis.given)) + 1 / len(axis.given)
            self.share = counts / counts.sum()

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        if not self.axis.numeric:
            return rng.choice(len(self.share), n, p=self.share).astype(float)
        out = rng.random(n)
        bump = rng.integers(-1, len(self.at), n)
        some = bump >= 0
        out[some] = rng.normal(self.at[bump[some]], self.wide[bump[some]])
        # what falls beyond an end is reflected
        out = np.abs(out)
        return np.clip(np.where(out > 1, 2 - out, out), 0, 1)

    def log(self, places: np.ndarray) -> np.ndarray:
        if not self.axis.numeric:
            return np.log(self.share[places.astype(int)])
        total = np.ones(len(places))
        for mirror in (places, -places, 2 - places):
            z = (mirror[:, None] - self.at[None, :]) / self.wide[None, :] if len(self.at) else np.zeros((len(places), 0))
            total += (np.exp(-z * z / 2) / (self.wide * math.sqrt(2 * math.pi)) if len(self.at) else z).sum(axis=1)
        return np.log(total / (1 + len(self.at)))


def _key(setting: dict[str, Any]) -> str:
    return repr(sorted((k, repr(v)) for k, v in setting.items()))


def _even(axes: list[Axis], k: int) -> dict[str, Any]:
    """The k-th of a sequence of evenly spread settings: multiples of a fixed irrational step per axis."""
    step = 2.0
    for _ in range(32):
        step = (1 + step) ** (1 / (len(axes) + 1))
    out = {}
    for i, a in enumerate(axes):
        at = (0.5 + (k + 1) * step ** -(i + 1)) % 1
        out[a.name] = a.value(at if a.numeric else int(at * len(a.given)))
    return out


def propose(space: dict[str, list[Any]], seen: list[tuple[dict[str, Any], float]], n: int, *, larger: bool = True, start: int = 8, seed: int = 7) -> list[dict[str, Any]]:
    """Up to `n` new settings; the first `start` trials are spread evenly, later ones follow the objectives of `seen`."""
    axes = [Axis(k, list(v)) for k, v in space.items()]
    rng = np.random.default_rng([seed, len(seen)])
    worst = -math.inf
    ranked = sorted(seen, key=lambda t: worst if not math.isfinite(t[1]) else t[1] if larger else -t[1], reverse=True)
    good = [s for s, _ in ranked[:max(1, math.ceil(GOOD * len(ranked)))]]
    other = [s for s, _ in ranked[len(good):]]
    known = {_key(s) for s, _ in seen}
    out: list[dict[str, Any]] = []
    while len(out) < n:
        if len(seen) + len(out) < start or not seen:
            drawn = [_even(axes, len(seen) + len(out) + k) for k in range(DRAWS)]
        else:
            best, rest = ([_Density(a, [a.place(s[a.name]) for s in some]) for a in axes] for some in (good, other + out))
            places = [b.draw(rng, DRAWS) for b in best]
            gain = sum(b.log(p) - r.log(p) for b, r, p in zip(best, rest, places))
            drawn = [{a.name: a.value(float(p[i])) for a, p in zip(axes, places)} for i in np.argsort(-gain, kind="stable").tolist()]
        fresh = next((s for s in drawn if _key(s) not in known), None)
        if fresh is None:  # a small space that is nearly used up: whatever is left of it
            fresh = next((s for s in (_even(axes, k) for k in range(1024)) if _key(s) not in known), None)
            if fresh is None:
                break
        known.add(_key(fresh))
        out.append(fresh)
    return out
