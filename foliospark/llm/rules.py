"""Ordered rule lists by incremental reduced-error pruning, and their form as SQL.

A rule is a conjunction of thresholds on numeric statistics. Rules are learnt for one class after
another, rarest first, each on what the rules before leave: grown on two thirds of the cases by
information gain, pruned on the rest, and kept as long as it is right more often than not there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Condition:
    column: str
    above: bool
    bound: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return columns[self.column] >= self.bound if self.above else columns[self.column] <= self.bound

    def sql(self) -> str:
        return f"{self.column} {'>=' if self.above else '<='} {self.bound!r}"


@dataclass(frozen=True)
class Rule:
    label: str
    conditions: tuple[Condition, ...]

    def covers(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(columns.values()))), bool)
        for c in self.conditions:
            out &= c.holds(columns)
        return out


@dataclass(frozen=True)
class RuleList:
    rules: tuple[Rule, ...]
    default: str

    def case(self) -> str:
        """The list as a SQL CASE expression; the first rule that holds decides."""
        whens = "".join(f" WHEN {' AND '.join(c.sql() for c in r.conditions)} THEN '{r.label}'" for r in self.rules)
        return f"CASE{whens} ELSE '{self.default}' END" if whens else f"'{self.default}'"

    def conditions(self) -> str:
        """SQL that is true where any rule holds."""
        return " OR ".join("(" + " AND ".join(c.sql() for c in r.conditions) + ")" for r in self.rules) or "FALSE"

    def predict(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(next(iter(columns.values()))), self.default, object)
        for r in reversed(self.rules):
            out[r.covers(columns)] = r.label
        return out


def _bounds(x: np.ndarray, most: int = 60) -> np.ndarray:
    """Thresholds between values: all, or ``most`` evenly by rank with as many close to either end."""
    values = np.unique(x)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) <= 3 * most:
        return middles
    near = np.geomspace(1, len(middles) - 1, most).astype(int) - 1
    even = np.linspace(0, len(middles) - 1, most).astype(int)
    return middles[np.unique(np.r_[near, even, len(middles) - 1 - near])]


def _grow(columns: dict[str, np.ndarray], yes: np.ndarray, most: int = 6) -> list[Condition]:
    inside, out = np.ones(len(yes), bool), []
    while len(out) < most and (inside & ~yes).any():
        p0, n0 = (inside & yes).sum(), (inside & ~yes).sum()
        best, gain = None, 1e-9
        for name, x in columns.items():
            v, y = x[inside], yes[inside]
            at = _bounds(v)
            if not len(at):
                continue
            vp, vn = np.sort(v[y]), np.sort(v[~y])
            p_le, n_le = np.searchsorted(vp, at, "right"), np.searchsorted(vn, at, "right")
            for above, p, n in ((False, p_le, n_le), (True, p0 - p_le, n0 - n_le)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -1)
                ties = np.flatnonzero(g == g.max())
                k = int(ties[len(ties) // 2])  # amid thresholds that separate the cases equally
                if g[k] > gain:
                    best, gain = Condition(name, above, float(at[k])), float(g[k])
        if best is None:
            break
        out.append(best)
        inside &= best.holds(columns)
    return out


def _one(columns: dict[str, np.ndarray], yes: np.ndarray, label: str, rng: np.random.Generator) -> Rule | None:
    """One rule grown on two thirds of either side and pruned on the rest."""
    to_grow = np.zeros(len(yes), bool)
    for side in (yes, ~yes):
        k = np.flatnonzero(side)
        to_grow[rng.permutation(k)[: math.ceil(len(k) * 2 / 3)]] = True
    grown = _grow({c: x[to_grow] for c, x in columns.items()}, yes[to_grow])
    rest, y = {c: x[~to_grow] for c, x in columns.items()}, yes[~to_grow]
    best, score = None, -math.inf
    for k in range(1, len(grown) + 1):
        rule = Rule(label, tuple(grown[:k]))
        inside = rule.covers(rest)
        p, n = (inside & y).sum(), (inside & ~y).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value > score:
            best, score = rule, value
    return best if score > 0 else None


def induce(columns: dict[str, np.ndarray], labels: np.ndarray, default: str, seed: int = 3, splits: int = 24, price: float = 3.0) -> RuleList:
    """A rule list for the classes of ``labels``; what no rule covers is ``default``.

    Labels may be wrong, and classes so rare that one split into growing and pruning cases says
    little: of the rules from ``splits`` splits the one is taken that is worth most on all cases
    left, a wrong case costing ``price`` right ones; a class is done when no rule is worth 3.
    """
    rng = np.random.default_rng(seed)
    names, counts = np.unique(labels[labels != default], return_counts=True)
    left, rules = np.ones(len(labels), bool), []
    for label in names[np.argsort(counts, kind="stable")]:
        while True:
            at = np.flatnonzero(left)
            yes = labels[at] == label
            if yes.sum() < 3:
                break
            here = {c: x[at] for c, x in columns.items()}
            best, worth, covered = None, 2.999, None
            for _ in range(splits):
                rule = _one(here, yes, label, rng)
                if rule is None:
                    continue
                inside = rule.covers(here)
                value = (inside & yes).sum() - price * (inside & (labels[at] == default)).sum() - (inside & ~yes & (labels[at] != default)).sum() / 2
                if value > worth:
                    best, worth, covered = rule, value, inside
            if best is None:
                break
            rules.append(best)
            left[at[covered]] = False
    return RuleList(tuple(rules), default)
