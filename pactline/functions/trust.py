"""How far evidence carries: trust from measured evidence, decisions by risk."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import functions as F

# Risk -> (reject below, apply from); and what a tie leaves of a score.
BANDS = {"reversible": (0.50, 0.70), "declared": (0.0, 0.0), "inferred": (0.60, 0.75), "lossy": (0.70, 0.95), "destructive": (0.0, 1.01)}
TIE_FACTOR = 0.70
APPLY, AMBIGUOUS, REJECT = "apply", "ambiguous", "reject"


@dataclass(frozen=True)
class Evidence:
    name: float | None = None
    value: float | None = None
    authority: float | None = None
    margin: float | None = None
    alternatives: int = 0
    structure: float = 1.0


@dataclass(frozen=True)
class Policy:
    bands: tuple[tuple[str, tuple[float, float]], ...] = tuple(BANDS.items())
    full_margin: float = 0.15
    floor: float = 0.0
    tie_factor: float = TIE_FACTOR

    @classmethod
    def of(cls, bands: dict | None = None, full_margin: float = 0.15, floor: float = 0.0, tie_factor: float = TIE_FACTOR) -> Policy:
        merged = BANDS | (bands or {})
        for risk, (low, high) in merged.items():
            if low > high:
                raise ValueError(f"inverted band for {risk}")
        return cls(tuple(merged.items()), full_margin, floor, tie_factor)

    def score(self, e: Evidence | None) -> float:
        told = [x for x in (e.authority, e.name, e.value) if x is not None] if e else []
        if not told:
            return 0.0
        factor = 1.0 if e.margin is None else self.tie_factor + (1 - self.tie_factor) * min(1.0, e.margin / self.full_margin)
        return min(told) * factor

    def cuts(self, risk: str) -> tuple[float, float]:
        return _cuts(self, risk)

    def decide(self, risk: str, trust: float) -> str:
        low, high = self.cuts(risk)
        return APPLY if trust >= high else REJECT if trust < low else AMBIGUOUS

    def score_column(self, name=None, value=None, authority=None, margin=None):
        """score() as a column of columns; what is null has no evidence."""
        told = [c for c in (authority, name, value) if c is not None]
        if not told:
            return F.lit(0.0)
        least = F.least(*told) if len(told) > 1 else told[0]
        factor = F.lit(1.0) if margin is None else F.coalesce(self.tie_factor + (1 - self.tie_factor) * F.least(F.lit(1.0), margin / self.full_margin), F.lit(1.0))
        return F.coalesce(least, F.lit(0.0)) * factor

    def decision_column(self, risk, trust):
        """decide() as a column; an unknown risk has no decision."""
        out = None
        for name, _ in self.bands:
            low, high = self.cuts(name)
            said = F.when(trust >= high, APPLY).when(trust < low, REJECT).otherwise(AMBIGUOUS)
            out = F.when(risk == name, said) if out is None else out.when(risk == name, said)
        return out

    def explain(self, risk: str, e: Evidence, trust: float) -> str:
        """Evidence and effective cut-points in words; never values."""
        low, high = self.cuts(risk)
        told = [f"{k} {v:.3f}" for k, v in (("authority", e.authority), ("name", e.name), ("value", e.value), ("margin", e.margin)) if v is not None]
        return f"{risk}: trust {trust:.3f} from {', '.join(told) or 'no evidence'}; rejected below {low:.2f}, applied from {high:.2f}"


@lru_cache(256)
def _cuts(policy: Policy, risk: str) -> tuple[float, float]:
    low, high = dict(policy.bands)[risk]
    return low, max(high, policy.floor)
