"""Comparing field names: normal forms, Jaro-Winkler similarity, one-to-one assignment with margins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

FLOOR = 0.5
#: Removed from field names / made underscores in enum values.
_DROPPED = str.maketrans("", "", "_- ")
_JOINED = str.maketrans("- ", "__")


@lru_cache(8192)
def normal_name(path: str) -> str:
    return path.rpartition(".")[2].casefold().strip().translate(_DROPPED)


@lru_cache(8192)
def normal_value(value: str) -> str:
    return value.casefold().strip().translate(_JOINED)


def spelling_fidelity(received: str, member: str) -> float:
    """How much of a value's spelling the member keeps: case alone, outer white space too, or separators."""
    if received.casefold() == member.casefold():
        return 1.0
    return 0.95 if received.strip().casefold() == member.casefold() else 0.85


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    of_a: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                of_a.append(c)
                break
    m = len(of_a)
    if not m:
        return 0.0
    of_b = [c for c, unused in zip(b, free, strict=True) if not unused]
    swaps = sum(x != y for x, y in zip(of_a, of_b, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@lru_cache(65536)
def jaro_winkler(a: str, b: str) -> float:
    """Case-blind; a common prefix of up to four characters always counts."""
    a, b = a.lower(), b.lower()
    j, prefix = jaro(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return j + 0.1 * prefix * (1 - j)


@dataclass(frozen=True)
class Match:
    missing: str
    found: str
    score: float
    margin: float
    alternatives: int
    rival: str | None = None


@lru_cache(8192)
def assign(missing: tuple[str, ...], found: tuple[str, ...]) -> tuple[Match, ...]:
    """One-to-one pairs, best first (ties: the greater names); margins count every rival, taken ones too.

    Depends on the two sets of names only, so it is solved once per distinct shape, not per row.
    """
    grid = {(m, f): jaro_winkler(m, f) for m in missing for f in found}
    top: dict[str, list[float]] = {}
    for (m, f), s in grid.items():
        top.setdefault("m" + m, []).append(s)
        top.setdefault("f" + f, []).append(s)
    for scores in top.values():
        scores.sort(reverse=True)
    out, used = [], set()
    for (m, f), s in sorted(grid.items(), key=lambda x: (x[1], x[0]), reverse=True):
        if "m" + m in used or "f" + f in used:
            continue
        used |= {"m" + m, "f" + f}
        if s < FLOOR:
            continue
        lead = []
        for side in (top["m" + m], top["f" + f]):
            if len(side) > 1:
                lead.append(max(0.0, s - (side[1] if side[0] == s else side[0])))
        # the runner-up: the other name, on either side, that comes nearest to taking this one's place
        others = [(grid[m, x], x) for x in found if x != f] + [(grid[x, f], x) for x in missing if x != m]
        out.append(Match(m, f, s, min(lead, default=1.0), len(missing) + len(found) - 1, max(others)[1] if others else None))
    return tuple(out)
