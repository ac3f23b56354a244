"""Violations of one payload: the rule book that the native compiler (compile.py) mirrors column by column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from ..contract import Contract, Field
from ..functions.values import fits, fits_member, type_name

MISSING_FIELD, UNEXPECTED, NULL, STRUCTURE, TYPE, VALUE = (
    "missing_required_field", "unexpected_field", "null_not_allowed", "structural_mismatch", "type_mismatch", "value_constraint"
)


@dataclass(frozen=True)
class Violation:
    path: str
    kind: str
    severity: str
    expected: str | None = None
    received: str | None = None

    @property
    def signature(self) -> tuple[str, str, str]:
        return self.path, self.kind, self.severity


@lru_cache(1024)
def _pattern(text: str):
    return re.compile(text)


def breaks(kind: str, bound: Any, value: Any) -> bool:
    """Whether a value breaks one constraint; constraints that don't apply to its type are kept."""
    if kind in ("minimum", "maximum"):
        return isinstance(value, (int, float)) and (value < bound if kind == "minimum" else value > bound)
    if kind in ("min_length", "max_length"):
        return isinstance(value, (str, list, dict)) and (len(value) < bound if kind == "min_length" else len(value) > bound)
    if kind == "pattern":
        return isinstance(value, str) and _pattern(bound).match(value) is None
    if kind == "enum_values":
        try:
            return value not in bound
        except TypeError:
            return True
    return False


def _limits(f: Field, path: str, value: Any) -> list[Violation]:
    return [Violation(path, VALUE, "error", f"{c.kind}={c.value!r}", type_name(value)) for c in f.constraints if breaks(c.kind, c.value, value)]


def _field(f: Field, path: str, value: Any) -> list[Violation]:
    if value is None:
        return [Violation(path, NULL, "error", f.type, "null")] if f.limit("not_null") else []
    if f.type == "object":
        if not isinstance(value, dict):
            return [Violation(path, STRUCTURE, "error", "object", type_name(value))]
        return check(f.nested, value, path + ".") if f.nested else []
    if f.type == "array":
        if not isinstance(value, list):
            return [Violation(path, TYPE, "error", "array", type_name(value))]
        bad = next((x for x in value if not fits(x, f.item_type)), None) if f.item_type else None
        wrong = f.item_type and any(not fits(x, f.item_type) for x in value)
        return [*([Violation(path, TYPE, "error", f.item_type, type_name(bad))] if wrong else []), *_limits(f, path, value)]
    if f.type == "union" and f.members:
        if not any(fits_member(value, m) for m in f.members):
            return [Violation(path, TYPE, "error", "union", type_name(value))]
    elif not fits(value, f.type):
        return [Violation(path, TYPE, "error", f.type, type_name(value))]
    return _limits(f, path, value)


def check(contract: Contract, payload: dict, prefix: str = "") -> list[Violation]:
    """All violations: declared fields in order, then undeclared keys."""
    out = []
    known = contract.names()
    for name, f in known.items():
        if name in payload:
            out += _field(f, prefix + name, payload[name])
        elif f.required:
            out.append(Violation(prefix + name, MISSING_FIELD, "error", f.type))
    severity = "error" if contract.strict else "warning"
    return out + [Violation(prefix + k, UNEXPECTED, severity, None, type_name(v)) for k, v in payload.items() if k not in known]


ROOT = Violation("", STRUCTURE, "error", "object")


def merged(adapter: list[Violation], core: list[Violation]) -> list[Violation]:
    """An adapter's own violations, and the core's whose path and kind it does not have."""
    seen = {(v.path, v.kind) for v in adapter}
    return [*adapter, *(v for v in core if (v.path, v.kind) not in seen)]


def first_per_key(violations: list[Violation]) -> list[Violation]:
    """The first of each path and kind, in the order of their first occurrence."""
    firsts: dict[tuple[str, str], Violation] = {}
    for v in violations:
        firsts.setdefault((v.path, v.kind), v)
    return list(firsts.values())
