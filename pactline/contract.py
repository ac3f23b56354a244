"""Contracts: what fields a payload has, of what types, under which constraints."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T


VERSION = "0.2.0"


class _Missing:
    """No default declared; a default of None is one."""

    def __bool__(self) -> bool:
        return False

    def __repr__(self) -> str:
        return "MISSING"

    def __reduce__(self):
        return "MISSING"


MISSING = _Missing()

# Names that contracts are written with.
TYPES = ("string", "bytes", "integer", "float", "boolean", "object", "array", "any", "null", "union")
CONSTRAINTS = ("minimum", "maximum", "min_length", "max_length", "pattern", "enum_values", "not_null")


@dataclass(frozen=True)
class Member:
    """One alternative of a union; an array's items may have a type."""

    type: str
    item_type: str | None = None

    def __post_init__(self):
        if self.type == "union":
            raise ValueError("a union cannot be a member of a union")


@dataclass(frozen=True)
class Constraint:
    kind: str
    value: Any

    def __post_init__(self):
        if self.kind not in CONSTRAINTS:
            raise ValueError(f"unknown constraint {self.kind!r}; valid are {', '.join(CONSTRAINTS)}")
        if self.kind == "pattern":
            re.compile(self.value)


@dataclass(frozen=True)
class Field:
    """One field; the last segment of path is its name in the object that holds it."""

    path: str
    type: str
    required: bool = True
    default: Any = MISSING
    constraints: tuple[Constraint, ...] = ()
    aliases: tuple[str, ...] = ()
    item_type: str | None = None
    nested: Contract | None = None
    members: tuple[Member, ...] = ()

    def __post_init__(self):
        for kind in (self.type, self.item_type):
            if kind is not None and kind not in TYPES:
                raise ValueError(f"unknown type {kind!r}; valid are {', '.join(TYPES)}")

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]

    def limit(self, kind: str) -> Any:
        """The bound of the first constraint of a kind, or None."""
        return next((c.value for c in self.constraints if c.kind == kind), None)


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    strict: bool = False
    source: str | None = None
    contract_id: str = ""

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        object.__setattr__(self, "_names", {f.name: f for f in self.fields})
        object.__setattr__(self, "_found", {})
        if not self.contract_id:
            told = ";".join([f"strict={int(self.strict)}", *(f"{f.path}:{f.type}:{int(f.required)}" for f in sorted(self.fields, key=lambda f: f.path))])
            object.__setattr__(self, "contract_id", hashlib.sha256(told.encode()).hexdigest()[:16])

    def with_strict(self, strict: bool) -> Contract:
        """The same contract under the configuration's strictness (nested levels keep theirs)."""
        return self if strict == self.strict else replace(self, strict=strict, contract_id="")

    def names(self) -> dict[str, Field]:
        return self._names


@dataclass(frozen=True)
class Config:
    """Limits and thresholds of a repair."""

    max_attempts: int = 6
    minimum_trust: float = 0.7
    collision_margin: float = 0.15
    allow_partial: bool = True
    strict: bool = False
    bands: dict = field(default_factory=dict)
    tie_factor: float = 0.70

    def __post_init__(self):
        if self.max_attempts < 1:
            raise ValueError("max_attempts must be at least 1")
        if not 0 < self.minimum_trust <= 1:
            raise ValueError("minimum_trust must be over 0 and at most 1")
        if not 0 < self.collision_margin < 1:
            raise ValueError("collision_margin must be between 0 and 1")
        if not 0 <= self.tie_factor <= 1:
            raise ValueError("tie_factor must be between 0 and 1")


def find_field(contract: Contract, path: str) -> Field | None:
    """The field that a dotted path leads to, by local names; declared paths are looked up once."""
    known = contract._found.get(path)
    if known is not None:
        return known
    found, level = None, contract
    for name in path.split("."):
        found = next((f for f in level.fields if f.path == name), None) if level else None
        if found is None:
            return None
        level = found.nested
    contract._found[path] = found
    return found


def _constraint(told: dict) -> Constraint:
    value = told.get("value")
    return Constraint(told["type"], tuple(value) if told["type"] == "enum_values" and isinstance(value, list) else value)


def _field(told: dict) -> Field:
    for key in ("path", "type"):
        if key not in told:
            raise ValueError(f"a field needs {key!r}")
    return Field(
        path=told["path"],
        type=told["type"],
        required=bool(told.get("required", True)),
        default=told.get("default", MISSING),
        constraints=tuple(_constraint(c) for c in told.get("constraints", ())),
        aliases=tuple(told.get("known_aliases", told.get("aliases", ()))),
        item_type=told.get("item_type"),
        nested=parse_contract(told["nested"]) if told.get("nested") is not None else None,
        members=tuple(Member(m["type"], m.get("item_type")) for m in told.get("members", ())),
    )


def parse_contract(told: Any) -> Contract:
    """A contract from its dictionary form: fields with path, type, required, default, constraints, aliases, nested."""
    if not isinstance(told, dict):
        raise TypeError(f"a contract is written as a dictionary, not {type(told).__name__}")
    if "fields" not in told:
        raise ValueError("a contract needs 'fields'")
    return Contract(tuple(_field(f) for f in told["fields"]), bool(told.get("strict_mode", False)), told.get("source_ref"), told.get("contract_id") or "")


def contract_of_schema(schema: T.StructType) -> Contract:
    """The contract that a DataFrame's schema amounts to: dates and timestamps are strings, maps are objects."""

    def kind(of: T.DataType) -> str:
        if isinstance(of, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "string"
        if isinstance(of, T.BinaryType):
            return "bytes"
        if isinstance(of, T.BooleanType):
            return "boolean"
        if isinstance(of, T.IntegralType) or (isinstance(of, T.DecimalType) and of.scale == 0):
            return "integer"
        if isinstance(of, T.NumericType):
            return "float"
        if isinstance(of, (T.StructType, T.MapType)):
            return "object"
        if isinstance(of, T.ArrayType):
            return "array"
        return "null" if isinstance(of, T.NullType) else "any"

    return Contract(
        tuple(
            Field(
                f.name,
                kind(f.dataType),
                required=not f.nullable,
                constraints=() if f.nullable else (Constraint("not_null", True),),
                item_type=kind(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else None,
                nested=contract_of_schema(f.dataType) if isinstance(f.dataType, T.StructType) else None,
            )
            for f in schema.fields
        )
    )
