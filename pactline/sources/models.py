"""Contracts from Pydantic models, and validation by the models themselves.

The library is optional. A contract of a model needs it only where the model is declared; guard_of_model also runs the
model on executors, which must be able to import its module.
"""

from __future__ import annotations

import enum
import importlib
import types
import typing
from typing import Any

from ..contract import MISSING, Config, Constraint, Contract, Field, Member, find_field
from ..functions.values import type_name
from ..operators.checks import MISSING_FIELD, Violation, check, first_per_key, merged
from ..operators.guard import Guard

PRIMITIVES = {str: "string", bytes: "bytes", int: "integer", float: "float", bool: "boolean", type(None): "null"}


def load(reference: str) -> Any:
    """The class that "module.path:Name" names; for operators' own input only."""
    module, _, name = reference.partition(":")
    if not module or not name:
        raise ValueError(f"expected module.path:Class, not {reference!r}")
    return getattr(importlib.import_module(module), name)


def _bare(note: Any) -> Any:
    """Without Annotated and, if one member is left, without None."""
    while typing.get_origin(note) is typing.Annotated:
        note = typing.get_args(note)[0]
    if typing.get_origin(note) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(note) if a is not type(None)]
        if len(rest) == 1:
            return _bare(rest[0])
    return note


def closed_set(note: Any) -> tuple | None:
    """The values of a Literal or an enumeration; flags and empty enumerations have none."""
    note = _bare(note)
    if typing.get_origin(note) is typing.Literal:
        return typing.get_args(note)
    if isinstance(note, type) and issubclass(note, enum.Enum) and not issubclass(note, enum.Flag):
        return tuple(m.value for m in note) or None
    return None


def kind_of(note: Any) -> str:
    note = _bare(note)
    values = closed_set(note)
    if values is not None:
        kinds = {PRIMITIVES.get(type(v), "any") for v in values}
        return kinds.pop() if len(kinds) == 1 else "any"
    origin = typing.get_origin(note)
    if origin in (typing.Union, types.UnionType):
        return "union"
    for holder, kind in ((list, "array"), (dict, "object")):
        if origin is holder or note is holder:
            return kind
    if isinstance(note, type):
        if hasattr(note, "model_fields"):
            return "object"
        if note.__name__ in ("datetime", "date", "UUID"):
            return "string"
    return PRIMITIVES.get(note, "any") if isinstance(note, typing.Hashable) else "any"


def _item(note: Any) -> str | None:
    args = typing.get_args(_bare(note))
    if kind_of(note) != "array" or not args:
        return None
    kind = kind_of(args[0])
    return "any" if kind == "union" else kind


def _members(note: Any) -> tuple[Member, ...]:
    if kind_of(note) != "union":
        return ()
    return tuple(Member(kind_of(a), _item(a)) for a in typing.get_args(_bare(note)) if a is not type(None))


def _constraints(info: Any) -> tuple[Constraint, ...]:
    names = {"ge": "minimum", "le": "maximum", "min_length": "min_length", "max_length": "max_length", "pattern": "pattern"}
    out = [Constraint(kind, bound) for m in info.metadata for name, kind in names.items() if (bound := getattr(m, name, None)) is not None]
    values = closed_set(info.annotation)
    return (*out, Constraint("enum_values", values)) if values is not None else tuple(out)


def contract_of_model(model: Any) -> Contract:
    """One field per model field; nested models are nested contracts, an alias is the path and the name an alias of it."""
    fields = []
    for name, info in model.model_fields.items():
        alias = next((a for a in (info.validation_alias, info.alias) if isinstance(a, str) and a != name), None)
        default = MISSING
        if not info.is_required():
            default = info.default_factory() if info.default_factory else info.default
        nested = _bare(info.annotation)
        fields.append(
            Field(
                alias or name, kind_of(info.annotation), info.is_required(), default, _constraints(info), (name,) if alias else (), _item(info.annotation),
                contract_of_model(nested) if hasattr(nested, "model_fields") else None, _members(info.annotation),
            )
        )
    return Contract(tuple(fields), strict=model.model_config.get("extra") == "forbid", source=f"{model.__module__}:{model.__qualname__}")


# Where an error's context holds the bound that it broke, first of all first.
BOUNDS = ("ge", "le", "gt", "lt", "min_length", "max_length", "pattern", "expected")


# Error types of the library and what they amount to here.
ERRORS = {"missing": "missing_required_field", "extra_forbidden": "unexpected_field", "none_required": "null_not_allowed"}


def error_kind(error_type: str) -> str:
    return ERRORS.get(error_type) or ("type_mismatch" if error_type.endswith(("_type", "_parsing")) else "value_constraint")


def error_path(loc: tuple, contract: Contract) -> str:
    """The longest declared prefix of an error's place, else all of it."""
    for n in range(len(loc), 0, -1):
        path = ".".join(map(str, loc[:n]))
        if find_field(contract, path):
            return path
    return ".".join(map(str, loc))


def violations_of_errors(errors: list[dict], contract: Contract) -> list[Violation]:
    """A model's errors as violations: one for each place and kind, all of them errors."""
    out = []
    for error in errors:
        path, kind = error_path(tuple(error.get("loc", ())), contract), error_kind(error.get("type", ""))
        declared, context = find_field(contract, path), error.get("ctx") or {}
        bound = next((f"{name}={context[name]!r}" for name in BOUNDS if name in context), None)
        # what a missing field's error holds as its input is the object around it
        received = None if kind == MISSING_FIELD else type_name(error.get("input"))
        out.append(Violation(path, kind, "error", bound or (declared.type if declared else None), received))
    return first_per_key(out)


class ModelCheck:
    """A checker for repair() and Guard: the model's own errors, then what the contract finds beyond them.

    The model takes values that it can convert ("31.5" for a float); the contract does not.
    """

    def __init__(self, model: Any):
        self.model = model

    def errors(self, contract: Contract, payload: dict) -> list[Violation]:
        try:
            self.model.model_validate(payload)
        except ValueError as error:  # the library's own error is one, and lists what is wrong
            if not callable(getattr(error, "errors", None)):
                raise
            return violations_of_errors(error.errors(), contract)
        return []

    def __call__(self, contract: Contract, payload: dict) -> list[Violation]:
        return merged(self.errors(contract, payload), check(contract, payload))


def guard_of_model(model: Any, config: Config | None = None) -> Guard:
    """Enforces a model: its own validators run as well as its contract."""
    return Guard(contract_of_model(model), config, checker=ModelCheck(model))


def wrap(model: Any, status: str, output: dict | None) -> Any:
    """The model's instance of a payload that ended valid; None for others. A payload that the model refuses is a fault here."""
    if status not in ("success", "already_valid"):
        return None
    try:
        return model.model_validate(output)
    except ValueError as error:
        raise RuntimeError(f"{getattr(model, '__name__', model)} refuses a payload that was found valid: {error}") from error
