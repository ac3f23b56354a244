"""A contract as native column expressions over a VARIANT payload: one projection, no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import Constraint, Contract, Field
from . import checks

VIOLATION = "struct<path:string,kind:string,severity:string,expected:string,received:string>"
VIOLATIONS = f"array<{VIOLATION}>"


def _at(base: Column, name: str) -> Column:
    return F.try_variant_get(base, "$['" + name.replace("'", "\\'") + "']", "variant")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, however often then refers to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shape(v: Column) -> Column:
    return F.schema_of_variant(v)


def fits(v: Column, kind: str, s: Column | None = None) -> Column:
    """The type predicate; false for an absent value, null only fits any and null. s: the value's shape, if known."""
    s = shape(v) if s is None else s
    # JSON integers are BIGINT, or DECIMAL(19+,0) beyond its range; 1.0 is DECIMAL(1,0)
    tests = {
        "string": s == "STRING",
        "bytes": s.isin("STRING", "BINARY"),
        "integer": (s == "BIGINT") | s.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"),
        "float": s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL"),
        "boolean": s == "BOOLEAN",
        "object": s.startswith("OBJECT<"),
        "array": s.startswith("ARRAY<"),
        "null": s == "VOID",
    }
    return F.coalesce(tests.get(kind, F.lit(True)), F.lit(False))


def named_type(v: Column, s: Column | None = None) -> Column:
    if s is None:
        return bound(shape(v), lambda x: named_type(v, x))
    out = F.when(fits(v, "null", s), "null").when(fits(v, "boolean", s), "boolean").when(fits(v, "integer", s), "integer").when(fits(v, "float", s), "float")
    return out.when(s == "STRING", "string").when(s.startswith("OBJECT<"), "object").when(s.startswith("ARRAY<"), "array").otherwise("any")


def items(v: Column) -> Column:
    return v.try_cast("array<variant>")


def keys(v: Column) -> Column:
    return F.map_keys(v.try_cast("map<string,variant>"))


def violation(path: str, kind: str, severity: str, expected: str | None, received: Column | None) -> Column:
    return F.struct(
        F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(expected).cast("string").alias("expected"),
        (received if received is not None else F.lit(None)).cast("string").alias("received"),
    )


def _as(v: Column, kind: str) -> Column:
    return v.try_cast(kind)


def _in(v: Column, bounds: Any, s: Column) -> Column:
    """Membership as Python means it: numbers and booleans compare across types, a bare string holds its substrings."""
    if isinstance(bounds, str):
        return fits(v, "string", s) & F.contains(F.lit(bounds), _as(v, "string"))
    texts = [b for b in bounds if isinstance(b, str)]
    numbers = [float(b) for b in bounds if isinstance(b, (bool, int, float))]
    out = F.lit(False)
    if texts:
        out = out | (fits(v, "string", s) & _as(v, "string").isin(texts))
    if numbers:
        out = out | (fits(v, "float", s) & _as(v, "double").isin(numbers)) | (fits(v, "boolean", s) & _as(v, "boolean").cast("double").isin(numbers))
    return F.coalesce(out, F.lit(False))


def breaks(c: Constraint, v: Column, s: Column) -> Column:
    number = F.when(fits(v, "boolean", s), _as(v, "boolean").cast("double")).when(fits(v, "float", s), _as(v, "double"))
    size = F.when(fits(v, "string", s), F.char_length(_as(v, "string"))).when(fits(v, "array", s), F.size(items(v))).when(fits(v, "object", s), F.size(keys(v)))
    test = {
        "minimum": lambda: number < F.lit(c.value),
        "maximum": lambda: number > F.lit(c.value),
        "min_length": lambda: size < F.lit(c.value),
        "max_length": lambda: size > F.lit(c.value),
        "pattern": lambda: fits(v, "string", s) & ~_as(v, "string").rlike(f"^(?:{c.value})"),
        "enum_values": lambda: ~_in(v, c.value, s),
    }.get(c.kind)
    return F.coalesce(test(), F.lit(False)) if test else F.lit(False)


def _limits(f: Field, path: str, v: Column, s: Column) -> list[Column]:
    return [F.when(breaks(c, v, s), violation(path, checks.VALUE, "error", f"{c.kind}={c.value!r}", named_type(v, s))) for c in f.constraints if c.kind != "not_null"]


def _empty() -> Column:
    return F.array().cast(VIOLATIONS)


def _list(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(VIOLATIONS) if found else _empty()


def _field(f: Field, path: str, v: Column, s: Column) -> Column:
    wrong = violation(path, checks.TYPE, "error", f.type, named_type(v, s))
    if f.type == "object":
        inner = _level(f.nested, v, path + ".") if f.nested else _empty()
        present = F.when(fits(v, "object", s), inner).otherwise(_list(violation(path, checks.STRUCTURE, "error", "object", named_type(v, s))))
    elif f.type == "array":
        bad = F.filter(items(v), lambda x: ~fits(x, f.item_type)) if f.item_type else None
        first = [F.when(F.size(bad) > 0, violation(path, checks.TYPE, "error", f.item_type, named_type(F.get(bad, 0))))] if f.item_type else []
        present = F.when(fits(v, "array", s), _list(*first, *_limits(f, path, v, s))).otherwise(_list(wrong))
    else:
        if f.type == "union" and f.members:
            fine = F.lit(False)
            for m in f.members:
                each = _all_fit(v, m.item_type) if m.type == "array" and m.item_type else F.lit(True)
                fine = fine | (fits(v, m.type, s) & F.coalesce(each, F.lit(False)))
        else:
            fine = fits(v, f.type, s)
        present = F.when(fine, _list(*_limits(f, path, v, s))).otherwise(_list(wrong))
    null = _list(violation(path, checks.NULL, "error", f.type, F.lit("null"))) if f.limit("not_null") else _empty()
    absent = _list(violation(path, checks.MISSING_FIELD, "error", f.type, None)) if f.required else _empty()
    return F.when(v.isNull(), absent).when(s == "VOID", null).otherwise(present)


def _bound_field(f: Field, path: str, value: Column) -> Column:
    return bound(value, lambda v: bound(shape(v), lambda s: _field(f, path, v, s)))


def _all_fit(v: Column, kind: str) -> Column:
    return F.forall(items(v), lambda x: fits(x, kind))


def _level(contract: Contract, base: Column, prefix: str = "") -> Column:
    known = contract.names()
    parts = [_bound_field(f, prefix + name, _at(base, name)) for name, f in known.items()]
    extra = F.array_except(keys(base), F.array(*(F.lit(n) for n in known)).cast("array<string>"))
    severity = "error" if contract.strict else "warning"

    def unexpected(k: Column) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), k).alias("path"), F.lit(checks.UNEXPECTED).alias("kind"), F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("expected"),
            named_type(F.element_at(base.try_cast("map<string,variant>"), k)).alias("received"),
        )

    return F.concat(*parts, F.coalesce(F.transform(extra, unexpected).cast(VIOLATIONS), _empty()))


def violations(contract: Contract, payload: Column) -> Column:
    """array<struct<path,kind,severity,expected,received>> of a VARIANT payload; a root that is no object has one."""
    root = _list(violation("", checks.STRUCTURE, "error", "object", None))
    return F.when(F.coalesce(fits(payload, "object"), F.lit(False)), _level(contract, payload)).otherwise(root)


def parsed(text: Column) -> Column:
    """JSON text as VARIANT; null unless it is one value that ends with its own bracket or mark."""
    return F.when(text.rlike(r'(?s)^\s*(\{.*\}|\[.*\]|".*"|[-0-9.eE+]+|true|false|null)\s*$'), F.try_parse_json(text))


def is_valid(found: Column) -> Column:
    return ~F.exists(found, lambda v: v["severity"] == "error")


def _same(a: Column, b: Column) -> Column:
    return (a["path"] == b["path"]) & (a["kind"] == b["kind"])


def merged(adapter: Column, core: Column) -> Column:
    """An adapter's own violations, and the core's whose path and kind it does not have; both array columns."""
    return F.concat(adapter, F.filter(core, lambda v: ~F.exists(adapter, lambda a: _same(a, v))))


def first_per_key(found: Column) -> Column:
    """The violations of an array column without those whose path and kind an earlier one has."""
    return F.filter(found, lambda v, k: ~F.exists(F.slice(found, F.lit(1), k), lambda a: _same(a, v)))
