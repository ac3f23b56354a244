"""Contracts enforced over DataFrames.

validate() is one native projection. repair() adds an Arrow-batched pass that sees a payload only where the native check
found an error, so clean rows never leave the JVM. Neither shuffles; both work on batch and streaming DataFrames.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..contract import Config, Contract, parse_contract
from ..functions.values import strict_json
from . import compile as native
from .checks import ROOT, Violation, check
from .repair import STRATEGIES, Operation, Result, policy_of, repair

OPERATION = "struct<op:string,target:string,source:string,risk:string,trust:double,value:string,before:string,after:string>"
ATTEMPT = f"struct<number:int,strategy:string,considered:array<string>,succeeded:boolean,applied:array<{OPERATION}>,rejected:array<{OPERATION}>,abstained:array<{OPERATION}>>"
RESULT = (
    f"struct<status:string,repaired:string,initial:{native.VIOLATIONS},remaining:{native.VIOLATIONS},attempts:array<{ATTEMPT}>,"
    f"ambiguous:array<struct<target:string,candidates:array<{OPERATION}>,reason:string>>>"
)


def _violation(v: Violation) -> dict:
    return {"path": v.path, "kind": v.kind, "severity": v.severity, "expected": v.expected, "received": v.received}


def _shown(value: Any) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, default=str)


def _operation(op: Operation) -> dict:
    value = None if op.op not in ("set_value", "set_default") else json.dumps(op.value, default=str)
    return {"op": op.op, "target": op.target, "source": op.source, "risk": op.risk, "trust": op.trust, "value": value, "before": _shown(op.before), "after": _shown(op.after)}


def told(result: Result, policy) -> dict:
    """A result as the row that repair() returns."""
    return {
        "status": result.status,
        "repaired": None if result.output is None else json.dumps(result.output, ensure_ascii=False, default=str),
        "initial": [_violation(v) for v in result.initial],
        "remaining": [_violation(v) for v in result.remaining],
        "attempts": [
            {
                "number": a.number, "strategy": a.strategy, "considered": a.considered, "succeeded": a.succeeded,
                "applied": [_operation(o) for o in a.applied], "rejected": [_operation(o) for o in a.rejected], "abstained": [_operation(o) for o in a.abstained],
            }
            for a in result.attempts
        ],
        "ambiguous": [
            {"target": t, "candidates": [_operation(o) for o in ops], "reason": policy.explain(ops[0].risk, ops[0].evidence, ops[0].trust)} for t, ops in result.ambiguous.items()
        ],
    }


def parse_row(text: str, encoding: str) -> Any:
    """json: the text is transport for the payload. value: the text itself is the payload's root."""
    if encoding == "value":
        return text
    try:
        return strict_json(text)  # as in validation, an object that repeats a key is none
    except ValueError:
        return None


def each_once(texts: pa.Array, of: Callable[[str], Any], kind: pa.DataType) -> pa.Array:
    """of(text) for every text that is not null, worked out once for all its repeats in the batch."""
    coded = texts.dictionary_encode()
    found = pa.array([of(t) for t in coded.dictionary.to_pylist()], kind)
    return found if len(found) == len(texts) else found.take(coded.indices)


class Guard:
    """Validates and repairs payload columns of JSON text (or structs, maps and VARIANT) against one contract.

    A checker other than the contract's own (see sources/models.py) takes the place of the native check; every payload then
    goes through an Arrow batch.
    """

    def __init__(self, contract: Contract | dict, config: Config | None = None, strategies=STRATEGIES, checker=check):
        self.config = config or Config()
        self.contract = (parse_contract(contract) if isinstance(contract, dict) else contract).with_strict(self.config.strict)
        self.strategies = tuple(strategies)
        self.checker = checker

    @property
    def _native(self) -> bool:
        return self.checker is check

    def _found(self, text: str, parsed: str) -> F.Column:
        """Violations of the payload in the columns text and parsed."""
        if self._native:
            return native.violations(self.contract, F.col(parsed))
        contract, checker = self.contract, self.checker
        kind = pa.list_(pa.struct(list(to_arrow_schema(StructType.fromDDL(native.VIOLATIONS.removeprefix("array<struct<").removesuffix(">>"))))))

        @F.arrow_udf(native.VIOLATIONS)
        def run(texts: pa.Array) -> pa.Array:
            def of(text: str) -> list[dict]:
                root = parse_row(text, "json")
                return [_violation(v) for v in (checker(contract, root) if isinstance(root, dict) else [ROOT])]

            return each_once(texts, of, kind)

        return run(F.coalesce(F.col(text), F.lit("null")))  # SQL NULL is a payload that is no object

    def _text(self, df: DataFrame, col: str) -> F.Column:
        kind = df.schema[col].dataType.typeName()
        # a field that is null is present; to_json would leave it out
        return F.col(col) if kind == "string" else F.to_json(F.col(col), {"ignoreNullFields": "false"})

    @staticmethod
    def _free(df: DataFrame, *names: str) -> None:
        taken = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
        if taken:
            raise ValueError(f"columns that the result needs are taken: {', '.join(taken)}; rename them first")

    def validate(self, df: DataFrame, col: str) -> DataFrame:
        """df with is_valid, violations and contract_id, which df must not have itself."""
        self._free(df, "is_valid", "violations", "contract_id", "__text", "__v")
        parsed = df.withColumn("__text", self._text(df, col)).withColumn("__v", native.parsed(F.col("__text")))  # a projection of its own: parsed once a row
        return parsed.withColumn("violations", self._found("__text", "__v")).drop("__text", "__v").withColumns({"is_valid": native.is_valid(F.col("violations")), "contract_id": F.lit(self.contract.contract_id)})

    def repair(self, df: DataFrame, col: str, encoding: str = "json") -> DataFrame:
        """df with status, repaired (JSON text), initial, remaining, attempts, ambiguous and contract_id, which df must not have itself."""
        self._free(df, "status", "repaired", "initial", "remaining", "attempts", "ambiguous", "contract_id", "__v", "__text", "__found", "__mended")
        contract, config, strategies, checker = self.contract, self.config, self.strategies, self.checker

        kind = pa.struct(list(to_arrow_schema(StructType.fromDDL(RESULT.removeprefix("struct<").removesuffix(">")))))

        @F.arrow_udf(RESULT)
        def mend(texts: pa.Array) -> pa.Array:
            policy = policy_of(config)
            return each_once(texts, lambda t: told(repair(contract, parse_row(t, encoding), config, strategies, policy, checker), policy), kind)

        text = self._text(df, col)
        checked = df.withColumn("__text", text).withColumn("__v", native.parsed(F.col("__text")))
        checked = checked.withColumn("__found", native.violations(contract, F.col("__v"))).drop("__v")
        # a text that is its own root is recovered even where it is valid; SQL NULL is a payload that is no object
        fine = native.is_valid(F.col("__found")) & F.lit(encoding == "json" and self._native)
        # kept where it is: the optimiser must neither repeat it nor move filters on its result below it
        mended = checked.withColumn("__mended", mend.asNondeterministic()(F.when(~fine, F.coalesce("__text", F.lit("null")))))

        def part(name: str, clean: F.Column) -> F.Column:
            return F.when(fine, clean).otherwise(F.col("__mended")[name])

        empty = StructType.fromDDL(f"a array<{ATTEMPT}>, b array<struct<target:string,candidates:array<{OPERATION}>,reason:string>>")
        out = mended.withColumns(
            {
                "status": part("status", F.lit("already_valid")), "repaired": part("repaired", F.col("__text")), "initial": part("initial", F.col("__found")),
                "remaining": part("remaining", F.col("__found")), "attempts": part("attempts", F.array().cast(empty["a"].dataType)),
                "ambiguous": part("ambiguous", F.array().cast(empty["b"].dataType)), "contract_id": F.lit(self.contract.contract_id),
            }
        )
        return out.drop("__text", "__found", "__mended")

    def wrap(self, repaired: DataFrame, schema: str) -> DataFrame:
        """Typed rows of the payloads that ended valid (success, already_valid)."""
        return repaired.where(F.col("status").isin("success", "already_valid")).select(F.from_json("repaired", schema).alias("payload")).select("payload.*")
