"""Registered queries of the contract engine: whole tables, drifted in the query, repaired and compared with the undrifted."""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import Config
from .functions.names import assign, jaro_winkler, normal_name
from .functions.trust import Evidence, Policy
from .operators import compile
from .operators.guard import Guard
from .operators.repair import Operation
from .operators.telemetry import Telemetry, log_lines
from .plans import report
from .sources import cases as case_files
from .sources import history
from .sources.models import contract_of_model, guard_of_model
from .sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _register(sql: str | None = None):
    def keep(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{table}.parquet")


def _f(path: str, kind: str, **more) -> dict:
    limits = [{"type": k, "value": v} for k, v in more.pop("limits", {}).items()]
    return {"path": path, "type": kind, "constraints": limits, **more}


def _guard(*fields: dict, **config) -> Guard:
    return Guard({"fields": list(fields)}, Config(**config))


def _json(**parts: Column) -> Column:
    """JSON text of an object; parts that are null are absent."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items()))).alias("payload")


def _counts(guard: Guard, rows: DataFrame) -> DataFrame:
    return report.violation_counts(guard.validate(rows, "payload"))


def _part(name: str, kind: str) -> Column:
    return F.get_json_object("repaired", f"$.{name}").cast(kind)


def _steps() -> Column:
    return F.array_join(F.transform("attempts", lambda a: a["strategy"]), ",")


# -- validation ------------------------------------------------------------------------------------------------------


@_register("SELECT 'c_name' AS path, 'missing_required_field' AS kind, 'error' AS severity, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 HAVING count(*) > 0")
def missing_required(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select(_json(c_custkey=F.col("c_custkey"), c_name=F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))))
    return _counts(_guard(_f("c_custkey", "integer"), _f("c_name", "string"), _f("c_phone", "string", required=False)), rows)


@_register("SELECT 'debug' AS path, 'unexpected_field' AS kind, 'warning' AS severity, count(*) AS n FROM events WHERE event_type = 'click' HAVING count(*) > 0")
def unexpected_fields(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(_json(event_id=F.col("event_id"), debug=F.when(F.col("event_type") == "click", F.lit(1))))
    return _counts(_guard(_f("event_id", "integer")), rows)


@_register("SELECT n_name AS path, 'unexpected_field' AS kind, 'error' AS severity, count(*) AS n FROM nation GROUP BY n_name")
def strict_mode(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").select(F.to_json(F.create_map("n_name", "n_nationkey")).alias("payload"))
    return _counts(_guard(_f("n_nationkey", "integer", required=False), strict=True), rows)


@_register("SELECT 'p_size' AS path, 'null_not_allowed' AS kind, 'error' AS severity, count(*) AS n FROM part WHERE p_size > 25 HAVING count(*) > 0")
def null_not_allowed(spark, sf_dir):
    size = F.when(F.col("p_size") <= 25, F.col("p_size"))
    rows = _read(spark, sf_dir, "part").select(F.to_json(F.struct("p_partkey", size.alias("p_size"), F.lit(None).cast("int").alias("p_tag")), {"ignoreNullFields": "false"}).alias("payload"))
    return _counts(_guard(_f("p_partkey", "integer"), _f("p_size", "integer", limits={"not_null": True}), _f("p_tag", "integer")), rows)


@_register("SELECT 'l_quantity' AS path, 'type_mismatch' AS kind, 'error' AS severity, count(*) AS n FROM lineitem WHERE l_linenumber = 1 HAVING count(*) > 0")
def type_violations(spark, sf_dir):
    value = F.when(F.col("l_linenumber") == 1, F.concat(F.lit('"'), F.col("l_quantity"), F.lit('"'))).otherwise(F.col("l_quantity").cast("string"))
    rows = _read(spark, sf_dir, "lineitem").select(F.format_string('{"l_orderkey": %d, "l_quantity": %s}', "l_orderkey", value).alias("payload"))
    return _counts(_guard(_f("l_orderkey", "integer"), _f("l_quantity", "float")), rows)


@_register("SELECT 'tags' AS path, 'type_mismatch' AS kind, 'error' AS severity, count(*) AS n FROM labels WHERE toxic = 1 HAVING count(*) > 0")
def array_items(spark, sf_dir):
    second = F.when(F.col("toxic") == 1, F.lit('"x"')).otherwise(F.col("toxic").cast("string"))
    rows = _read(spark, sf_dir, "labels").select(F.format_string('{"tags": [%d, %s, "y"]}', "quality", second).alias("payload"))
    rows = rows.withColumn("payload", F.replace("payload", F.lit(', "y"]'), F.lit("]")))
    return _counts(_guard(_f("tags", "array", item_type="integer")), rows)


@_register("SELECT 'props' AS path, 'structural_mismatch' AS kind, 'error' AS severity, count(*) AS n FROM events WHERE event_type <> 'click' HAVING count(*) > 0")
def object_shape(spark, sf_dir):
    props = F.when(F.col("event_type") == "click", F.col("props")).otherwise(F.to_json(F.array("props")))
    return _counts(_guard(_f("props", "object")), _read(spark, sf_dir, "events").select(F.format_string('{"props": %s}', props).alias("payload")))


@_register("SELECT 'v' AS path, 'type_mismatch' AS kind, 'error' AS severity, count(*) AS n FROM orders WHERE o_orderstatus = 'F' HAVING count(*) > 0")
def union_types(spark, sf_dir):
    value = F.when(F.col("o_orderstatus") == "F", F.lit("true")).when(F.col("o_orderstatus") == "O", F.lit("[1, 2]")).otherwise(F.col("o_orderkey").cast("string"))
    field = _f("v", "union", members=[{"type": "integer"}, {"type": "array", "item_type": "integer"}])
    return _counts(_guard(field), _read(spark, sf_dir, "orders").select(F.format_string('{"v": %s}', value).alias("payload")))


@_register(
    "SELECT 'l_quantity' AS path, 'value_constraint' AS kind, 'error' AS severity, count(*) AS n FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45 HAVING count(*) > 0"
)
def min_max(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(_json(l_quantity=F.col("l_quantity")))
    return _counts(_guard(_f("l_quantity", "float", limits={"minimum": 5, "maximum": 45})), rows)


@_register("SELECT 'p_name' AS path, 'value_constraint' AS kind, 'error' AS severity, count(*) AS n FROM part WHERE length(p_name) < 9 OR length(p_name) > 12 HAVING count(*) > 0")
def length(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(_json(p_name=F.col("p_name")))
    return _counts(_guard(_f("p_name", "string", limits={"min_length": 9, "max_length": 12})), rows)


@_register("SELECT 'p_brand' AS path, 'value_constraint' AS kind, 'error' AS severity, count(*) AS n FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]') HAVING count(*) > 0")
def pattern(spark, sf_dir):
    return _counts(_guard(_f("p_brand", "string", limits={"pattern": "Brand#[1-3]"})), _read(spark, sf_dir, "part").select(_json(p_brand=F.col("p_brand"))))


@_register(
    "SELECT 'o_orderpriority' AS path, 'value_constraint' AS kind, 'error' AS severity, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') HAVING count(*) > 0"
)
def enum_membership(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(_json(o_orderpriority=F.col("o_orderpriority")))
    return _counts(_guard(_f("o_orderpriority", "string", limits={"enum_values": ["1-URGENT", "2-HIGH"]})), rows)


_ORDER = (
    _f("o_orderkey", "integer"),
    _f("o_orderstatus", "string", limits={"enum_values": ["O", "F"]}),
    _f("o_totalprice", "float", limits={"maximum": 250000}),
    _f("o_clerk", "string"),
)


def _orders(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", _json(o_orderkey=F.col("o_orderkey"), o_orderstatus=F.col("o_orderstatus"), o_totalprice=F.col("o_totalprice"), o_extra=F.lit(1)))


@_register(
    """SELECT kind, severity, count(*) AS n FROM (
      SELECT 'missing_required_field' AS kind, 'error' AS severity FROM orders UNION ALL SELECT 'unexpected_field', 'warning' FROM orders
      UNION ALL SELECT 'value_constraint', 'error' FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'value_constraint', 'error' FROM orders WHERE o_totalprice > 250000
    ) GROUP BY kind, severity"""
)
def violation_counts_by_type(spark, sf_dir):
    return _counts(_guard(*_ORDER), _orders(spark, sf_dir)).groupBy("kind", "severity").agg(F.sum("n").alias("n"))


@_register(
    "SELECT o_orderkey, FALSE AS is_valid, CAST(2 + (o_orderstatus NOT IN ('O', 'F'))::INT + (o_totalprice > 250000)::INT AS INT) AS n_violations FROM orders"
)
def row_violations(spark, sf_dir):
    return _guard(*_ORDER).validate(_orders(spark, sf_dir), "payload").select("o_orderkey", "is_valid", F.size("violations").alias("n_violations"))


@_register(
    """SELECT o_orderkey, CAST((o_totalprice > 250000 OR o_totalprice < 1000)::INT AS INT) AS n_adapter, CAST(2 + (o_orderstatus NOT IN ('O', 'F'))::INT + (o_totalprice > 250000)::INT AS INT) AS n_core,
    CAST(2 + (o_orderstatus NOT IN ('O', 'F'))::INT + (o_totalprice > 250000 OR o_totalprice < 1000)::INT AS INT) AS n_merged FROM orders"""
)
def merged_violations(spark, sf_dir):
    """An adapter's violations (here: its own rule on prices), and the core's that it does not have."""
    rows = _orders(spark, sf_dir).withColumn("price", F.get_json_object("payload", "$.o_totalprice").cast("double"))
    own = compile.violation("o_totalprice", "value_constraint", "error", "in range", F.lit("float"))
    rows = rows.withColumn("adapter", F.array_compact(F.array(F.when((F.col("price") > 250000) | (F.col("price") < 1000), own))).cast(compile.VIOLATIONS))
    rows = _guard(*_ORDER).validate(rows, "payload")
    both = compile.merged(F.col("adapter"), F.col("violations"))
    return rows.select("o_orderkey", F.size("adapter").alias("n_adapter"), F.size("violations").alias("n_core"), F.size(both).alias("n_merged"))


@_register(
    """SELECT p_partkey, CAST((length(p_name) < 12)::INT + (length(p_name) > 8)::INT + (p_size > 40)::INT AS INT) AS n_all,
    CAST((length(p_name) < 12 OR length(p_name) > 8)::INT + (p_size > 40)::INT AS INT) AS n_first FROM part"""
)
def dedup_violations(spark, sf_dir):
    """The first violation of each path and kind, where one value breaks two bounds."""
    rows = _read(spark, sf_dir, "part").select("p_partkey", _json(p_name=F.col("p_name"), p_size=F.col("p_size")))
    out = _guard(_f("p_name", "string", limits={"min_length": 12, "max_length": 8}), _f("p_size", "integer", limits={"maximum": 40})).validate(rows, "payload")
    return out.select("p_partkey", F.size("violations").alias("n_all"), F.size(compile.first_per_key(F.col("violations"))).alias("n_first"))


@_register("SELECT c_custkey, c_custkey % 2 = 0 AS is_valid, CAST((c_custkey % 2)::INT AS INT) AS n FROM customer")
def present_nulls(spark, sf_dir):
    """A struct's field that is null is present: only its not-null bound can break."""
    payload = F.struct(F.col("c_custkey").alias("k"), F.lit(None).cast("string").alias("note"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    rows = _read(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload"))
    out = _guard(_f("k", "integer"), _f("note", "string"), _f("name", "string", limits={"not_null": True})).validate(rows, "payload")
    return out.select("c_custkey", "is_valid", F.size("violations").alias("n"))


class _Declared:
    """What a Pydantic field declares, for a model that needs no library."""

    def __init__(self, annotation, default=..., metadata=(), alias=None):
        self.annotation, self.default, self.metadata = annotation, default, metadata
        self.validation_alias = self.alias = alias
        self.default_factory = None

    def is_required(self) -> bool:
        return self.default is ...


class _Customer:
    model_config = {"extra": "forbid"}
    model_fields = {
        "key": _Declared(int, alias="c_custkey"),
        "c_name": _Declared(str, metadata=(type("MaxLen", (), {"max_length": 17})(),)),
        "c_mktsegment": _Declared(Literal["BUILDING", "MACHINERY"]),
        "c_acctbal": _Declared(float | None, default=None, metadata=(type("Ge", (), {"ge": 0})(),)),
    }


@_register(
    """SELECT path, kind, count(*) AS n FROM (SELECT 'c_name' AS path, 'value_constraint' AS kind FROM customer WHERE length(c_name) > 17
    UNION ALL SELECT 'c_mktsegment', 'value_constraint' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT 'c_acctbal', 'value_constraint' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'c_nationkey', 'unexpected_field' FROM customer) GROUP BY path, kind"""
)
def model_contract(spark, sf_dir):
    """A contract read from a model: alias, closed set, bounds, optional field, extras forbidden."""
    contract = contract_of_model(_Customer)
    rows = _read(spark, sf_dir, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")).alias("payload"))
    return report.violation_counts(Guard(contract, Config(strict=contract.strict)).validate(rows, "payload")).groupBy("path", "kind").agg(F.sum("n").alias("n"))


class _Refused(ValueError):
    """What a model raises: its errors, each a dictionary."""

    def __init__(self, *found: dict):
        super().__init__(found)
        self.found = found

    def errors(self) -> list[dict]:
        return list(self.found)


class _Balance:
    """A model with a rule of its own, beyond what its contract says; it takes numbers in text."""

    model_config: dict = {}
    model_fields = {"c_custkey": _Declared(int), "c_acctbal": _Declared(float)}

    @classmethod
    def model_validate(cls, payload: dict) -> dict:
        if float(payload["c_acctbal"]) > 9000:
            raise _Refused({"type": "less_than_equal", "loc": ("c_acctbal",), "input": payload["c_acctbal"], "ctx": {"le": 9000}})
        return payload


def _balances(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", _json(c_custkey=F.col("c_custkey"), c_acctbal=F.col("c_acctbal").cast("string")))


@_register(
    """SELECT 'c_acctbal' AS path, 'type_mismatch' AS kind, 'float' AS expected, count(*) AS n FROM customer
    UNION ALL SELECT 'c_acctbal', 'value_constraint', 'le=9000', count(*) FROM customer WHERE c_acctbal > 9000 HAVING count(*) > 0"""
)
def model_violations(spark, sf_dir):
    """A model's own errors with those that only its contract finds."""
    found = guard_of_model(_Balance).validate(_balances(spark, sf_dir), "payload").select(F.explode("violations").alias("v"))
    return found.groupBy("v.path", "v.kind", "v.expected").agg(F.count("*").alias("n"))


@_register("SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'partial' ELSE 'success' END AS status, c_acctbal AS acctbal, 'type_coercion' AS steps FROM customer")
def model_repair(spark, sf_dir):
    """Repairs that the model itself must accept."""
    out = guard_of_model(_Balance).repair(_balances(spark, sf_dir), "payload")
    return out.select("c_custkey", "status", _part("c_acctbal", "double").alias("acctbal"), _steps().alias("steps"))


# -- repair ----------------------------------------------------------------------------------------------------------


@_register("SELECT c_custkey, 'success' AS status, c_acctbal AS acctbal, 'exact_alias' AS steps FROM customer")
def alias_rename(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", _json(c_custkey=F.col("c_custkey"), balance=F.col("c_acctbal")))
    g = _guard(_f("c_custkey", "integer"), _f("acctbal", "float", aliases=["funds", "balance"]))
    return g.repair(rows, "payload").select("c_custkey", "status", _part("acctbal", "double").alias("acctbal"), _steps().alias("steps"))


@_register("SELECT s_suppkey, 'success' AS status, s_name AS supplier_name, 'normalized_name' AS steps FROM supplier")
def normalized_rename(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", _json(**{"SupplierName": F.col("s_name")}))
    return _guard(_f("supplier_name", "string")).repair(rows, "payload").select("s_suppkey", "status", _part("supplier_name", "string").alias("supplier_name"), _steps().alias("steps"))


@_register("SELECT c_custkey, 'success' AS status, c_acctbal AS temperature, 0.809 AS trust FROM customer")
def fuzzy_rename(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", _json(temp_celsius=F.col("c_acctbal"), humidity=F.lit(80)))
    out = _guard(_f("temperature", "float"), _f("humidity", "integer")).repair(rows, "payload")
    trust = F.round(F.element_at(F.element_at("attempts", 1)["applied"], 1)["trust"], 3)
    return out.select("c_custkey", "status", _part("temperature", "double").alias("temperature"), trust.alias("trust"))


@_register("SELECT c_custkey, 'ambiguous' AS status, 'user_name' AS target, 'user_email' AS source, 0.678 AS trust FROM customer")
def fuzzy_abstain(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", _json(user_email=F.col("c_name")))
    out = _guard(_f("user_id", "string"), _f("user_name", "string")).repair(rows, "payload")
    first = F.element_at("ambiguous", 1)
    best = F.element_at(first["candidates"], 1)
    return out.select("c_custkey", "status", first["target"].alias("target"), best["source"].alias("source"), F.round(best["trust"], 3).alias("trust"))


@_register("SELECT c_custkey, 'partial' AS status, 'anon' AS user_name, FALSE AS has_id FROM customer")
def taint_hold(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", _json(user_email=F.col("c_name")))
    out = _guard(_f("user_id", "string"), _f("user_name", "string", default="anon")).repair(rows, "payload")
    return out.select("c_custkey", "status", _part("user_name", "string").alias("user_name"), _part("user_id", "string").isNotNull().alias("has_id"))


def _coerced(name: str, kind: str, out: str, text: Callable[[], Column], table: str, key: str, **more):
    def query(spark, sf_dir):
        rows = _read(spark, sf_dir, table).select(key, F.to_json(F.struct(text().alias(name))).alias("payload"))
        return _guard(_f(name, kind, **more)).repair(rows, "payload").select(key, "status", _part(name, out).alias(name))

    return query


def _coercion(query_name: str, sql: str, *args, **more) -> None:
    _ALL[query_name] = (_coerced(*args, **more), sql)


_coercion("str_to_int", "SELECT o_orderkey, 'success' AS status, o_custkey AS v FROM orders", "v", "integer", "long", lambda: F.col("o_custkey").cast("string"), "orders", "o_orderkey")
_coercion("str_to_float", "SELECT o_orderkey, 'success' AS status, o_totalprice AS v FROM orders", "v", "float", "double", lambda: F.col("o_totalprice").cast("string"), "orders", "o_orderkey")
_coercion("str_to_bool", "SELECT doc_id, 'success' AS status, toxic = 1 AS v FROM labels", "v", "boolean", "boolean", lambda: F.when(F.col("toxic") == 1, "TRUE ").otherwise("false"), "labels", "doc_id")
_coercion("json_to_object", "SELECT event_id, 'success' AS status, replace(props, ' ', '') AS v FROM events", "v", "object", "string", lambda: F.col("props"), "events", "event_id")
_coercion(
    "json_to_array", "SELECT event_id, 'success' AS status, '[' || user_id || ']' AS v FROM events", "v", "array", "string", lambda: F.to_json(F.array("user_id")), "events", "event_id", item_type="integer"
)
_coercion("wrap_in_list", "SELECT c_custkey, 'success' AS status, '[\"' || c_name || '\"]' AS v FROM customer", "v", "array", "string", lambda: F.col("c_name"), "customer", "c_custkey", item_type="string")
_coercion(
    "container_to_string", "SELECT c_custkey, 'success' AS status, '{\"k\": ' || c_custkey || '}' AS v FROM customer", "v", "string", "string", lambda: F.struct(F.col("c_custkey").alias("k")), "customer", "c_custkey"
)
_coercion(
    "union_coerce", "SELECT o_orderkey, 'success' AS status, CAST(o_custkey AS VARCHAR) AS v FROM orders", "v", "union", "string", lambda: F.col("o_custkey").cast("string"), "orders", "o_orderkey",
    members=[{"type": "float"}, {"type": "integer"}],
)
_coercion(
    "enum_normalize", "SELECT c_custkey, 'success' AS status, c_mktsegment AS v FROM customer", "v", "string", "string", lambda: F.concat(F.lit(" "), F.lower("c_mktsegment")), "customer", "c_custkey",
    limits={"enum_values": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
)


@_register("SELECT o_orderkey, 'ambiguous' AS status, 2 AS n_candidates FROM orders")
def enum_contested(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", _json(v=F.lit("In Progress")))
    out = _guard(_f("v", "string", limits={"enum_values": ["in progress", "in_progress"]})).repair(rows, "payload")
    return out.select("o_orderkey", "status", F.size(F.element_at("ambiguous", 1)["candidates"]).alias("n_candidates"))


@_register("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'success' ELSE 'already_valid' END AS status, CASE WHEN p_size > 25 THEN 7 ELSE p_size END AS p_size FROM part")
def default_fill(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", _json(p_partkey=F.col("p_partkey"), p_size=F.when(F.col("p_size") <= 25, F.col("p_size"))))
    return _guard(_f("p_partkey", "integer"), _f("p_size", "integer", default=7)).repair(rows, "payload").select("p_partkey", "status", _part("p_size", "int").alias("p_size"))


@_register("SELECT p_partkey, 'already_valid' AS status, CAST(NULL AS INT) AS p_size FROM part")
def null_is_not_missing(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.format_string('{"p_size": null}').alias("payload"))
    return _guard(_f("p_size", "integer", default=7)).repair(rows, "payload").select("p_partkey", "status", _part("p_size", "int").alias("p_size"))


@_register("SELECT c_custkey, 'success' AS status, c_acctbal AS temperature, 60 AS humidity, 'in_progress' AS state, 'fuzzy_field_match,type_coercion,enum_normalization,default_fill' AS steps FROM customer")
def multi_step_repair(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", _json(temp_celsius=F.col("c_acctbal").cast("string"), state=F.lit("IN PROGRESS")))
    fields = (_f("temperature", "float"), _f("humidity", "integer", default=60), _f("state", "string", limits={"enum_values": ["open", "in_progress"]}))
    return _guard(*fields).repair(rows, "payload").select(
        "c_custkey", "status", _part("temperature", "double").alias("temperature"), _part("humidity", "int").alias("humidity"), _part("state", "string").alias("state"), _steps().alias("steps")
    )


_HALF = "SELECT s_suppkey, '{}' AS status, {} AS age FROM supplier"


def _partial(**config):
    def query(spark, sf_dir):
        rows = _read(spark, sf_dir, "supplier").select("s_suppkey", _json(agee=F.lit(-5)))
        return _guard(_f("age", "integer", limits={"minimum": 0}), **config).repair(rows, "payload").select("s_suppkey", "status", _part("age", "int").alias("age"))

    return query


_ALL["rename_exposes_a_bound"] = (_partial(), _HALF.format("partial", "-5"))
_ALL["partial_refused"] = (_partial(allow_partial=False), _HALF.format("failed", "CAST(NULL AS INT)"))


def _fill_a(violations, contract, data):
    return [Operation("set_default", "a", "declared", Evidence(authority=1.0), value=1)] if "a" not in data else None


def _spoil_c(violations, contract, data):
    return [Operation("set_value", "c", "declared", Evidence(authority=1.0), value="text")] if data.get("c") != "text" else None


def _set_b_again(violations, contract, data):
    return [Operation("set_value", "b", "declared", Evidence(authority=1.0), value="text")]


_ABC = (_f("a", "integer"), _f("b", "integer"), _f("c", "integer", required=False))


@_register("SELECT s_suppkey, 'partial' AS status, 1 AS a, s_nationkey AS c, 'fill_a:true,spoil_c:false' AS steps, 1 AS n_left FROM supplier")
def regression_keeps_last_good(spark, sf_dir):
    """The second attempt makes it worse: it is recorded, and the state before it stands."""
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", _json(c=F.col("s_nationkey")))
    out = Guard({"fields": list(_ABC)}, strategies=(("fill_a", _fill_a), ("spoil_c", _spoil_c))).repair(rows, "payload")
    steps = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["strategy"], a["succeeded"].cast("string"))), ",")
    return out.select("s_suppkey", "status", _part("a", "int").alias("a"), _part("c", "int").alias("c"), steps.alias("steps"), F.size("remaining").alias("n_left"))


@_register("SELECT s_suppkey, 'failed' AS status, 2 AS n_attempts FROM supplier")
def repeated_fix_ends(spark, sf_dir):
    """A strategy that proposes the same again and again: the second time nothing changes, and the rounds end."""
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", _json(a=F.col("s_nationkey")))
    out = Guard({"fields": list(_ABC)}, Config(max_attempts=50), strategies=(("again", _set_b_again),)).repair(rows, "payload")
    return out.select("s_suppkey", "status", F.size("attempts").alias("n_attempts"))


@_register("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'success' END AS status, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance FROM customer")
def partial_vs_failed(spark, sf_dir):
    k = F.col("c_custkey") % 3
    rows = _read(spark, sf_dir, "customer").select(
        "c_custkey", _json(Balance=F.when(k > 0, F.col("c_acctbal")), xyz=F.when(k == 0, F.lit(1)), country_code=F.when(k == 2, F.lit("IN")))
    )
    out = _guard(_f("balance", "float"), _f("country_code", "string")).repair(rows, "payload")
    return out.select("c_custkey", "status", _part("balance", "double").alias("balance"))


@_register("SELECT target, 1 AS n_candidates, count(*) AS n FROM customer, (VALUES ('user_id'), ('user_name')) AS t(target) GROUP BY target")
def ambiguity_groups(spark, sf_dir):
    """What was withheld, by the field it was meant for; the second of two placements is seen once the first is filled by default."""
    rows = _read(spark, sf_dir, "customer").select(_json(user_email=F.col("c_name")))
    out = _guard(_f("user_id", "string"), _f("user_name", "string", default="anon")).repair(rows, "payload")
    each = out.select(F.explode("ambiguous").alias("a")).select(F.col("a.target").alias("target"), F.size("a.candidates").alias("n_candidates"))
    return each.groupBy("target", "n_candidates").agg(F.count("*").alias("n"))


@_register("SELECT s_suppkey, 'success' AS status, s_name AS city, CAST(s_nationkey AS VARCHAR) AS zip FROM supplier")
def nested_depth2(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier").select(
        "s_suppkey", F.to_json(F.struct(F.struct(F.col("s_name").alias("city"), F.col("s_nationkey").cast("string").alias("zipcode")).alias("address"))).alias("payload")
    )
    g = _guard(_f("address", "object", nested={"fields": [_f("city", "string"), _f("zip_code", "string")]}))
    return g.repair(rows, "payload").select("s_suppkey", "status", _part("address.city", "string").alias("city"), _part("address.zip_code", "string").alias("zip"))


_REFUSED = ("null", "3", "1.5", "true", '"text"', "{", "[]", "[1, 2]", '[{"a": 1}, {"a": 2}]', '[["a", 1], ["a", 2]]', '[["a", 1, 2]]', '[[{"a": 1}]]', '{"a": 1, "a": 2}')


@_register(f"SELECT n_nationkey, 'failed' AS status, TRUE AS lost, ',structural_mismatch' AS found, 0 AS n_attempts FROM nation WHERE {len(_REFUSED)} > 0")
def root_refusal(spark, sf_dir):
    """Roots that are no object and cannot be read as one."""
    texts = F.array(*(F.lit(t) for t in _REFUSED))
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.get(texts, F.col("n_nationkey") % len(_REFUSED)).alias("payload"))
    out = _guard(_f("a", "integer")).repair(rows, "payload", encoding="value")
    found = F.array_join(F.transform("remaining", lambda v: F.concat_ws(",", v["path"], v["kind"])), ";")
    return out.select("n_nationkey", "status", F.col("repaired").isNull().alias("lost"), found.alias("found"), F.size("attempts").alias("n_attempts"))


@_register("SELECT n_nationkey, 'success' AS status, n_nationkey AS a, n_name AS b, 1 AS n_initial FROM nation")
def root_pairs(spark, sf_dir):
    """A list of pairs is an object, but for the finding that it was none."""
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.format_string('[["a", %d], ["b", "%s"]]', "n_nationkey", "n_name").alias("payload"))
    out = _guard(_f("a", "integer"), _f("b", "string")).repair(rows, "payload", encoding="value")
    return out.select("n_nationkey", "status", _part("a", "int").alias("a"), _part("b", "string").alias("b"), F.size("initial").alias("n_initial"))


@_register(
    "SELECT count(*) AS rows, count(*) FILTER (c_custkey % 2 = 0) AS already_valid, count(*) FILTER (c_custkey % 2 = 1) AS success, 0 AS failed, count(*) FILTER (c_custkey % 2 = 1) AS applied FROM customer"
)
def telemetry_counts(spark, sf_dir):
    """Counts observed in the job that carries the repair out."""
    balance = F.when(F.col("c_custkey") % 2 == 0, F.format_string('{"balance": %s}', F.col("c_acctbal").cast("string"))).otherwise(F.format_string('{"Balance": %s}', F.col("c_acctbal").cast("string")))
    watch = Telemetry()
    watch.watch(_guard(_f("balance", "float")).repair(_read(spark, sf_dir, "customer").select(balance.alias("payload")), "payload")).write.format("noop").mode("overwrite").save()
    told = watch.get()
    names = ("rows", "already_valid", "success", "failed", "applied")
    return _literals(spark, [tuple(told[n] for n in names)], ", ".join(f"{n} long" for n in names))


@_register("SELECT event, level, count(*) AS n FROM nation, (VALUES ('root.normalised', 'INFO'), ('repair.attempt', 'INFO'), ('repair.ended', 'INFO')) AS t(event, level) GROUP BY event, level")
def repair_log(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").select(F.format_string('[{"A": %d}]', "n_nationkey").alias("payload"))
    lines = log_lines(_guard(_f("a", "integer")).repair(rows, "payload", encoding="value"))
    return lines.groupBy("event", "level").agg(F.count("*").alias("n"))


@_register("SELECT n_nationkey, 'success' AS status, n_name AS v, n_regionkey AS r FROM nation")
def nested_depth3(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").select(
        "n_nationkey", F.to_json(F.struct(F.struct(F.col("n_regionkey").alias("region"), F.struct(F.col("n_name").alias("cod")).alias("country")).alias("address"))).alias("payload")
    )
    country = _f("country", "object", nested={"fields": [_f("code", "string")]})
    g = _guard(_f("address", "object", nested={"fields": [_f("region", "integer"), country]}))
    return g.repair(rows, "payload").select("n_nationkey", "status", _part("address.country.code", "string").alias("v"), _part("address.region", "int").alias("r"))


@_register("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 3 THEN 'failed' ELSE 'success' END AS status, CASE WHEN n_nationkey % 4 < 3 THEN n_nationkey END AS a FROM nation")
def root_recovery(spark, sf_dir):
    k = F.col("n_nationkey")
    text = (
        F.when(k % 4 == 0, F.format_string('{"a": %d}', k)).when(k % 4 == 1, F.format_string('[{"a": %d}]', k)).when(k % 4 == 2, F.format_string('[["a", %d]]', k)).otherwise(F.format_string("[%d]", k))
    )
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", text.alias("payload"))
    return _guard(_f("a", "integer")).repair(rows, "payload", encoding="value").select("n_nationkey", "status", _part("a", "int").alias("a"))


@_register("SELECT c_custkey, c_acctbal FROM customer")
def typed_rows(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select(_json(c_custkey=F.col("c_custkey"), c_actbal=F.col("c_acctbal").cast("string")))
    g = _guard(_f("c_custkey", "integer"), _f("c_acctbal", "float"))
    return g.wrap(g.repair(rows, "payload"), "c_custkey long, c_acctbal double")


def _literals(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    return spark.createDataFrame(rows, shape)


_RISK = "CASE l_linenumber % 5 WHEN 0 THEN 'reversible' WHEN 1 THEN 'declared' WHEN 2 THEN 'inferred' WHEN 3 THEN 'lossy' ELSE 'destructive' END"


@_register(
    f"""SELECT risk, decision, count(*) AS n FROM (SELECT risk, CASE risk WHEN 'reversible' THEN CASE WHEN t >= 0.7 THEN 'apply' WHEN t < 0.5 THEN 'reject' ELSE 'ambiguous' END WHEN 'declared' THEN 'apply'
    WHEN 'inferred' THEN CASE WHEN t >= 0.75 THEN 'apply' WHEN t < 0.6 THEN 'reject' ELSE 'ambiguous' END WHEN 'lossy' THEN CASE WHEN t >= 0.95 THEN 'apply' WHEN t < 0.7 THEN 'reject' ELSE 'ambiguous' END
    ELSE 'ambiguous' END AS decision FROM (SELECT {_RISK} AS risk, round(l_quantity / 50.0, 2) AS t FROM lineitem)) GROUP BY risk, decision"""
)
def decisions_by_risk(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.expr(_RISK).alias("risk"), F.round(F.col("l_quantity") / 50.0, 2).alias("t"))
    return rows.select("risk", Policy.of().decision_column(F.col("risk"), F.col("t")).alias("decision")).groupBy("risk", "decision").agg(F.count("*").alias("n"))


@_register(
    """SELECT l_orderkey, l_linenumber, round(least(1 - l_discount, 1 - l_tax) * (0.7 + 0.3 * least(1.0, l_discount / 0.15)), 6) AS trust,
    round((1 - l_tax) * (0.5 + 0.5 * least(1.0, l_discount / 0.05)), 6) AS strict_trust FROM lineitem"""
)
def trust_scores(spark, sf_dir):
    rows, one = _read(spark, sf_dir, "lineitem"), F.lit(1)
    plain, strict = Policy.of(), Policy.of(full_margin=0.05, tie_factor=0.5)
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(plain.score_column(name=one - F.col("l_discount"), value=one - F.col("l_tax"), margin=F.col("l_discount")), 6).alias("trust"),
        F.round(strict.score_column(value=one - F.col("l_tax"), margin=F.col("l_discount")), 6).alias("strict_trust"),
    )


_PREFIX = "CASE WHEN substr(a,1,1)<>substr(b,1,1) THEN 0 WHEN substr(a,2,1)<>substr(b,2,1) THEN 1 WHEN substr(a,3,1)<>substr(b,3,1) THEN 2 WHEN substr(a,4,1)<>substr(b,4,1) THEN 3 ELSE 4 END"


@_register(
    f"SELECT n_name, c_mktsegment, round(j + 0.1 * p * (1 - j), 9) AS similarity FROM (SELECT n_name, c_mktsegment, jaro_similarity(a, b) AS j, {_PREFIX} AS p FROM "
    "(SELECT n_name, c_mktsegment, lower(n_name) AS a, lower(c_mktsegment) AS b FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)))"
)
def name_similarity_grid(spark, sf_dir):
    """Similarities of all pairs of two sets of names."""

    @F.arrow_udf("double")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([round(jaro_winkler(x, y), 9) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    rows = _read(spark, sf_dir, "nation").select("n_name").crossJoin(_read(spark, sf_dir, "customer").select("c_mktsegment").distinct())
    return rows.withColumn("similarity", similar("n_name", "c_mktsegment"))


_SIMILAR = f"j + 0.1 * ({_PREFIX}) * (1 - j)"


def _grid(found: str, of: str) -> str:
    """SQL: similarity s of every name m with every found name f."""
    return f"SELECT m, f, {_SIMILAR} AS s FROM (SELECT m, f, lower(m) AS a, lower(f) AS b, jaro_similarity(lower(m), lower(f)) AS j FROM ({of}) CROSS JOIN (SELECT {found} AS f FROM ({of})))"


_NATIONS = "SELECT n_name AS m, n_nationkey AS k FROM nation"


def _assigned(spark, rows: DataFrame) -> DataFrame:
    """assign() over the names of a table's rows: a contract has as many fields as people declare."""
    names = rows.agg(F.array_sort(F.collect_set("m")).alias("m"), F.array_sort(F.collect_set("f")).alias("f"))

    @F.arrow_udf("array<struct<missing:string,found:string,score:double,margin:double,rival:string>>")
    def run(m: pa.Array, f: pa.Array) -> pa.Array:
        out = [[{"missing": x.missing, "found": x.found, "score": x.score, "margin": x.margin, "rival": x.rival} for x in assign(tuple(a), tuple(b))] for a, b in zip(m.to_pylist(), f.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("missing", pa.string()), ("found", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rival", pa.string())])))

    return names.select(F.explode(run("m", "f")).alias("x")).select("x.*")


@_register(
    f"""WITH g AS ({_grid("lower(m) || '_x'", _NATIONS)})
    SELECT m AS missing, f AS found, round(s, 6) AS score, round(least(s - (SELECT max(o.s) FROM g o WHERE o.m = g.m AND o.f <> g.f), s - (SELECT max(o.s) FROM g o WHERE o.f = g.f AND o.m <> g.m)), 6) AS margin
    FROM g WHERE f = lower(m) || '_x'"""
)
def assignment_margins(spark, sf_dir):
    """One-to-one assignment of all nations' names to drifted ones, with the lead over the best rival on either side."""
    rows = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("m"), F.concat(F.lower("n_name"), F.lit("_x")).alias("f"))
    return _assigned(spark, rows).select("missing", "found", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@_register("SELECT n_name AS missing, lower(n_name) || '_x' AS found FROM nation WHERE n_nationkey % 2 = 0")
def assignment_floor(spark, sf_dir):
    """Half of the names are too far from anything to be proposed at all."""
    far = F.concat(F.lit("#"), F.col("n_nationkey").cast("string"), F.lit("#"))
    rows = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("m"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lower("n_name"), F.lit("_x"))).otherwise(far).alias("f"))
    rows = rows.union(_read(spark, sf_dir, "nation").where("false").select(F.col("n_name"), F.col("n_name")))
    keep = F.col("found").startswith("#")
    return _assigned(spark, rows.withColumn("m", F.when(~F.col("f").startswith("#"), F.col("m")))).where(~keep).select("missing", "found")


@_register("SELECT r_name, replace(lower(r_name), ' ', '') AS form FROM region")
def normal_names(spark, sf_dir):
    @F.arrow_udf("string")
    def form(names: pa.Array) -> pa.Array:
        return pa.array([None if n is None else normal_name(n) for n in names.to_pylist()], pa.string())

    return _read(spark, sf_dir, "region").select("r_name", form("r_name").alias("form"))


@_register(
    "SELECT 'success' AS status, 'fuzzy_field_match' AS strategy, 'missing_required_field' AS violation_type, 'temperature' AS field_path, 'rename' AS op_type, 1 AS attempt_number, count(*) AS n FROM customer HAVING count(*) > 0"
)
def history_records(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select(_json(temp_celsius=F.col("c_acctbal")))
    done = history.records(_guard(_f("temperature", "float")).repair(rows, "payload"))
    return done.groupBy("status", "strategy", "violation_type", "field_path", "op_type", "attempt_number").agg(F.count("*").alias("n"))


@_register("SELECT 'already_valid' AS status, TRUE AS success, TRUE AS untried, count(*) AS n FROM customer HAVING count(*) > 0")
def history_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select(_json(temperature=F.col("c_acctbal")))
    done = history.records(_guard(_f("temperature", "float")).repair(rows, "payload"))
    return done.groupBy("status", "success", F.col("attempt_number").isNull().alias("untried")).agg(F.count("*").alias("n"))


@_register("SELECT CASE WHEN l_linenumber = 1 THEN 'success' WHEN l_linenumber = 2 THEN 'failed' ELSE 'already_valid' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def repair_statuses(spark, sf_dir):
    """Validation and repair of a large table of which a part is broken."""
    q = F.col("l_quantity").cast("string")
    rows = _read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, F.format_string('{"l_quantity": "%s"}', q)).when(F.col("l_linenumber") == 2, F.format_string('{"xyz": %s}', q)).otherwise(F.format_string('{"l_quantity": %s}', q)).alias("payload")
    )
    return report.status_counts(_guard(_f("l_quantity", "float")).repair(rows, "payload"))


def _case(name: str, fields: list[dict], payload: dict, status: str, least: float | None = None) -> dict:
    return {"name": name, "expected_schema": {"fields": fields}, "broken_payload": payload, "expected_result": {"status": status, "min_confidence": least}}


_WEATHER = [_f("temperature", "float"), _f("humidity", "integer")]
_COUNTRY = _f("country", "object", nested={"fields": [_f("code", "string")]})
CASES = [
    _case("alias", [_f("temp", "float", aliases=["temperature"]), _f("humidity", "integer")], {"temperature": 18.25, "humidity": 41}, "success", 1.0),
    _case("fuzzy name", _WEATHER, {"temp_celsius": 18.25, "humidity": 41}, "success", 0.7),
    _case("texts", _WEATHER, {"temperature": "18.25", "humidity": "41"}, "success", 0.9),
    _case("default", [_WEATHER[0], _f("humidity", "integer", default=50)], {"temperature": 18.25}, "success", 1.0),
    _case("two levels", [_f("name", "string"), _f("address", "object", nested={"fields": [_f("city", "string"), _f("zip_code", "string")]})], {"name": "Bo", "address": {"city": "Lund", "zipcode": "22350"}}, "success", 0.7),
    _case("three levels", [_f("name", "string"), _f("address", "object", nested={"fields": [_f("city", "string"), _COUNTRY]})], {"name": "Bo", "address": {"city": "Lund", "country": {"cod": "SE"}}}, "success", 0.9),
    _case("nothing alike", _WEATHER, {"qqq": 18.25, "www": 41}, "failed"),
    _case("valid", _WEATHER, {"temperature": 18.25, "humidity": 41}, "already_valid"),
    _case("in part", [*_WEATHER, _f("country_code", "string")], {"temp_celsius": 18.25, "humidity": 41}, "partial"),
    _case("JSON in texts", [_f("metadata", "object"), _f("tags", "array", item_type="string")], {"metadata": '{"rev": 7}', "tags": '["a", "b"]'}, "success", 0.9),
    _case("spelling", [_f("title", "string"), _f("state", "string", limits={"enum_values": ["open", "in_progress"]}), _f("rank", "string", limits={"enum_values": ["low", "high"]})], {"title": "x", "state": "IN PROGRESS", "rank": "High"}, "success", 0.8),
]


@_register("SELECT 11 AS cases, 11 AS passed, 1.0 AS repair_rate, 0 AS false_positives, 1.0 AS precision, 0.955 AS average_trust")
def golden_cases_summary(spark, sf_dir):
    return report.case_summary(case_files.run(spark, CASES)).withColumn("average_trust", F.round("average_trust", 3))


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
