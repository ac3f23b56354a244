import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pactline
from pactline import Config, Guard, contract_of_schema, parse_contract
from pactline.cli import main
from pactline.functions.names import assign, jaro_winkler, normal_name, normal_value
from pactline.functions.trust import Policy
from pactline.functions.values import cast, root_object
from pactline.operators.checks import check, first_per_key, merged
from pactline.operators.guard import told
from pactline.operators.repair import policy_of, repair
from pactline.queries import CASES
from pactline.sources import cases, files, history
from pactline.streaming.stream import repair_stream

WEATHER = {"fields": [{"path": "temperature", "type": "float"}, {"path": "humidity", "type": "integer"}]}


def fix(contract, payload, **config):
    return repair(parse_contract(contract), payload, Config(**config))


def test_parsing_refuses_what_it_does_not_know():
    with pytest.raises(TypeError):
        parse_contract([])
    with pytest.raises(ValueError):
        parse_contract({})
    with pytest.raises(ValueError, match="string"):
        parse_contract({"fields": [{"path": "a", "type": "text"}]})
    with pytest.raises(ValueError):
        Policy.of({"lossy": (0.9, 0.5)})


def test_contract_id_follows_paths_types_and_strictness_only():
    a = parse_contract(WEATHER)
    assert a.contract_id == parse_contract({"fields": WEATHER["fields"][::-1]}).contract_id
    assert a.contract_id != a.with_strict(True).contract_id and len(a.contract_id) == 16


@pytest.mark.parametrize("pair, score", [(("temperature", "temp_celsius"), 0.809), (("zip_code", "zipcode"), 0.971), (("code", "cod"), 0.942), (("user_name", "user_email"), 0.913)])
def test_published_similarities(pair, score):
    assert jaro_winkler(*pair) == pytest.approx(score, abs=6e-4)


def test_assignment_margin_counts_taken_rivals():
    first, *_ = assign(("user_id", "user_name"), ("user_email",))
    assert first.missing == "user_name" and first.margin < 0.05
    assert normal_name("a.Zip-Code ") == "zipcode" and normal_value(" In Progress") == "in_progress"


@pytest.mark.parametrize("case", CASES, ids=lambda c: c["name"])
def test_golden_cases(case):
    status, least = case["expected_result"]["status"], case["expected_result"]["min_confidence"]
    got = fix(case["expected_schema"], case["broken_payload"])
    assert got.status == status
    assert all(o.trust >= (least or 0) for a in got.attempts for o in a.applied)


@pytest.mark.parametrize("root", [None, 5, 1.5, True, "x", "{", "3", "null", b"\xff", [], [1], [{"a": 1}, {"a": 2}], [[{"a": 1}]], [["a", 1], ["a", 2]], [[1, 2]], [["a", 1, 2]], [["a", 1], "x"], '{"a": 1, "a": 2}'])
def test_refused_roots(root):
    assert root_object(root) is None
    got = fix({"fields": [{"path": "a", "type": "integer"}]}, root)
    assert (got.status, len(got.remaining), got.attempts) == ("failed", 1, [])


@pytest.mark.parametrize("root", ['{"a": 1, "b": "x"}', b'{"a": 1, "b": "x"}', [{"a": 1, "b": "x"}], '[{"a": 1, "b": "x"}]', [["a", 1], ["b", "x"]], '[["a", 1], ["b", "x"]]'])
def test_recovered_roots(root):
    got = fix({"fields": [{"path": "a", "type": "integer"}, {"path": "b", "type": "string"}]}, root)
    assert (got.status, got.output) == ("success", {"a": 1, "b": "x"})


def test_casts():
    assert cast("05", "integer")[1].value == 0.85 and cast("+5", "integer") is None and cast(" 5", "integer") is None
    assert cast("80", "float")[1].value == 0.85 and cast("nan", "float") is None
    assert cast("TRUE", "boolean")[1].value == 0.95 and cast("yes", "boolean") is None
    assert cast({"a": 1}, "string")[0] == '{"a": 1}' and cast(5, "string") is None
    assert cast('{"a": 1, "a": 2}', "object") is None and cast('["x"]', "array", "string")[0] == ["x"]


def test_abstention_taint_and_partial():
    two = [{"path": "user_id", "type": "string"}, {"path": "user_name", "type": "string"}]
    got = fix({"fields": two}, {"user_email": "a@b.com"})
    assert got.status == "ambiguous" and got.output is None
    got = fix({"fields": [two[0], two[1] | {"default": "anon"}]}, {"user_email": "a@b.com"})
    assert got.status == "partial" and "user_id" not in got.output and set(got.ambiguous) == {"user_id", "user_name"}
    bounded = {"fields": [{"path": "age", "type": "integer", "constraints": [{"type": "minimum", "value": 0}]}]}
    assert fix(bounded, {"agee": -5}).output == {"age": -5}
    assert fix(bounded, {"agee": -5}, allow_partial=False).status == "failed"
    assert fix(WEATHER, {"temperature": 1.0, "humidity": 2, "x": 1}).status == "already_valid"
    assert fix(WEATHER, {"temp_celsius": "31.5", "humidity": 80}).output == {"temperature": 31.5, "humidity": 80}


EVERY = parse_contract(
    {
        "fields": [
            {"path": "s", "type": "string", "constraints": [{"type": "min_length", "value": 2}, {"type": "pattern", "value": "a"}, {"type": "not_null", "value": True}]},
            {"path": "i", "type": "integer", "constraints": [{"type": "minimum", "value": 0}, {"type": "maximum", "value": 9}]},
            {"path": "f", "type": "float", "required": False},
            {"path": "e", "type": "any", "constraints": [{"type": "enum_values", "value": ["x", 1, 2.5]}], "required": False},
            {"path": "l", "type": "array", "item_type": "integer", "constraints": [{"type": "max_length", "value": 2}], "required": False},
            {"path": "o", "type": "object", "nested": {"fields": [{"path": "b", "type": "boolean"}], "strict_mode": True}, "required": False},
            {"path": "u", "type": "union", "members": [{"type": "string"}, {"type": "array", "item_type": "string"}], "required": False},
        ]
    }
)
PAYLOADS = [
    {}, {"s": None, "i": None}, {"s": "ab", "i": 5}, {"s": "b", "i": -1}, {"s": 5, "i": "5"}, {"s": "ab", "i": 1.0}, {"s": "ab", "i": True}, {"s": "ab", "i": 5, "f": 1}, {"s": "ab", "i": 5, "f": "1"},
    {"s": "ab", "i": 5, "e": True}, {"s": "ab", "i": 5, "e": 2.5}, {"s": "ab", "i": 5, "e": "y"}, {"s": "ab", "i": 5, "l": [1, 2, 3]}, {"s": "ab", "i": 5, "l": [1, "x", None]}, {"s": "ab", "i": 5, "l": {}},
    {"s": "ab", "i": 5, "o": {"b": True}}, {"s": "ab", "i": 5, "o": {"b": 1, "c": 2}}, {"s": "ab", "i": 5, "o": {}}, {"s": "ab", "i": 5, "o": []}, {"s": "ab", "i": 5, "u": ["x", 1]}, {"s": "ab", "i": 5, "u": ["x"]},
    {"s": "ab", "i": 5, "zz": 1}, {"s": "ab", "i": 12345678901234567890123},
]


def test_native_validation_equals_the_rule_book(spark):
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(PAYLOADS)] + [(99, None), (98, "[1]"), (97, '{"s": "ab"} x')], "k int, p string")
    got = {r["k"]: r for r in Guard(EVERY).validate(rows, "p").collect()}
    for k, p in enumerate(PAYLOADS):
        want = sorted((v.path, v.kind, v.severity, v.expected or "", v.received or "") for v in check(EVERY, p))
        assert sorted((v["path"], v["kind"], v["severity"], v["expected"] or "", v["received"] or "") for v in got[k]["violations"]) == want, p
        assert got[k]["is_valid"] == all(v.severity != "error" for v in check(EVERY, p))
    assert all([v["kind"] for v in got[k]["violations"]] == ["structural_mismatch"] for k in (97, 98, 99))


def test_repair_of_frames_equals_repair_of_payloads(spark):
    rows = spark.createDataFrame([(k, json.dumps(p), "other") for k, p in enumerate(PAYLOADS)] + [(99, None, "x")], "k int, p string, status_note string")
    policy = policy_of(Config())
    for r in Guard(EVERY).repair(rows, "p").collect():
        want = told(repair(EVERY, PAYLOADS[r["k"]] if r["k"] < 99 else None), policy)
        assert r["status"] == want["status"], r
        assert (r["repaired"] and json.loads(r["repaired"])) == (want["repaired"] and json.loads(want["repaired"]))
        assert [a["strategy"] for a in r["attempts"]] == [a["strategy"] for a in want["attempts"]]


def test_merge_and_first_of_each_key():
    a = check(EVERY, {"s": "b", "i": -1})
    assert len(a) == 3 and len(first_per_key(a)) == 2
    assert merged(a[:1], a) == [a[0], a[2]]
    assert first_per_key([a[0], a[2], a[0]]) == [a[0], a[2]]


def test_typed_schema_as_contract():
    c = contract_of_schema(T.StructType.fromDDL("a bigint not null, b array<double>, c struct<d:date>, e map<string,int>, f decimal(5,2)"))
    assert [(f.name, f.type, f.required) for f in c.fields] == [("a", "integer", True), ("b", "array", False), ("c", "object", False), ("e", "object", False), ("f", "float", False)]
    assert c.fields[2].nested.fields[0].type == "string"


def test_history_files_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([('{"temp_celsius": 31.5, "humidity": 80}',), ('{"temperature": 1, "humidity": 2}',), ('{"xyz": 1}',)], "p string")
    done = Guard(WEATHER).repair(rows, "p")
    out = str(tmp_path / "history")
    assert history.read(spark, out).count() == 0
    assert history.append(done, out) and history.append(done, out, enabled=False)
    got = history.read(spark, out).collect()
    assert sorted((r["op_type"] or "-", r["success"]) for r in got) == [("-", True), ("rename", True)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('﻿{"temp_celsius": 31.5, "humidity": 80}', encoding="utf-8")
    assert [r["source_file"] for r in files.payload_files(spark, str(tmp_path / "in")).collect()] == ["a.json"]
    stream = spark.readStream.schema("value string").option("wholetext", True).text(str(tmp_path / "in")).selectExpr("replace(value, '\\ufeff', '') AS p")
    repair_stream(Guard(WEATHER), stream, "p", str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "h")).awaitTermination()
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["success"]
    assert spark.read.json(str(tmp_path / "h")).count() == 1


def test_command_line(tmp_path, capsys):
    schema, payload = tmp_path / "s.json", tmp_path / "p.json"
    schema.write_text(json.dumps(WEATHER))
    for data, code in (({"temp_celsius": 1.5, "humidity": 2}, 0), ({"xyz": 1, "abc": 2}, 2), ({"temp_celsius": 1.5, "xyz": 2}, 1)):
        payload.write_text(json.dumps(data))
        assert main(["check", "--schema", str(schema), "--payload", str(payload), "--json"]) == code
    assert json.loads(capsys.readouterr().out.splitlines()[0])["status"] == "success"
    assert main(["check", "--schema", str(schema), "--payload", str(tmp_path / "none.json")]) == 2


def test_version_and_strict_id(tmp_path, capsys):
    with pytest.raises(SystemExit) as end:
        main(["--version"])
    assert end.value.code == 0 and pactline.__version__ in capsys.readouterr().out
    for name, data in (("s", WEATHER), ("p", {"temperature": 1.5, "humidity": 2})):
        (tmp_path / name).write_text(json.dumps(data))
    assert main(["check", "--schema", str(tmp_path / "s"), "--payload", str(tmp_path / "p"), "--json", "--strict"]) == 0
    assert json.loads(capsys.readouterr().out)["contract_id"] == parse_contract(WEATHER).with_strict(True).contract_id


def test_structs_repeated_keys_and_taken_names(spark):
    guard = Guard({"fields": [{"path": "a", "type": "string"}]})
    rows = spark.createDataFrame([((None, 1),)], "p struct<a:string,b:int>")
    assert [v["kind"] for v in guard.validate(rows, "p").first()["violations"]] == ["unexpected_field"]
    assert guard.repair(rows, "p").first()["status"] == "already_valid"
    twice = spark.createDataFrame([('{"a": "x", "a": 1}',)], "p string")
    assert not guard.validate(twice, "p").first()["is_valid"] and guard.repair(twice, "p").first()["status"] == "failed"
    for name in ("status", "Violations", "attempts", "__v"):
        taken = twice.withColumn(name, F.lit(1))
        with pytest.raises(ValueError, match=name.lower()):
            (guard.validate if name in ("Violations", "__v") else guard.repair)(taken, "p")


def test_cases_from_files(spark, tmp_path):
    for k, case in enumerate(CASES[:3]):
        (tmp_path / f"{2 - k}.json").write_text(json.dumps(case))
    found = cases.scan(spark, str(tmp_path))
    assert [c["name"] for c in found] == [c["name"] for c in CASES[2::-1]]
    cases.write(cases.run(spark, found), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "summary")).first()["passed"] == 3
    assert spark.read.json(str(tmp_path / "out" / "cases")).where("passed").count() == 3
    (tmp_path / "9.json").write_text("{}")
    with pytest.raises(ValueError, match="lacks name"):
        cases.scan(spark, str(tmp_path))


def test_silent_telemetry_and_native_policy(spark):
    rows = spark.createDataFrame([('{"temperature": 1, "humidity": 2}',)], "p string")
    done = Guard(WEATHER).repair(rows, "p")
    assert pactline.Silent().watch(done) is done and pactline.Silent().get() == {}
    p = Policy.of()
    told = [(r, t) for r in dict(p.bands) for t in (0.0, 0.49, 0.5, 0.59, 0.6, 0.7, 0.74, 0.75, 0.94, 0.95, 1.0)]
    got = spark.createDataFrame(told, "r string, t double").select("r", "t", p.decision_column(F.col("r"), F.col("t")).alias("d")).collect()
    assert [(x["r"], x["t"], x["d"]) for x in got] == [(r, t, p.decide(r, t)) for r, t in told]


def test_models_if_installed():
    pydantic = pytest.importorskip("pydantic")
    from typing import Literal

    from pactline.sources.models import contract_of_model, error_kind

    class Inner(pydantic.BaseModel):
        code: str

    class Outer(pydantic.BaseModel):
        n: int = pydantic.Field(ge=0, le=5)
        s: Literal["a", "b"]
        inner: Inner | None = None
        u: int | str = 3
        items: list[str] = pydantic.Field(default_factory=list)
        t: float = pydantic.Field(validation_alias="temp")

    c = contract_of_model(Outer)
    assert [(f.path, f.type, f.required) for f in c.fields] == [("n", "integer", True), ("s", "string", True), ("inner", "object", False), ("u", "union", False), ("items", "array", False), ("temp", "float", True)]
    assert c.fields[0].limit("maximum") == 5 and c.fields[1].limit("enum_values") == ("a", "b") and c.fields[5].aliases == ("t",) and c.fields[4].default == []
    assert error_kind("int_parsing") == "type_mismatch" and error_kind("greater_than") == "value_constraint"


def test_errors_of_a_model():
    from pactline.sources.models import ModelCheck, violations_of_errors, wrap

    c = parse_contract({"fields": [{"path": "n", "type": "integer"}, {"path": "u", "type": "array"}]})
    errors = [
        {"type": "missing", "loc": ("n",), "input": {"u": []}},
        {"type": "string_type", "loc": ("u", "str"), "input": 7},
        {"type": "list_type", "loc": ("u", "list[str]"), "input": 7},
        {"type": "extra_forbidden", "loc": ("x", 0), "input": None},
        {"type": "too_short", "loc": ("u", 0), "input": "a", "ctx": {"max_length": 9, "min_length": 2}},
        {"type": "unheard_of", "loc": (), "ctx": None},
    ]
    got = [(v.path, v.kind, v.severity, v.expected, v.received) for v in violations_of_errors(errors, c)]
    assert got == [
        ("n", "missing_required_field", "error", "integer", None), ("u", "type_mismatch", "error", "array", "integer"), ("x.0", "unexpected_field", "error", None, "null"),
        ("u", "value_constraint", "error", "min_length=2", "string"), ("", "value_constraint", "error", None, "null"),
    ]

    class Refused(ValueError):
        def errors(self):
            return errors[:1]

    class Model:
        fault = None

        @classmethod
        def model_validate(cls, payload):
            if cls.fault:
                raise cls.fault
            return ("instance", payload)

    assert [v.kind for v in ModelCheck(Model)(c, {"u": []})] == ["missing_required_field"] and wrap(Model, "success", {"n": 1}) == ("instance", {"n": 1})
    assert wrap(Model, "partial", {}) is None
    Model.fault = Refused()
    assert ModelCheck(Model).errors(c, {}) == violations_of_errors(errors[:1], c)
    with pytest.raises(RuntimeError):
        wrap(Model, "already_valid", {})
    Model.fault = ValueError("the model's own fault")
    with pytest.raises(ValueError, match="own fault"):
        ModelCheck(Model)(c, {})
