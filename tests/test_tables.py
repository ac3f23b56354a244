"""Tables of few row groups: every core gets its share, and no row is lost."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactline.contract import find_field, parse_contract
from pactline.operators.guard import Guard, each_once
from pactline.operators.repair import type_coercion
from pactline.queries import queries
from pactline.sources.tables import parts_for, read_table

ROWS = 40_000


@pytest.fixture(scope="module")
def one_row_group(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("one"))
    rows = spark.range(ROWS).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "id / 100 AS c_acctbal")
    rows.coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", ["multi_step_repair", "wrap_in_list", "taint_hold", "typed_rows"])
def test_one_row_group_is_not_one_task(spark, one_row_group, name):
    counts = [r["count"] for r in queries()[name](spark, one_row_group).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == ROWS and max(counts) <= 1.5 * ROWS / spark.sparkContext.defaultParallelism


def test_spread_keeps_every_row(spark, one_row_group):
    rows = read_table(spark, f"{one_row_group}/customer.parquet")
    plain = spark.read.parquet(f"{one_row_group}/customer.parquet")
    assert rows.exceptAll(plain).isEmpty() and rows.count() == plain.count()


def test_parts_only_where_dealing_pays():
    assert parts_for([], 4) is None and parts_for([5_000], 4) is None  # empty, or small
    assert parts_for([15_000], 8) == 3 and parts_for([900_000], 8) == 32
    assert parts_for([1_000_000] * 36, 12) is None  # enough row groups as they are
    assert parts_for([900_000, 10, 10, 10, 10, 10, 10, 10], 8) == 32  # many partitions, one full


def test_repeated_texts_are_worked_out_once():
    seen = []

    def of(text):
        seen.append(text)
        return [text.upper()]

    texts = ["b", None, "a", "b", "", None, "a"]
    got = each_once(pa.array(texts, pa.string()), of, pa.list_(pa.string()))
    assert got.to_pylist() == [None if t is None else [t.upper()] for t in texts] and seen == ["b", "a", ""]
    for rest in ([], [None, None], ["y", "x"]):
        assert each_once(pa.array(rest, pa.string()), of, pa.list_(pa.string())).to_pylist() == [None if t is None else [t.upper()] for t in rest]


def test_repair_sees_each_text_of_a_batch_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(violations, contract, data):
        calls.add(1)
        return type_coercion(violations, contract, data)

    rows = spark.range(3_000, numPartitions=1).select("id", F.format_string('{"v": "{\\"k\\": %d}"}', F.col("id") % 3).alias("payload"))
    out = Guard({"fields": [{"path": "v", "type": "object"}]}, strategies=(("type_coercion", counted),)).repair(rows, "payload")
    got = out.select("id", "status", "repaired").collect()
    assert len(got) == 3_000 and all(r["status"] == "success" and r["repaired"] == f'{{"v": {{"k": {r["id"] % 3}}}}}' for r in got)
    assert calls.value == 3


def test_only_declared_paths_are_remembered():
    contract = parse_contract({"fields": [{"path": "a", "type": "object", "nested": {"fields": [{"path": "b", "type": "integer"}]}}]})
    for _ in range(2):
        assert find_field(contract, "a.b").type == "integer" and find_field(contract, "a.c") is None and find_field(contract, "x") is None
    assert set(contract._found) == {"a.b"}
    assert contract == parse_contract({"fields": [{"path": "a", "type": "object", "nested": {"fields": [{"path": "b", "type": "integer"}]}}]})
