"""Cases: a contract, a payload and the expected result in one JSON file each; and where their results go."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Config
from ..operators.guard import Guard
from ..plans import report
from .files import payload_files

NEEDED = ("name", "expected_schema", "broken_payload", "expected_result")


def scan(spark: SparkSession, path: str) -> list[dict]:
    """The cases of a folder's JSON files, by file name. Cases are written by hand: as few as people write."""
    out = []
    for r in payload_files(spark, path).orderBy("source_file").collect():
        case = json.loads(r["payload"])
        lost = [k for k in NEEDED if k not in case]
        if lost:
            raise ValueError(f"{r['source_file']} lacks {', '.join(lost)}")
        out.append(case)
    return out


def run(spark: SparkSession, cases: list[dict], config: Config | None = None) -> DataFrame:
    """(name, expected_status, min_confidence, the columns of repair(), trusts, min_trust, passed): one row per case."""
    parts = []
    for case in cases:
        want = case["expected_result"]
        row = [(case["name"], json.dumps(case["broken_payload"]), want["status"], want.get("min_confidence"))]
        rows = spark.createDataFrame(row, "name string, payload string, expected_status string, min_confidence double")
        parts.append(Guard(case["expected_schema"], config).repair(rows, "payload"))
    if not parts:
        raise ValueError("no cases")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return report.case_results(out)


def write(results: DataFrame, path: str) -> None:
    """Results as JSON lines, and their summary beside them; a run again replaces both."""
    results.select("name", "expected_status", "status", "min_trust", "passed", F.size("attempts").alias("attempts")).write.mode("overwrite").json(f"{path}/cases")
    report.case_summary(results).write.mode("overwrite").json(f"{path}/summary", ignoreNullFields=False)
