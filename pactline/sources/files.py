"""JSON files as payloads and contracts, read by Spark so that any store it knows will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, parse_contract


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, payload): one row per file, a byte order mark left out; sorted by name when collected in order."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("payload"))


def payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """(payload): one row per line of JSON."""
    return spark.read.text(path).select(F.col("value").alias("payload")).where("trim(payload) != ''")


def contract_file(spark: SparkSession, path: str) -> Contract:
    """The contract in one JSON file; ValueError if it is no JSON."""
    rows = payload_files(spark, path).take(2)
    if len(rows) != 1:
        raise ValueError(f"expected one contract file at {path}, found {len(rows)}")
    return parse_contract(json.loads(rows[0]["payload"]))
