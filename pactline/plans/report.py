"""Summaries over validated and repaired rows: native aggregates with map-side partials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TRIED = ("success", "partial")


def violation_counts(validated: DataFrame, col: str = "violations") -> DataFrame:
    """(path, kind, severity, n)."""
    each = validated.select(F.explode(col).alias("v")).select("v.path", "v.kind", "v.severity")
    return each.groupBy("path", "kind", "severity").agg(F.count("*").alias("n"))


def status_counts(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy("status").agg(F.count("*").alias("n"))


def case_results(repaired: DataFrame, expected: str = "expected_status", least: str = "min_confidence") -> DataFrame:
    """repaired with min_trust and passed: the status is the expected one and no applied operation has less trust."""
    trusts = F.flatten(F.transform("attempts", lambda a: F.transform(a["applied"], lambda o: o["trust"])))
    return repaired.withColumns({"trusts": trusts, "min_trust": F.array_min(trusts)}).withColumn(
        "passed", (F.col("status") == F.col(expected)) & (F.coalesce("min_trust", F.lit(1.0)) >= F.coalesce(F.col(least), F.lit(0.0)))
    )


def case_summary(cases: DataFrame, expected: str = "expected_status") -> DataFrame:
    """One row: cases, passed, repair_rate, false_positives, precision, average_trust."""
    repairable, attempted = F.col(expected).isin(*_TRIED), F.col("status").isin(*_TRIED)
    wrong = F.count_if(attempted & ~repairable)
    total = F.aggregate("trusts", F.lit(0.0), lambda s, x: s + x)
    return cases.agg(
        F.count("*").alias("cases"),
        F.count_if("passed").alias("passed"),
        F.try_divide(F.count_if(F.col("passed") & repairable), F.count_if(repairable)).alias("repair_rate"),
        wrong.alias("false_positives"),
        F.try_divide(F.count_if(attempted) - wrong, F.count_if(attempted)).alias("precision"),
        F.try_divide(F.sum(total), F.sum(F.size("trusts"))).alias("average_trust"),
    )
