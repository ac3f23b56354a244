"""Append-only history of applied repairs: one JSON line per applied operation, one summary where nothing was tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "timestamp string, contract_id string, status string, strategy string, violation_type string, field_path string, field_before string, field_after string, "
    "trust double, risk string, success boolean, attempt_number int, op_type string"
)


def records(repaired: DataFrame) -> DataFrame:
    """The history rows of repair()'s result."""
    base = repaired.select("contract_id", "status", "initial", "attempts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"))
    ops = base.select("*", F.explode("attempts").alias("a")).select("*", F.explode("a.applied").alias("o"))

    def hit(path):
        return F.get(F.filter("initial", lambda v: v["path"] == path), F.lit(0))["kind"]

    applied = ops.select(
        "timestamp", "contract_id", "status", F.col("a.strategy").alias("strategy"), F.coalesce(hit(F.col("o.target")), hit(F.col("o.source"))).alias("violation_type"),
        F.col("o.target").alias("field_path"), F.col("o.before").alias("field_before"), F.col("o.after").alias("field_after"), F.col("o.trust").alias("trust"),
        F.col("o.risk").alias("risk"), F.col("a.succeeded").alias("success"), F.col("a.number").alias("attempt_number"), F.col("o.op").alias("op_type"),
    )
    null = {"strategy": "string", "violation_type": "string", "field_path": "string", "field_before": "string", "field_after": "string", "trust": "double", "risk": "string"}
    untried = base.where(F.size("attempts") == 0).select(
        "timestamp", "contract_id", "status", *(F.lit(None).cast(t).alias(c) for c, t in null.items()), F.col("status").isin("success", "already_valid").alias("success"),
        F.lit(None).cast("int").alias("attempt_number"), F.lit(None).cast("string").alias("op_type"),
    )
    return applied.unionByName(untried)


def append(repaired: DataFrame, path: str, enabled: bool = True) -> bool:
    """Appends the history; failures are reported, not raised, so a repair never fails for its history."""
    if not enabled:
        return True
    try:
        records(repaired).write.mode("append").json(path, ignoreNullFields=False)
        return True
    except Exception as error:  # any store's own kind of failure
        print(f"history not written: {error}")
        return False


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history so far; a missing folder is empty, malformed lines are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)
