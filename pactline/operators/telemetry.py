"""What a repair reports while it runs: counts of a frame as it is written, and lines of a log."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Telemetry:
    """Counts repaired rows in the job that writes them; nothing runs twice, nothing is collected but one row of counts."""

    def __init__(self, name: str = "repair"):
        self.observation = Observation(name)

    def watch(self, repaired: DataFrame) -> DataFrame:
        """The frame as it is; get() has its counts once an action on it ended."""
        applied = F.aggregate("attempts", F.lit(0), lambda n, a: n + F.size(a["applied"]))
        held = F.aggregate("attempts", F.lit(0), lambda n, a: n + F.size(a["abstained"]))
        statuses = ("already_valid", "success", "partial", "ambiguous", "failed")
        return repaired.observe(
            self.observation,
            F.count(F.lit(1)).alias("rows"),
            *(F.count_if(F.col("status") == s).alias(s) for s in statuses),
            F.coalesce(F.sum(F.size("attempts")), F.lit(0)).alias("attempts"),
            F.coalesce(F.sum(applied), F.lit(0)).alias("applied"),
            F.coalesce(F.sum(held), F.lit(0)).alias("abstained"),
            F.coalesce(F.sum(F.size("remaining")), F.lit(0)).alias("remaining"),
        )

    def get(self) -> dict[str, int]:
        return self.observation.get


class Silent(Telemetry):
    """Reports nothing."""

    def __init__(self):
        pass

    def watch(self, repaired: DataFrame) -> DataFrame:
        return repaired

    def get(self) -> dict[str, int]:
        return {}


def log_lines(repaired: DataFrame) -> DataFrame:
    """(level, event, line): what a log says of each row's repair, root recovery among it; paths and counts, never values."""

    def event(level: str, name: str, *more):
        return F.struct(F.lit(level).alias("level"), F.lit(name).alias("event"), F.to_json(F.struct(F.lit(name).alias("event"), "contract_id", *more)).alias("line"))

    root = F.exists("initial", lambda v: (v["path"] == "") & (v["kind"] == "structural_mismatch")) & (F.col("status") != "failed")
    tries = F.transform(
        "attempts",
        lambda a: F.struct(
            F.lit("INFO").alias("level"), F.lit("repair.attempt").alias("event"),
            F.to_json(F.struct(F.lit("repair.attempt").alias("event"), F.col("contract_id"), a["number"].alias("number"), a["strategy"].alias("strategy"), F.size(a["applied"]).alias("applied"), F.size(a["abstained"]).alias("abstained"))).alias("line"),
        ),
    )
    level = F.when(F.col("status").isin("already_valid", "success"), "INFO").otherwise("WARNING")
    end = event("INFO", "repair.ended", "status", F.size("remaining").alias("remaining"))
    lines = F.concat(
        F.when(root, F.array(event("INFO", "root.normalised"))).otherwise(F.array().cast("array<struct<level:string,event:string,line:string>>")),
        tries,
        F.array(F.struct(level.alias("level"), end["event"].alias("event"), end["line"].alias("line"))),
    )
    return repaired.select(F.explode(lines).alias("l")).select("l.*")


def log(telemetry: Telemetry, logger: logging.Logger | None = None) -> None:
    """One line with the counts of a run."""
    counts = telemetry.get()
    if counts:
        (logger or logging.getLogger("pactline")).info(json.dumps({"event": "repair.run", **counts}))
