"""JSON lines: report history, telemetry and latency budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "report_id string, sequence long, signal_id string, amount long"
RECORD = "record_id long, command string, state string, bucket string, recorded_at timestamp, duration_ms double, phases array<struct<phase:string,duration_ms:double>>"
BUDGET = "command string, scope string, bucket string, budget_ms double, phase_budgets array<struct<phase:string,budget_ms:double>>"
MAX_BUDGETS, MAX_BYTES = 200, 1 << 20


def history(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a bad line fails the read."""
    return spark.read.schema(HISTORY).option("mode", "FAILFAST").json(path)


def telemetry(spark: SparkSession, path: str, most_bytes: int = MAX_BYTES) -> DataFrame:
    """Records; files above the cap raise."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()["n"] or 0
    if size > most_bytes:
        raise ValueError(f"telemetry has {size} bytes; at most {most_bytes}")
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def budgets(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of budgets, or an object that has one; at most 200."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.trim("value").alias("v"))
    inner = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", "$.budgets"))
    out = raw.select(F.explode(F.from_json(inner, f"array<struct<{_fields(BUDGET)}>>")).alias("b")).select("b.*")
    if out.limit(MAX_BUDGETS + 1).count() > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    return out


def _fields(ddl: str) -> str:
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")
