"""Policy tables of any size are used whole."""

from pyspark.sql import functions as F

from factloom.operators import checks, metrics


def test_rules_beyond_the_broadcast_bound(spark):
    edges = spark.createDataFrame([("IMPORTS_FROM", "file:a", "file:b")], "kind string, src string, dst string")
    rules = spark.range(1500).select(F.format_string("r%d", "id").alias("name"), F.lit("a").alias("from_pat"), F.lit("b").alias("to_pat"), F.array().cast("array<string>").alias("from_not"))
    assert checks.layer_violations(edges, rules).count() == 1500


def test_budgets_beyond_the_broadcast_bound(spark):
    records = spark.range(300).selectExpr("id AS record_id", "concat('c', id) AS command", "'warm' AS state", "'small' AS bucket", "id AS recorded_at", "1.0D AS duration_ms")
    budgets = spark.range(300).selectExpr("concat('c', id) AS command", "'warm' AS scope", "'small' AS bucket", "2.0D AS budget_ms", "CAST(array() AS array<struct<phase:string,budget_ms:double>>) AS phase_budgets")
    assert metrics.latency_observations(records, budgets).where("budget_ms = 2").count() == 300
