"""Simulation: order priorities as models, changes of yield and cost as scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.formula import execute
from weftgraph.operators import simulate
from weftgraph.plans.registry import query, table

CALCULATIONS = [
    {"id": "profit", "formula": "revenue - cost - opex", "unit": "CNY"},
    {"id": "process_yield", "algorithm": "yield.cascade", "inputs": ["assembly_yield", "test_yield"], "unit": "ratio"},
    {"id": "output", "algorithm": "production.saleable_output", "inputs": ["units", "process_yield"], "unit": "unit"},
    {"id": "revenue", "algorithm": "finance.revenue", "inputs": ["output", "price"], "unit": "CNY"},
    {"id": "cost", "algorithm": "cost.variable_total", "inputs": ["units", "unit_cost"], "unit": "CNY"},
]


def simulated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results and summary of two scenarios a model."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").cast("double").alias("units"))
    values = F.array(
        *[F.struct(F.lit(i).alias("id"), v.alias("value"), F.lit(u).alias("unit")) for i, v, u in (("units", F.col("units"), "unit"), ("assembly_yield", F.lit(0.9), "ratio"), ("test_yield", F.lit(0.8), "ratio"), ("price", F.lit(10.0), "CNY/unit"), ("unit_cost", F.lit(5.0), "CNY/unit"), ("opex", F.lit(0.0), "CNY"))]
    )
    inputs = counts.select("model", F.explode(values).alias("v"), F.lit("assumption").alias("source")).select("model", "v.*", "source")
    scenarios = counts.select(F.explode(F.array(F.concat(F.lit("a:"), "model"), F.concat(F.lit("b:"), "model"))).alias("scenario"), "model")
    a, b = (scenarios.where(f"scenario like '{x}:%'").select("scenario") for x in "ab")
    op = "variable string, operation string, value double, ord int"
    interventions = a.join(spark.createDataFrame([("assembly_yield", "set", 0.95, 0), ("opex", "add", 100.0, 1)], op), F.lit(True)).unionByName(b.join(spark.createDataFrame([("price", "multiply", 1.1, 0), ("units", "multiply", -1.0, 1)], op), F.lit(True)))
    return simulate.run(inputs, CALCULATIONS, ["process_yield", "revenue", "profit"], scenarios, interventions, scenarios.select("scenario", F.lit(500.0).alias("one_time")))


BASE = """WITH m AS (SELECT o_orderpriority AS model, count(*)::DOUBLE AS u FROM orders GROUP BY 1), s AS (
  SELECT 'a:' || model AS scenario, model, u, 0.95::DOUBLE AS y, 10.0::DOUBLE AS p, u AS v, 100.0::DOUBLE AS x FROM m UNION ALL SELECT 'b:' || model, model, u, 0.9, 10.0::DOUBLE * 1.1::DOUBLE, -u, 0 FROM m
), r AS (SELECT *, 0.9::DOUBLE * 0.8::DOUBLE AS y0, y * 0.8::DOUBLE AS y1, u * (0.9::DOUBLE * 0.8::DOUBLE) * 10 AS r0, v * (y * 0.8::DOUBLE) * p AS r1 FROM s)"""


@query(BASE + """ SELECT scenario, variable, round(b, 4) AS baseline, round(c, 4) AS changed, round(c - b, 4) AS delta FROM (
  SELECT scenario, unnest(['process_yield', 'revenue', 'profit']) AS variable, unnest([y0, r0, r0 - u * 5]) AS b, unnest([y1, r1, r1 - v * 5 - x]) AS c FROM r)""")
def whatif_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = simulated(spark, sf_dir)
    return results.select("scenario", "variable", *[F.round(c, 4).alias(c) for c in ("baseline", "changed", "delta")])


@query(BASE + """ SELECT scenario, CASE WHEN (r1 - v * 5 - x) - (r0 - u * 5) > 0 THEN round(500 / round((r1 - v * 5 - x) - (r0 - u * 5), 6), 6) END AS payback_periods, 'assumption_only' AS evidence_grade, CASE WHEN scenario LIKE 'b:%' THEN 'units is negative' ELSE '' END AS errors FROM r""")
def whatif_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payback, grade of evidence and errors; the second scenario of a model is invalid."""
    _, summary = simulated(spark, sf_dir)
    return summary.select("scenario", "payback_periods", "evidence_grade", F.array_join("errors", ",").alias("errors"))


@query(BASE + """ SELECT scenario, 'profit' AS variable, CASE WHEN (r1 - v * 5 - x) < (r0 - u * 5) THEN 'fell' END AS problem FROM r WHERE (r1 - v * 5 - x) < (r0 - u * 5) UNION ALL SELECT scenario, 'process_yield', 'moved' FROM r WHERE y0 <> y1""")
def whatif_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = simulated(spark, sf_dir)
    names = results.select("scenario").distinct()
    assertions = names.select("scenario", F.lit("profit").alias("variable"), F.lit("nondecreasing").alias("type")).union(names.select("scenario", F.lit("process_yield"), F.lit("unchanged")))
    return simulate.assertion_violations(results, assertions).select("scenario", "variable", "problem")


@query("SELECT l_orderkey, round(product(1 - l_discount), 6) AS yield, min(l_quantity) AS bottleneck FROM lineitem GROUP BY l_orderkey")
def yield_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the ratios of an order's lines and their least quantity."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.product(1 - F.col("l_discount")), 6).alias("yield"), F.min("l_quantity").alias("bottleneck"))


@query("""SELECT l_orderkey, l_linenumber, round((1 - l_discount) * (1 - l_tax), 8) AS cascade, least(l_quantity, 20.0) AS least, round(l_quantity * (1 - l_discount), 6) AS saleable,
CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS unit_cost, CASE WHEN l_tax > 0 THEN round(l_quantity / l_tax, 4) END AS payback FROM lineitem""")
def algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named algorithms on every line; null where a divisor is zero or a gain missing."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(execute("yield.cascade", [1 - d, 1 - t]), 8).alias("cascade"), execute("capacity.bottleneck", [q, F.lit(20.0)]).alias("least"), F.round(execute("production.saleable_output", [q, 1 - d]), 6).alias("saleable"),
        F.round(execute("cost.unit", [t, d]), 6).alias("unit_cost"), F.round(execute("finance.payback", [q, t]), 4).alias("payback"),
    )
