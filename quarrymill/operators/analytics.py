"""Roll-ups: terms, usage, review decisions, findings, calibration, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """Percentage, null for an empty whole."""
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 6)


def terms(df: DataFrame, key: str, size: int) -> DataFrame:
    """The `size` most frequent values of a column."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(size)


def decision_effectiveness(decisions: DataFrame, dims: list[str]) -> DataFrame:
    """dim, value, total (pending included), approved, rejected, rates of the total; blank values are skipped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.nullif(F.col(d), F.lit("")).alias("value")) for d in dims])).alias("x")
    rows = decisions.select("status", pairs).select("status", "x.dim", "x.value").where("value is not null")
    out = rows.groupBy("dim", "value").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "APPROVED").alias("approved"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))
    return out.withColumns({"approval_rate": rate(F.col("approved"), F.col("total")), "rejection_rate": rate(F.col("rejected"), F.col("total"))})


def automation_eligible(effect: DataFrame, approval: float = 95, rejection: float = 5, least: int = 20) -> DataFrame:
    return effect.where((F.col("approval_rate") >= approval) & (F.col("rejection_rate") <= rejection) & (F.col("total") >= least))


def finding_frequency(findings: DataFrame) -> DataFrame:
    """type, n, pct of all findings with one decimal."""
    return findings.groupBy("type").agg(F.count("*").alias("n")).withColumn("pct", F.round(100e0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def finding_quality(findings: DataFrame) -> DataFrame:
    """type, useful share, mean confidence, genericity (executions with the type over all) and the weighted quality."""
    executions = findings.agg(F.count_distinct("execution").alias("executions"))
    by = findings.groupBy("type").agg(F.avg(F.col("useful").cast("double")).alias("useful"), F.avg("confidence").alias("confidence"), F.count_distinct("execution").alias("with_type"))
    out = by.join(F.broadcast(executions)).withColumn("genericity", F.round(F.col("with_type") / F.col("executions"), 3))
    penalty = F.when(F.col("genericity") > 0.8, F.round((F.col("genericity") - 0.8) / 0.2, 3)).otherwise(F.lit(0e0))
    quality = 0.6 * F.col("useful") + 0.3 * F.col("confidence") + 0.1 * (1 - penalty)
    return out.select("type", F.round("useful", 6).alias("useful"), F.round("confidence", 6).alias("confidence"), "genericity", F.round(quality, 6).alias("quality"))


def metrics_slices(cases: DataFrame, dims: list[str]) -> DataFrame:
    """Micro-averaged precision, recall and F1 of (expected, predicted) by each dimension and overall (dim ALL)."""
    pairs = F.explode(F.array(F.struct(F.lit("ALL").alias("dim"), F.lit("ALL").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")
    both = cases.select("expected", "predicted", pairs).groupBy("x.dim", "x.value").agg(
        F.count_if((F.col("expected") == 1) & (F.col("predicted") == 1)).alias("tp"), F.count_if((F.col("expected") == 0) & (F.col("predicted") == 1)).alias("fp"), F.count_if((F.col("expected") == 1) & (F.col("predicted") == 0)).alias("fn")
    )
    p = F.when(F.col("tp") + F.col("fp") == 0, F.when(F.col("fn") == 0, 1e0).otherwise(0e0)).otherwise(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))
    r = F.when(F.col("tp") + F.col("fn") == 0, F.lit(1e0)).otherwise(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    out = both.withColumns({"p": p, "r": r})
    f1 = F.when(F.col("p") + F.col("r") == 0, F.lit(0e0)).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return out.select("dim", "value", "tp", "fp", "fn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """n and r; r is 0 without variance."""
    s = df.agg(F.count("*").alias("n"), *[F.sum(e.cast("double")).alias(a) for a, e in (("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) * F.col(x)), ("syy", F.col(y) * F.col(y)), ("sxy", F.col(x) * F.col(y)))])
    var = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    r = F.when(var > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(0e0)
    return s.select("n", F.round(r, 6).alias("r"))
