"""Declarative rules over documents: guards, sections, patterns, coverage, and the report made of the findings.

A rule is data (`Rule`), so adding one adds an expression to the same pass: each document is normalised and
split once and all rules are evaluated in that row, without a join or an exchange.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import fold


@dataclass(frozen=True)
class Rule:
    """Fires if `reason` is in the reasoning and `outcome` in the outcome, `veto` nowhere, and fewer than `enough` of `blocks` are present."""

    code: str
    severity: str = "WARNING"
    reason: str | None = None
    outcome: str | None = None
    veto: str | None = None
    blocks: tuple[str, ...] = field(default_factory=tuple)
    enough: int = 0


def sections(docs: DataFrame, text: str, outcome_mark: str, key: str = "doc_id") -> DataFrame:
    """key, n_chars, whole, reasoning, outcome, marked: folded text split at the first mark, or 80 to 20 by length."""
    base = docs.select(key, fold(F.coalesce(F.col(text), F.lit(""))).alias("whole"))
    at = F.regexp_instr("whole", F.lit(outcome_mark))
    base = base.withColumns({"n_chars": F.char_length("whole"), "at": at})
    cut = F.when(F.col("at") > 1, F.col("at") - 1).otherwise(F.floor(F.col("n_chars") * 8 / 10).cast("int"))
    base = base.withColumn("cut", cut)
    return base.select(key, "n_chars", "whole", F.expr("substring(whole, 1, cut)").alias("reasoning"), F.expr("substring(whole, cut + 1)").alias("outcome"), (F.col("at") > 1).alias("marked"))


def _fires(rule: Rule) -> Column:
    test = F.lit(True)
    if rule.reason:
        test &= F.col("reasoning").rlike(rule.reason)
    if rule.outcome:
        test &= F.col("outcome").rlike(rule.outcome)
    if rule.veto:
        test &= ~F.col("whole").rlike(rule.veto)
    if rule.blocks:
        test &= sum((F.col("whole").rlike(b).cast("int") for b in rule.blocks), F.lit(0)) < rule.enough
    return test


def findings(split: DataFrame, rules: list[Rule], *, least_chars: int = 0, key: str = "doc_id") -> DataFrame:
    """key, code, severity of each rule that fires; texts under `least_chars` are skipped."""
    hits = F.array(*[F.when(_fires(r), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules])
    return split.where(F.col("n_chars") >= least_chars).select(key, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(key, "h.code", "h.severity")


def report(split: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_fatal, n_warning, technical, viability, quick_score, status: every document, also those without findings."""
    by = found.groupBy(key).agg(F.count_if(F.col("severity") == "FATAL").alias("f"), F.count_if(F.col("severity") == "WARNING").alias("w"))
    out = split.select(key, "marked").join(by, key, "left").select(key, "marked", F.coalesce("f", F.lit(0)).alias("n_fatal"), F.coalesce("w", F.lit(0)).alias("n_warning"))
    structure = F.greatest(F.lit(0), 100 - 20 * F.col("n_fatal") - 10 * F.col("n_warning") - F.when(F.col("marked"), 0).otherwise(8))
    evidence = F.greatest(F.lit(0), 100 - 25 * F.col("n_fatal") - 12 * F.col("n_warning"))
    consistency = F.greatest(F.lit(0), 100 - 30 * F.col("n_fatal") - 10 * F.col("n_warning"))
    technical = F.round((25 * structure + 25 * evidence + 30 * evidence + 20 * consistency) / F.lit(100e0)).cast("int")
    viability = F.when(F.col("n_fatal") == 0, 100).when(F.col("n_fatal") == 1, 70).when(F.col("n_fatal") == 2, 40).otherwise(0)
    quick = F.least(F.lit(95), F.greatest(F.lit(25), 80 - 15 * F.col("n_fatal") - 2 * F.col("n_warning")))
    out = out.withColumns({"technical": technical, "viability": viability, "quick_score": quick.cast("int")})
    status = F.when(F.col("n_fatal") > 0, "REJECT").when(F.col("technical") >= 90, "APPROVE").when(F.col("technical") >= 81, "CAVEATS").otherwise("REJECT")
    return out.withColumn("status", status).drop("marked")
