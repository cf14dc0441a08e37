"""The report on a draft from its findings, and what a text is by its own words.

Findings are rows, any number for a draft. A table of deductions says what a finding costs each score, so a draft's scores are sums that are
combined before the exchange.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import found_in_any_case
from quarrymill.operators.stance import matches


class Deduction(NamedTuple):
    """What each finding of these rules takes off a score: if fatal, and if not."""

    score: str
    rules: tuple[str, ...]
    fatal: int
    other: int


STRUCTURAL = tuple(
    "MISSING_STRUCTURE DESPACHO_WITH_DECISION_LANGUAGE FORBIDDEN_STRUCTURE SENTENCA_MISSING_RELATORIO SENTENCA_MISSING_FUNDAMENTACAO SENTENCA_MISSING_DISPOSITIVO SENTENCA_MISSING_DECISION_VERB SENTENCA_MISSING_APPEAL_REF SENTENCA_RELATORIO_TOO_SHORT SENTENCA_FUNDAMENTACAO_TOO_SHORT SENTENCA_DISPOSITIVO_TOO_SHORT SENTENCA_DISPOSITIVO_VAGUE HC_MISSING_ORDER_VERB HC_WRONG_DISPOSITIVO".split()
)
APPEAL = ("INCOMPATIBLE_APPEAL", "WRONG_SUPERIOR_COURT", "JEF_JEC_WRONG_APPEAL", "CRIMINAL_WRONG_APPEAL", "CRIMINAL_MISSING_APPEAL_REF")
CIVIL = ("TUTELA_MISSING_ART300", "TUTELA_MISSING_PERICULUM_MORA", "SENTENCA_MISSING_HONORARIOS", "SENTENCA_MISSING_CUSTAS")
PROBATORY = ("JUR_MARKER_IN_DRAFT", "GENERIC_JURISPRUDENCE", "TRIBUNAL_MISMATCH", "EVIDENCE_STANCE_VIOLATION", "EVIDENCE_STANCE_MATRIX")
STANCE = ("STANCE_CONTRADICTION_RPPS", "STANCE_CONTRADICTION_RGPS", "STANCE_CONTRADICTION_JEF", "STANCE_MISMATCH_PRE_GENERATION")
#: Deductions by rule.
DEDUCTIONS = [
    Deduction("structure", (*STRUCTURAL, *APPEAL), 20, 10), Deduction("structure", CIVIL, 8, 8), Deduction("evidence", PROBATORY, 25, 12),
    Deduction("consistency", STANCE, 30, 30), Deduction("consistency", ("EVIDENCE_STANCE_VIOLATION",), 20, 20),
]
STANCE_COST = {"CONTRADICTED": 25, "MIXED": 10}
WEIGHTS = {"structure": 25, "evidence": 25, "argument": 30, "consistency": 20}
#: Rule sets whose absence is a strength.
STRENGTHS = {"structure": STRUCTURAL, "appeal": APPEAL, "contrary_precedents": ("EVIDENCE_STANCE_VIOLATION",), "stance": STANCE}


def _label(score: Column) -> Column:
    return F.when(score >= 85, "Excelente").when(score >= 70, "Boa").when(score >= 50, "Regular").otherwise("Crítica")


def report(drafts: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """key, the four scores and their labels, technical, viability, class, quick_score, consistent, strengths, suggestions (each rule once, by name).

    drafts: key, richness (0 to 100), stance (null: not analysed). findings: key, rule, fatal; drafts without findings have full scores. Scores are 0 at least.
    """
    cost = lambda d: F.sum(F.when(F.col("rule").isin(*d.rules), F.when(F.col("fatal"), d.fatal).otherwise(d.other)).otherwise(0))
    taken = [cost(d).alias(f"_{i}") for i, d in enumerate(DEDUCTIONS)]
    broke = [F.max(F.col("rule").isin(*rules)).alias(f"_has_{n}") for n, rules in STRENGTHS.items()]
    sums = findings.groupBy(key).agg(*taken, *broke, F.count_if("fatal").alias("_fatal"), F.count_if(~F.col("fatal")).alias("_other"), F.sort_array(F.collect_set("rule")).alias("_rules"))  # a set of rule names, which are a fixed table
    both = drafts.join(sums, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    less = {s: reduce(Column.__add__, [zero(f"_{i}") for i, d in enumerate(DEDUCTIONS) if d.score == s]) for s in ("structure", "evidence", "consistency")}
    stance = F.lit(0)
    for name, points in STANCE_COST.items():
        stance = F.when(F.col("stance") == name, points).otherwise(stance)
    less["consistency"] = less["consistency"] + F.coalesce(stance, F.lit(0))
    scores = {s: F.greatest(F.lit(0), 100 - x).cast("int") for s, x in less.items()} | {"argument": F.coalesce("richness", F.lit(0)).cast("int")}
    out = both.withColumns(scores)
    technical = F.floor(reduce(Column.__add__, [F.col(s) * w for s, w in WEIGHTS.items()]) / 100 + 0.5).cast("int")
    fatal = zero("_fatal")
    viability = F.when(fatal == 0, 100).when(fatal == 1, 70).when(fatal == 2, 40).otherwise(0)
    kind = F.when(viability >= 85, "VIAVEL").when(viability >= 70, "ATENCAO").when(viability >= 40, "RISCO_ELEVADO").otherwise("CRITICA")
    quick = F.least(F.lit(95), F.greatest(F.lit(25), 80 - 15 * fatal - 2 * zero("_other"))).cast("int")
    consistent = F.when(F.col("consistency") >= 80, "CONSISTENTE").when(F.col("consistency") >= 50, "PARCIALMENTE CONSISTENTE").otherwise("INCONSISTENTE")
    strengths = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"_has_{n}"), F.lit(False)), n) for n in STRENGTHS]))
    labels = [_label(F.col(s)).alias(f"{s}_label") for s in ("structure", "evidence")]
    return out.select(key, *WEIGHTS, *labels, technical.alias("technical"), viability.alias("viability"), kind.alias("class"), quick.alias("quick_score"), consistent.alias("consistent"), strengths.alias("strengths"), F.coalesce("_rules", F.array().cast("array<string>")).alias("suggestions"))


class Ladder(NamedTuple):
    """Patterns in order, each with what a text is if it is the first found; else the default."""

    steps: list[tuple[str, str]]
    default: str

    def of(self, text: Column, lower: Column) -> Column:
        """`text` and `lower`, the text in lower case, should be columns, not expressions."""
        out = F.when(found_in_any_case(text, lower, self.steps[0][0]), self.steps[0][1])
        for pattern, name in self.steps[1:]:
            out = out.when(found_in_any_case(text, lower, pattern), name)
        return out.otherwise(F.lit(self.default))


def generation_mode(description: Column, confidence: Column, justice: Column, quality: Column, facts: Column, requests: Column, questions: Column, generic: list[str]) -> Column:
    """How far a draft can be written: the first rule that holds. Null texts are empty, null numbers 0."""
    text, n = F.btrim(F.coalesce(description, F.lit("")), F.lit(" \t\n\r\f\x0b")), lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(F.char_length(text) < 20, "SAFE_SKELETON").when((n(confidence) < 0.75) | F.coalesce(justice == "INDETERMINADA", F.lit(False)), "SAFE_SKELETON")
        .when(reduce(Column.__or__, [matches(text, p) for p in generic]), "TEMPLATE_MODEL").when(quality == "INSUFICIENTE", "SAFE_SKELETON").when(quality == "PARCIAL", "TEMPLATE_MODEL")
        .when((n(facts) >= 3) & (n(requests) >= 2) & (n(questions) >= 2), "POSSIBLE_FINAL_DRAFT").otherwise("TEMPLATE_MODEL")
    )
