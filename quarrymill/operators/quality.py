"""Summary of a quality run: every dimension from two passes of grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ["area", "document_type", "theme", "trap"]


def quality_summary(results: DataFrame) -> DataFrame:
    """dimension, value and sums: over all cases (dimension `all`), and for each area, document type, theme and kind of trap.

    results: area, document_type, theme, trap (null: none), trap_outcome (DETECTED, AVOIDED; anything else is missed), status, document_status, score (null: none),
    input_tokens, output_tokens, cost, ms. Mean scores are of cases that have one, 0 if none has. Of traps, cases with a null trap are left out of their dimension.
    """
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    trapped = F.col("trapped")
    rows = results.select(*[F.col(c) for c in results.columns], F.col("trap").isNotNull().alias("trapped"))
    sets = [[F.col(d)] for d in DIMENSIONS]
    made = rows.groupingSets([[], *sets], *[F.col(d) for d in DIMENSIONS]).agg(
        F.grouping_id().alias("g"), F.count("*").alias("total"), n(F.col("status") == "success").alias("succeeded"), n(F.col("document_status") == "MINUTA APROVADA").alias("approved"),
        n(F.col("document_status") == "APROVADA COM RESSALVAS").alias("with_caveats"), n(F.col("document_status") == "REPROVADA").alias("rejected"), F.coalesce(F.avg("score"), F.lit(0e0)).alias("avg_score"),
        n(trapped).alias("traps"), n(trapped & (F.col("trap_outcome") == "DETECTED")).alias("detected"), n(trapped & (F.col("trap_outcome") == "AVOIDED")).alias("avoided"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.avg("ms").alias("avg_ms"),
    )
    every = (1 << len(DIMENSIONS)) - 1
    ids = {every - (1 << (len(DIMENSIONS) - 1 - i)): d for i, d in enumerate(DIMENSIONS)}
    name, value = F.lit("all"), F.lit("")
    for g, d in ids.items():
        name, value = F.when(F.col("g") == g, d).otherwise(name), F.when(F.col("g") == g, F.col(d)).otherwise(value)
    out = made.select(name.alias("dimension"), value.alias("value"), *made.columns[len(DIMENSIONS) + 1 :]).withColumn("missed", F.col("traps") - F.col("detected") - F.col("avoided"))
    return out.where("dimension <> 'trap' or value is not null")


def top_rules(results: DataFrame, validator: Column, *, overall: int = 10, each: int = 5) -> DataFrame:
    """dimension (all, theme, validator), value, place, rule, n: the rules that cases broke most.

    results: theme, errors (array of rule, fatal). Overall and by theme only fatal errors count, by validator all do. `validator` is an expression of `rule`. Ties go by
    the rule's name. Counted in one pass of grouping sets; a place is given only among the rules of one value.
    """
    errors = results.select("theme", F.inline("errors")).withColumn("validator", validator)
    counts = errors.groupingSets([[F.col("rule")], [F.col("theme"), F.col("rule")], [F.col("validator"), F.col("rule")]], F.col("theme"), F.col("validator"), F.col("rule")).agg(F.grouping_id().alias("g"), F.count_if("fatal").alias("fatal"), F.count("*").alias("n"))
    dimension = F.when(F.col("g") == 6, "all").when(F.col("g") == 2, "theme").otherwise("validator")
    value = F.when(F.col("g") == 6, "").when(F.col("g") == 2, F.col("theme")).otherwise(F.col("validator"))
    rows = counts.select(dimension.alias("dimension"), value.alias("value"), "rule", F.when(F.col("g") == 4, F.col("n")).otherwise(F.col("fatal")).alias("n")).where("n > 0")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("dimension", "value").orderBy(F.desc("n"), "rule")))
    return placed.where(F.col("place") <= F.when(F.col("dimension") == "all", overall).otherwise(each)).select("dimension", "value", "place", "rule", "n")


#: The validator that a rule belongs to, by its name's beginning, by its name, and by its beginning where neither fits.
RULE_PREFIXES = [("EVIDENCE_", "EvidenceAnalyzer"), ("MATRIX_", "MatrixQualityValidator"), ("RICHNESS_", "RichnessValidator")]
RULES = {
    "RichnessValidator": "FINAL_DRAFT_GENERIC_LANGUAGE FINAL_DRAFT_WEAK_ARGUMENTATION",
    "JurisprudenceValidator": "JUR_MARKER_IN_DRAFT GENERIC_JURISPRUDENCE TRIBUNAL_MISMATCH",
    "AppealValidator": "INCOMPATIBLE_APPEAL WRONG_SUPERIOR_COURT JEF_JEC_WRONG_APPEAL CRIMINAL_WRONG_APPEAL CRIMINAL_MISSING_APPEAL_REF",
    "StructuralValidator": "MISSING_STRUCTURE DESPACHO_WITH_DECISION_LANGUAGE FORBIDDEN_STRUCTURE SENTENCA_MISSING_RELATORIO SENTENCA_MISSING_FUNDAMENTACAO SENTENCA_MISSING_DISPOSITIVO SENTENCA_MISSING_DECISION_VERB SENTENCA_MISSING_APPEAL_REF SENTENCA_RELATORIO_TOO_SHORT SENTENCA_FUNDAMENTACAO_TOO_SHORT SENTENCA_DISPOSITIVO_TOO_SHORT SENTENCA_DISPOSITIVO_VAGUE HC_MISSING_ORDER_VERB HC_WRONG_DISPOSITIVO",
    "LegalValidator": "RPPS_WRONG_ARTICLE RGPS_WRONG_ARTICLE WRONG_HONORARIOS WRONG_HONORARIOS_CRIMINAL BLOCKED_ARTICLE PROHIBITED_TERM CRIMINAL_WRONG_TERM REQUIRED_FIELD LOW_CONFIDENCE CRIMINAL_ARTICLE_85_CPC CRIMINAL_MISSING_DISPOSITIVO CRIMINAL_WRONG_CIVIL_VERB CRIMINAL_MISSING_DOSIMETRIA CRIMINAL_MISSING_REGIME CRIMINAL_ABSOLVICAO_MISSING_ART386 CRIMINAL_PRESCRICAO_MISSING_ART CRIMINAL_DESCLASSIFICACAO_MISSING_TIPO",
    "CivilValidator": "TUTELA_MISSING_ART300 TUTELA_MISSING_PERICULUM_MORA SENTENCA_MISSING_HONORARIOS SENTENCA_MISSING_CUSTAS",
    "ConsumerValidator": "CDC_APPLICATION_MISSING INVERSAO_ONUS_SEM_FUNDAMENTO DANO_MORAL_SEM_ANALISE_CONCRETA REPETICAO_DOBRO_SEM_MAE_FE",
    "ExecutionValidator": "EXECUTION_MISSING_SECTION EXECUTION_MISSING_CPC_BASIS EXECUTION_MISSING_MODALITY EXECUTION_MISSING_OBJECTION EXECUTION_SISBAJUD_MISSING",
    "EvidenceAnalyzer": "STANCE_MISMATCH_PRE_GENERATION STANCE_CONTRADICTION_RPPS STANCE_CONTRADICTION_RGPS STANCE_CONTRADICTION_JEF",
}
LATE_PREFIXES = [("JEF_", "JefCivelValidator")]


def validator_of(rule: Column) -> Column:
    out = F.when(rule.startswith(RULE_PREFIXES[0][0]), RULE_PREFIXES[0][1])
    for prefix, name in RULE_PREFIXES[1:]:
        out = out.when(rule.startswith(prefix), name)
    for name, rules in RULES.items():
        out = out.when(rule.isin(*rules.split()), name)
    for prefix, name in LATE_PREFIXES:
        out = out.when(rule.startswith(prefix), name)
    return out.otherwise("Other")
