"""Coverage and profiles on hand-made drafts."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import coverage as C
from quarrymill.plans.coverages import BY_REGIME, GATES, KNOWN, PROFILES, TOPICS
from quarrymill.plans.drafts import BLANKS, CITED, PIECE_LONG

LONG = " dos fatos e do direito se requer o que segue" * 25
CASES = [
    ("Aposentadoria especial." + LONG, "RGPS", None, None, {("RGPS", "aposentadoria_especial", ("exposicao_agente_nocivo", "habitualidade_permanencia", "prova_tecnica_ppp_ltcat"))}),
    ("Aposentadoria especial, ruído, PPP." + LONG, "RGPS", None, None, set()),
    ("Aposentadoria especial." + LONG, "RPPS", None, None, set()),
    ("Execução fiscal, CDA." + LONG, None, None, None, {("TRIBUTARIO", "anulacao_debito_fiscal", ("lancamento_constituicao_credito",))}),
    ("Guarda compartilhada." + LONG, None, None, "Guarda e alimentos", {("FAMILIA", "guarda_crianca", ("melhor_interesse_crianca", "condicoes_genitores"))}),
    ("Guarda compartilhada, melhor interesse." + LONG, None, None, "guarda", set()),
    ("Cobrança indevida do consumidor." + LONG, None, "JEC", None, {("CONSUMIDOR", "pretensao_consumerista", ("falha_servico_vicio_produto", "nexo_causal_dano"))}),
    ("Cobrança indevida do consumidor." + LONG, None, "OUTRA", None, set()),
    ("Paridade." + LONG, "RPPS", None, None, {("RPPS", "beneficio_rpps", ("requisitos_beneficio_rpps",))}),
    ("Horas extras e verbas rescisórias; vínculo de emprego com subordinação." + LONG, None, "TRABALHO", None, {("TRABALHISTA", "verbas_rescisorias", ("modalidade_rescisao",)), ("TRABALHISTA", "horas_extras", ("jornada_controle_extrapolacao",))}),
    ("O réu; condeno." + LONG, "CRIMINAL", None, None, {("CRIMINAL", "fundamentos_penais_essenciais", ("materialidade", "autoria", "tipicidade")), ("CRIMINAL", "dosimetria_da_pena", ("dosimetria_pena_base_regime",))}),
    ("Mandado de segurança." + LONG, None, None, None, {("FAZENDA_PUBLICA", "mandado_de_seguranca", ("direito_liquido_autoridade_coatora_prazo",))}),
    ("Paridade.", "RPPS", None, None, set()),
    ("Paridade. {{nome}}" + LONG, "RPPS", None, None, set()),
    ("Paridade.\n[NOME DA PARTE]" + LONG, "RPPS", None, None, set()),
    (None, "RPPS", None, None, set()),
]


def test_topics(spark):
    drafts = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "doc_id int, text string, regime string, justice string, subject string")
    got = {}
    for r in C.missing_topics(drafts, GATES, TOPICS, BLANKS, CITED, PIECE_LONG).collect():
        got.setdefault(r["doc_id"], set()).add((r["domain"], r["topic"], tuple(r["missing"])))
    for i, c in enumerate(CASES):
        assert got.get(i, set()) == c[4], c[0][:60]
    assert len(TOPICS) == 14 and {t.domain for t in TOPICS} == set(GATES)


@pytest.mark.parametrize("area, regime, subject, want", [
    ("RPPS", "CLT", None, "RPPS"), ("?", "CLT", None, "TRABALHISTA"), (None, None, None, "CIVEL_GERAL"), (None, None, "JEC, relação de consumo", "CONSUMIDOR"), (None, None, "Turma Recursal Federal", "JEF_FEDERAL"), (None, None, "JEF", "JEF_ESTADUAL"),
    (None, None, "licenciamento ambiental", "AMBIENTAL"), (None, None, "Habeas Corpus", "CRIMINAL"), (None, None, "execução fiscal", "TRIBUTARIO"), (None, None, "execução de título", "EXECUCAO_CUMPRIMENTO"), (None, None, "divórcio", "FAMILIA"),
    (None, None, "nomeação em concurso", "FAZENDA_PUBLICA"), (None, None, "código de defesa", "CONSUMIDOR"), (None, None, "contrato", "CIVEL_GERAL"),
])
def test_profiles(spark, area, regime, subject, want):
    s = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(C.select_profile(s(area), s(regime), s(subject), KNOWN, BY_REGIME, PROFILES, "CIVEL_GERAL")).first()[0] == want
