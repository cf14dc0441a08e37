"""Queries of the draft audits: whole documents with a passage of a draft behind each, because the driver's texts are invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import drafts as D
from quarrymill.plans.catalog import FOLD, query, read

PASSAGES = [
    "Dos fatos. Fundamentação: reconheço a prescrição da pretensão e a ausência de prova. Ante o exposto, julgo procedente e condeno o réu.",
    "Fundamentação: há coisa julgada e mero aborrecimento. Isto posto, condeno o autor em custas; fixo a indenização por dano moral.",
    "Análise do pedido: não há incapacidade, carência não cumprida, ppp insuficiente. Pelo exposto, restabeleço o benefício, concedo o benefício e o tempo especial.",
    "Do mérito: ilegitimidade passiva, falta de interesse processual e inexistência de vínculo. Diante do exposto, defiro: anotação em CTPS, pagamento de indenização.",
    "Fundamentação: sem prejuízo concreto e vício de legalidade. Dispositivo: arbitro indenização; mantém-se o ato.",
    "O laudo pericial e a perícia médica constam; o contrato assinado e o recibo também. Ante o exposto, improcedente: ausência de pagamento e relação não comprovada.",
    "PPP e LTCAT; a testemunha confirmou. A dependência econômica comprovada. Isso posto, não reconheço tempo especial; horas extras indevidas; ausência de dependência.",
    "Laudo pericial: o perito afastou a incapacidade, PPP não comprova, nao ha comprovante de PIX. Ante o exposto, improcedente, atividade comum, pagamento não comprovado.",
    "DOS PEDIDOS: dano moral, alimentos e guarda; subsidiariamente, pensão; liminar. Ante o exposto, condeno o réu ao pagamento de danos e concedo a aposentadoria, com alimentos.",
    "A autora requer a pensão e pleiteia horas extras, com tutela de urgência. Ante o exposto, defiro a pensão e determino obrigação de fazer; autorizo a guarda; concedo o auxílio com DIB.",
    "Pede vínculo empregatício e dano material. Ante o exposto, julgo improcedente o pedido. Obrigação de fazer no prazo de dez dias.",
    "Excelentíssimo: o direito alegado, matéria cível e o cumprimento da obrigação [INSERIR nome] [A DETERMINAR] [verificar]. É o relatório. Decido. Processo n. 1. Defiro.",
    "Cumprimento da obrigação de fazer, art. 536. Trata-se de motivação. Pesquisa livre: pretensão da parte autora. Julgamento de mérito; analise as provas; julgo.",
    "Dos fatos, dos pedidos, valor da causa. A sentença recorrida; requer o provimento. {{nome}}",
    "Ementa. Acórdão. Relator. Turma. STJ. STF. Dje.",
]
_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PASSAGES) + "]"
_DRAFTS = f"SELECT doc_id, coalesce(text, '') || chr(10) || {_LIST}[(doc_id % {len(PASSAGES)})::INT + 1] AS t FROM documents"

#: Marks of a form, of decisions, of a draft, and of its parts.
BLANKS = r"(?im)\{\{|\}\}|^\s*_{4,}\s*$|\[PREENCHER\]|\[NOME\s|\[DATA\s|\[CPF\s|\bXXX\b"
CITED = [r"\bementa\b", r"\bacordao\b|\bacórdão\b", r"\brelator\b", r"\bturma\b", r"julgado\s+em", r"\bdje\b", r"\bstj\b", r"\bstf\b", r"\btrf\b", r"\btst\b", r"\bprecedente\b"]
PIECE = [r"dos\s+fatos", r"do\s+direito", r"fundamenta", r"dispositivo", r"ante\s+o\s+exposto", r"\brequer\b", r"\bjulgo\b", r"\bdefiro\b", r"\bcondeno\b"]
PIECE_LONG = [*PIECE, r"diante\s+do\s+exposto", r"\bindefiro\b"]
OUTCOME = r"dispositivo|ante\s+o\s+exposto|isso\s+posto|isto\s+posto|pelo\s+exposto|diante\s+do\s+exposto"
REASONING = r"fundamentacao|do\s+merito|analise\s+do\s+(?:caso|pedido)"

#: Reasons that an outcome contradicts. CONDEMN leaves out orders against the side that asked.
_OTHER_SIDE = r"\s+[oa]a?\s+(?:autor[a]?|requerente[s]?|reclamante[s]?|impetrante[s]?|apelante[s]?|recorrente[s]?)"
CONDEMN = f"condeno(?!{_OTHER_SIDE})"
GRANTED = rf"julgo\s+procedente|procedencia\s+do\s+pedido|{CONDEMN}|concedo|defiro|reconheco\s+o\s+direito"
MERITS = rf"{CONDEMN}|julgo\s+procedente|defiro|concedo"
CONTRADICTIONS = [
    D.Pair("PRESCRIPTION_PROCEDENCE_CONTRADICTION", r"prescricao|decadencia|extincao\s+do\s+direito|perda\s+da\s+pretensao", GRANTED),
    D.Pair("STANDING_CONTRADICTION", r"ilegitimidade\s+ativa|ilegitimidade\s+passiva|parte\s+ilegitima|ausencia\s+de\s+legitimidade", MERITS),
    D.Pair("LACK_OF_EVIDENCE_CONTRADICTION", r"ausencia\s+de\s+prova|insuficiencia\s+probatoria|nao\s+comprovado|nao\s+demonstrado|inexistencia\s+de\s+prova", MERITS),
    D.Pair("MORAL_DAMAGE_CONTRADICTION", r"mero\s+aborrecimento|inexistencia\s+de\s+dano\s+moral|nao\s+configurado\s+dano\s+moral|sem\s+dano\s+moral", r"dano\s+moral|indenizacao\s+moral|compensacao\s+moral"),
    D.Pair(
        "EMPLOYMENT_RELATION_CONTRADICTION", r"ausencia\s+de\s+subordinacao|inexistencia\s+de\s+vinculo|nao\s+comprovado\s+vinculo|nao\s+caracterizada\s+relacao\s+de\s+emprego",
        r"reconheco\s+o\s+vinculo|declaro\s+o\s+vinculo|verbas\s+trabalhistas|anotacao\s+em\s+ctps",
    ),
    D.Pair(
        "SPECIAL_ACTIVITY_CONTRADICTION", r"nao\s+comprovada\s+exposicao|ausencia\s+de\s+agente\s+nocivo|ppp\s+insuficiente|ltcat\s+insuficiente|atividade\s+nao\s+especial",
        r"tempo\s+especial|atividade\s+especial|aposentadoria\s+especial|conversao\s+de\s+tempo\s+especial",
    ),
    D.Pair("RES_JUDICATA_MERITS_CONTRADICTION", r"coisa\s+julgada|litispendencia|perempcao", GRANTED),
    D.Pair("LACK_OF_INTEREST_PROCEDENCE_CONTRADICTION", r"ausencia\s+de\s+interesse\s+de\s+agir|falta\s+de\s+interesse\s+processual|carencia\s+de\s+acao|interesse\s+de\s+agir\s+ausente", GRANTED),
    D.Pair(
        "NO_DAMAGE_COMPENSATION_CONTRADICTION",
        r"ausencia\s+de\s+dano\s+(?:material|patrimonial)|dano\s+(?:material\s+)?nao\s+configurado|inexistencia\s+de\s+dano\s+(?:material|patrimonial|economico)|sem\s+prejuizo\s+concreto|prejuizo\s+nao\s+comprovado|nao\s+comprovado\s+o\s+prejuizo",
        r"indenizacao\s+(?:no\s+valor|de\s+r|material|patrimonial)|fixo\s+(?:a\s+)?indenizacao|arbitro\s+(?:a\s+)?indenizacao|pagamento\s+de\s+indenizacao",
    ),
    D.Pair(
        "NO_INCAPACITY_BENEFIT_CONTRADICTION",
        r"ausencia\s+de\s+incapacidade|incapacidade\s+nao\s+comprovada|nao\s+comprovada\s+incapacidade|capacidade\s+laboral\s+preservada|sem\s+incapacidade\s+para\s+o\s+trabalho|nao\s+ha\s+incapacidade",
        r"auxilio[- ]doenca|aposentadoria\s+por\s+incapacidade|beneficio\s+por\s+incapacidade|restabeleco\s+o\s+beneficio|concedo\s+o\s+auxilio",
    ),
    D.Pair(
        "NO_QUALITY_INSURED_BENEFIT_CONTRADICTION",
        r"ausencia\s+de\s+qualidade\s+de\s+segurado|nao\s+mantem\s+a\s+qualidade|qualidade\s+de\s+segurado\s+nao\s+comprovada|periodo\s+de\s+graca\s+expirado|carencia\s+nao\s+cumprida",
        r"concedo\s+o\s+beneficio|\bdefiro\s+o\s+beneficio|determino\s+a\s+implantacao|implantacao\s+do\s+beneficio",
    ),
    D.Pair(
        "ADMIN_NULLITY_MAINTAINED_ACT_CONTRADICTION",
        r"nulidade\s+do\s+ato\s+administrativo|ato\s+administrativo\s+nulo|vicio\s+de\s+legalidade|ausencia\s+de\s+motivacao\s+(?:do\s+)?ato|incompetencia\s+da\s+autoridade|violacao\s+(?:[ae]\s+|ao\s+|da\s+)?legalidade",
        r"mantem[-\s]se\s+o\s+ato|nao\s+anulo\s+o\s+ato|indefiro\s+(?:o\s+pedido\s+de\s+)?anulacao|ato\s+(?:e\s+)?mantido|denego\s+a\s+anulacao",
    ),
]

#: Evidence that a conclusion denies, unless the evidence itself is negative.
EVIDENCE = [
    D.Pair(
        "MEDICAL_EVIDENCE_INCAPACITY_CONTRADICTION", r"laudo\s+pericial|pericia\s+medica|perito\s+concluiu|incapacidade\s+(?:laboral|total|parcial|permanente|temporaria)",
        r"improcedente|indefiro\s+(?:o\s+)?beneficio|nao\s+faz\s+jus\s+ao\s+beneficio|ausencia\s+de\s+incapacidade|beneficio\s+indevido",
        r"nao\s+constatou\s+(?:a\s+)?incapacidade|capacidade\s+laboral\s+preservada|apto\s+ao\s+trabalho|sem\s+incapacidade\s+(?:laboral|total|parcial)|perito\s+(?:afastou|nao\s+constatou|negou)\s+(?:a\s+)?incapacidade",
    ),
    D.Pair(
        "SPECIAL_ACTIVITY_EVIDENCE_CONTRADICTION", r"\bppp\b|ltcat|agente\s+nocivo|exposicao\s+(?:habitual|permanente)|\bruido\b|\bcalor\b|agente\s+(?:quimico|biologico)",
        r"nao\s+reconheco\s+(?:o\s+)?tempo\s+especial|improcedente|atividade\s+comum|nao\s+comprovada\s+atividade\s+especial",
        r"ppp\s+(?:insuficiente|nao\s+(?:comprova|demonstra))|ltcat\s+insuficiente|ausencia\s+de\s+agente\s+nocivo|exposicao\s+nao\s+comprovada|nao\s+comprova\s+(?:a\s+)?exposicao|agente\s+nocivo\s+nao\s+(?:comprovado|identificado)",
    ),
    D.Pair(
        "PAYMENT_PROOF_CONTRADICTION", r"comprovante\s+de\s+pagamento|\brecibo\b|\bted\b|\bpix\b|transferencia\s+bancaria|comprovante\s+anexado",
        r"nao\s+houve\s+pagamento|ausencia\s+de\s+pagamento|pagamento\s+nao\s+comprovado|inexistencia\s+de\s+pagamento",
        r"ausencia\s+de\s+comprovante|inexistencia\s+de\s+recibo|nao\s+ha\s+comprovante|sem\s+comprovante\s+de\s+pagamento|comprovante\s+(?:inexistente|nao\s+(?:juntado|apresentado))",
    ),
    D.Pair(
        "CONTRACT_EVIDENCE_CONTRADICTION", r"contrato\s+juntado|instrumento\s+contratual|contrato\s+assinado|documento\s+contratual",
        r"inexistencia\s+de\s+relacao\s+juridica|relacao\s+nao\s+comprovada|ausencia\s+de\s+vinculo\s+contratual",
        r"nao\s+ha\s+(?:contrato|instrumento)|inexistencia\s+de\s+contrato|contrato\s+nao\s+(?:juntado|assinado|apresentado|existe)|ausencia\s+de\s+instrumento\s+contratual",
    ),
    D.Pair(
        "WITNESS_OVERTIME_CONTRADICTION", r"testemunha\s+confirmou|testemunhas\s+afirmaram|prova\s+testemunhal|jornada\s+extraordinaria|labor\s+extraordinario|sobrejornada",
        r"horas\s+extras\s+indevidas|ausencia\s+de\s+prova|nao\s+comprovada\s+jornada|improcedencia\s+do\s+pedido\s+de\s+horas\s+extras",
        r"testemunha\s+nao\s+(?:confirmou|confirma)|testemunhas\s+nao\s+(?:afirmaram|confirmaram)|prova\s+testemunhal\s+(?:insuficiente|nao|inconsistente)|nao\s+confirmou\s+(?:a\s+)?jornada",
    ),
    D.Pair(
        "DEPENDENCY_EVIDENCE_CONTRADICTION", r"dependencia\s+economica\s+(?:comprovada|demonstrada|reconhecida)|\bdependente\b|dependencia\s+(?:demonstrada|reconhecida)",
        r"ausencia\s+de\s+dependencia|dependencia\s+nao\s+comprovada|improcedente\s+(?:o\s+pedido\s+de\s+)?pensao|indeferida?\s+(?:a\s+)?pensao",
        r"dependencia\s+(?:economica\s+)?nao\s+(?:comprovada|demonstrada|reconhecida)|ausencia\s+de\s+dependencia|nao\s+(?:e|era)\s+dependente|requerente\s+nao\s+(?:e|era)\s+dependente",
    ),
]

#: How requests, and what an outcome grants, are known.
REQUESTS = D.Requests(
    topics={
        "dano moral": r"dano\s+moral", "dano material": r"dano\s+material", "aposentadoria": "aposentadoria", "auxílio": r"\bauxilio\b", "pensão": r"\bpensao\b",
        "vínculo empregatício": r"vinculo\s+empregat|relacao\s+de\s+emprego", "horas extras": r"horas\s+extras", "guarda": r"\bguarda\b", "alimentos": r"\balimentos\b",
        "anulação de débito": r"anulacao\s+d[eo]\s+debito", "nulidade de ato": r"nulidade\s+d[eo]\s+ato",
    },
    section=r"dos\s+pedidos|dos\s+requerimentos|\bpedidos\b",
    verbs=r"\brequer\b|\bpede\b|\bpostula\b|\bpleiteia\b|\bpedido\s+de\b",
    actions=r"\bcondeno\b|\bdefiro\b|\bconcedo\b|\breconheco\b|\bdetermino\b|\bdeclaro\b|\bfixo\b|\bautorizo\b",
    blanket=r"improcedentes?\s+(?:o\s+pedido|todos\s+os\s+pedidos|os\s+pedidos)|julgo\s+improcedente\s+o\s+pedido|rejeito\s+os\s+pedidos|indefiro\s+os\s+pedidos|nao\s+acolho\s+o\s+pedido",
    fallback=r"subsidiariamente|sucessivamente|pedido\s+subsidiario|alternativamente",
    injunction=r"tutela\s+de\s+urgencia|tutela\s+antecipada|tutela\s+provisoria|\bliminar\b",
    injunction_met=r"\btutela\b|\bliminar\b|\burgencia\b|medida\s+cautelar|prejudicado\s+o\s+pedido\s+de\s+tutela|tutela\s+absorvida\s+pelo\s+merito|desnecessaria\s+analise\s+da\s+tutela",
    triggers=[
        (r"condeno\s+a\s+indenizar|condeno[^\n.]{0,30}?\bao\s+pagamento\s+de\s+(?:indenizacao|danos?)\b", r"r\$|\brs\b|valor\s+de|quantia\s+de|[0-9][0-9.,]*\s*(?:mil|reais?)", "valor (R$)"),
        (r"concedo\s+(?:a\s+)?aposentadoria", r"\bdib\b|\bder\b|implantac|implantar", "DIB/DER ou implantação"),
        (r"concedo\s+(?:o\s+)?(?:auxilio|beneficio)", r"\bdib\b|\bder\b|implantac|implantar", "DIB/DER ou implantação"),
        (r"obrigacao\s+de\s+fazer", r"\bprazo\b|\bdias?\b|\bhoras?\b|\bsemanas?\b", "prazo para cumprimento"),
    ],
)

#: What a draft of each type must (True) or must not (False) have, and whether its lack is fatal.
_ORDER = r"concedo\s+(?:parcialmente\s+)?a?\s*ordem|denego\s+a?\s*ordem"
FORMS = [
    D.Form("SENTENCA", "report", r"relat[oó]rio|trata[\s-]se\s+de|cuida[\s-]se\s+de|trata\s+o\s+feito", True, True),
    D.Form("SENTENCA", "reasoning", r"fundamenta[cç][aã]o|motiva[cç][aã]o|an[aá]lise\s+do\s+m[eé]rito|\bfundamento\b", True, True),
    D.Form(
        "SENTENCA", "outcome",
        r"ante\s+o\s+exposto|julgo\s+(?:procedente|improcedente|extinto|parcialmente)|absolvo|condeno|desclassifico|declaro\s+extinta?\s+a\s+punibilidade|defiro|indefiro|revogo|mantenho|" + _ORDER + r"|decreto\s+a|relaxo", True, True,
    ),
    D.Form("SENTENCA", "number", r"processo\s+n[°oº.]", True, False),
    D.Form("SENTENCA", "address", r"excelent[íi]ssimo", False, True),
    D.Form("DECISAO", "report", r"[ée]\s+o\s+relat[oó]rio\.?\s*(?:decido|passo\s+a\s+decidir)", True, False),
    D.Form("DECISAO", "outcome", r"ante\s+o\s+exposto|defiro|indefiro|determino|revogo|mantenho|substituo|relaxo|decreto\s+a|torno\s+sem\s+efeito|" + _ORDER, True, True),
    D.Form("DECISAO", "number", r"processo\s+n[°oº.]", True, False),
    D.Form("DECISAO", "address", r"excelent[íi]ssimo", False, True),
    D.Form("DESPACHO", "number", r"processo\s+n[°oº.]|processo\s+em\s+ep[ií]grafe", True, False),
    D.Form("DESPACHO", "address", r"excelent[íi]ssimo", False, True),
    D.Form("DESPACHO", "analysis", r"analis[eo]\s+(?:as?\s+provas?|o\s+m[eé]rito|probat[oó]rio)", False, True),
    D.Form("DESPACHO", "merits", r"julgamento\s+de\s+m[eé]rito|m[eé]rito\s+da\s+causa", False, True),
    D.Form("DESPACHO", "judging", r"\bjulgo\b", False, True),
    D.Form("DESPACHO", "deciding", r"\b(?:defiro|indefiro|rejeito|acolho|condeno|absolvo|nego\s+provimento|dou\s+provimento)\b", False, True),
    D.Form(
        "RECURSO", "decision",
        r"decis[aã]o\s+recorrida|senten[cç]a\s+(?:de|recorrida|objurgada|de\s+primeiro\s+grau)|acord[aã]o\s+recorrido|decis[aã]o\s+de\s+primeiro|v\.\s+senten[cç]a|r\.\s+senten[cç]a|senten[cç]a\s+(?:ora\s+)?recorrida|"
        r"decis[aã]o\s+(?:ora\s+)?recorrida|ato\s+decisório\s+recorrido|julgado\s+(?:recorrido|a\s+quo)", True, False,
    ),
    D.Form(
        "RECURSO", "request",
        r"requer(?:-se)?|pedido\s+(?:recursal|de\s+reforma)|pede\s+(?:deferimento|provimento)|pede-se|pugna[-\s]se|pugna\s+(?:pelo|pela)|provimento\s+do\s+recurso|reforma\s+(?:integral|parcial|total)\s+da", True, False,
    ),
    D.Form(
        "PETICAO_INICIAL", "facts",
        r"dos\s+fatos|da\s+narrativa\s+f[áa]tica|relato\s+f[áa]tico|da\s+ocorr[êe]ncia|dos\s+antecedentes|breve\s+relato|contextualiza[cç][aã]o\s+f[áa]tica|descri[cç][aã]o\s+dos\s+fatos|hist[oó]rico\s+dos\s+fatos|dos\s+elementos\s+f[áa]ticos", True, False,
    ),
    D.Form("PETICAO_INICIAL", "requests", r"dos\s+pedidos|dos\s+requerimentos|do\s+pedido\s+final|requerimentos\s+finais|das\s+conclus[oõ]es\s+e\s+pedidos|do\s+requerimento\s+final|d[oa]\s+pedido\s+(?:principal|acess[oó]rio)", True, False),
    D.Form("PETICAO_INICIAL", "value", r"valor\s+da\s+causa|valor\s+atribu[íi]do\s+(?:à|a)\s+causa|d[ao]\s+valor\s+atribu[íi]do", True, False),
]
TYPES = ["SENTENCA", "DECISAO", "DESPACHO", "RECURSO", "PETICAO_INICIAL", "OUTRO"]

#: Phrases of generic drafts, one that is generic only without a context, and blanks.
GENERIC = [
    r"\bo\s+direito\s+alegado\b", r"\breconhecimento\s+do\s+direito\s+alegado\b", r"\bpretens[aã]o\s+da\s+parte\s+(?:recorrente|autora|r[eé])\b", r"\bdireito\s+material\s+postulado\b", r"\bmat[eé]ria\s+c[ií]vel\b", r"\bpesquisa\s+livre\b",
]
BARE = r"\bcumprimento\s+d[ao]\s+obriga[cç][aã]o\b"
CONTEXT = r"obriga[cç][aã]o\s+de\s+(?:fazer|n[aã]o\s+fazer)|cumprimento\s+de\s+senten[cç]a|art\.?\s*536|obriga[cç][aã]o\s+(?:contratual|indenizat[oó]ria)"
TO_FILL = r"\[(?:INSERIR|A DETERMINAR|PREENCHER|VERIFICAR|DADO NÃO FORNECIDO)[^\]]*\]"

#: The authorities of identifiers, terms of a domain, and its central norms with their points.
COURTS = {"superior.tribunal.justica": "STJ", "supremo.tribunal.federal": "STF", **{f"tribunal.regional.federal.{k}.regiao": f"TRF{k}" for k in range(1, 6)}}
DOMAIN = ["previdência", "rpps", "aposentadoria", "pensão", "servidor", "paridade", "integralidade"]
CENTRAL = [(("emenda constitucional nº 41", "emenda constitucional n. 41"), 0.20), (("emenda constitucional nº 47", "emenda constitucional n. 47"), 0.20), (("lei nº 8.112", "lei 8.112"), 0.15)]


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    passage = F.get(F.array(*map(F.lit, PASSAGES)), (F.col("doc_id") % len(PASSAGES)).cast("int"))
    return read(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), passage).alias("t"))


def _has(text: str, pattern: str) -> str:
    """DuckDB's test for a pattern; its engine has no look-ahead, so orders against the side that asked are counted instead."""
    if CONDEMN in pattern:
        rest = "|".join(p for p in pattern.replace(CONDEMN, "").split("|") if p)
        return f"(regexp_matches({text}, '{rest}') OR len(regexp_extract_all({text}, 'condeno')) > len(regexp_extract_all({text}, 'condeno{_OTHER_SIDE}')))"
    return f"regexp_matches({text}, '{pattern}')"


def _at(text: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN length(string_split_regex({text}, '{pattern}')[1]) END"


def _guard(piece: list[str]) -> str:
    count = lambda ps: " + ".join(f"regexp_matches(lower(t), '{p}')::INT" for p in ps)
    useful = r"length(trim(regexp_replace(regexp_replace(t, '\[[^\]]{3,}\]', '', 'g'), '\s+', ' ', 'g')))"
    return f"{useful} < 800 OR regexp_matches(t, '{BLANKS}') OR ({count(CITED)} >= 4 AND {count(piece)} <= 1)"


def _parts_sql(piece: list[str], reasoning: str | None = None) -> str:
    start = _at("w", reasoning) if reasoning else "0"
    ordered = "coalesce(o > r, false)" if reasoning else "o IS NOT NULL"
    return (
        f"WITH d AS ({_DRAFTS}), k AS (SELECT doc_id, {FOLD.format('t')} AS w FROM d WHERE NOT ({_guard(piece)})), m AS (SELECT *, {_at('w', OUTCOME)} AS o, {start} AS r FROM k), "
        f"c AS (SELECT *, CASE WHEN {ordered} THEN o ELSE floor(length(w) * 8 / 10)::INT END AS cut, CASE WHEN {ordered} THEN r ELSE 0 END AS lo FROM m), s AS (SELECT doc_id, w[lo + 1:cut] AS pre, w[cut + 1:] AS post FROM c) "
    )


def _pairs_sql(rules: list[D.Pair]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{r.code}' AS code FROM s WHERE {_has('pre', r.reason)} AND {_has('post', r.outcome)}" + (f" AND NOT {_has('pre', r.veto)}" if r.veto else "") for r in rules)


def _kept(spark: SparkSession, sf: str, piece: list[str]) -> DataFrame:
    return _drafts(spark, sf).where(~D.skipped(F.col("t"), BLANKS, CITED, piece))


@query("contradiction_pack", _parts_sql(PIECE_LONG, REASONING) + _pairs_sql(CONTRADICTIONS))
def contradiction_pack(spark: SparkSession, sf: str) -> DataFrame:
    return D.pair_findings(D.parts(_kept(spark, sf, PIECE_LONG), "t", OUTCOME, REASONING), CONTRADICTIONS)


@query("evidence_rules", _parts_sql(PIECE) + _pairs_sql(EVIDENCE))
def evidence_rules(spark: SparkSession, sf: str) -> DataFrame:
    return D.pair_findings(D.parts(_kept(spark, sf, PIECE), "t", OUTCOME), EVIDENCE)


def _windows_sql(text: str, pattern: str, before: int, after: int) -> str:
    cut = f"string_split(regexp_replace({text}, '({pattern})', chr(1) || '\\1', 'g'), chr(1))"
    return f"array_to_string(list_transform(range(2, len({cut}) + 1), lambda i: right(array_to_string(({cut})[1:i - 1], ''), {before}) || left(array_to_string(({cut})[i:], ''), {after})), chr(1))"


def _topics_sql(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{n}' END" for n, p in REQUESTS.topics.items()) + "], lambda x: x IS NOT NULL)"


_LACKS = ", ".join(f"CASE WHEN regexp_matches(post, '{t}') AND NOT regexp_matches(post[({_at('post', t)}) + 1:({_at('post', t)}) + 500], '{n}') THEN '{name}' END" for t, n, name in REQUESTS.triggers)
_MINUS = "array_to_string(list_filter({}, lambda x: NOT list_contains({}, x)), '; ')"


@query(
    "request_rules",
    _parts_sql(PIECE)
    + f", x AS (SELECT *, {_at('pre', REQUESTS.section)} AS q, {_at('pre', REQUESTS.fallback)} AS sub FROM s), "
    + f"y AS (SELECT *, CASE WHEN q IS NOT NULL THEN pre[q + 1:] ELSE {_windows_sql('pre', REQUESTS.verbs, 0, 400)} END AS scope, {_windows_sql('post', REQUESTS.actions, 20, 200)} AS acts, coalesce(pre[sub + 1:sub + 500], '') AS fallback FROM x), "
    + f"z AS (SELECT doc_id, pre, post, {_topics_sql('scope')} AS asked, {_topics_sql('acts')} AS granted, {_topics_sql('post')} AS met, {_topics_sql('fallback')} AS second, {_has('post', REQUESTS.blanket)} AS blanket, {_has('post', REQUESTS.actions)} AS active FROM y), "
    + "f AS (SELECT doc_id, 'UNADDRESSED_MAIN_REQUEST' AS code, " + _MINUS.format("asked", "met") + " AS detail FROM z WHERE NOT blanket AND active "
    + "UNION ALL SELECT doc_id, 'UNADDRESSED_SUBSIDIARY_REQUEST', " + _MINUS.format("second", "met") + " FROM z WHERE NOT blanket "
    + f"UNION ALL SELECT doc_id, 'UNADDRESSED_INJUNCTION_REQUEST', 'injunction' FROM z WHERE {_has('pre', REQUESTS.injunction)} AND NOT {_has('post', REQUESTS.injunction_met)} "
    + "UNION ALL SELECT doc_id, 'RELIEF_NOT_REQUESTED', " + _MINUS.format("granted", "asked") + " FROM z WHERE len(asked) > 0 "
    + f"UNION ALL SELECT doc_id, 'INCOMPLETE_RELIEF', array_to_string(list_filter([{_LACKS}], lambda x: x IS NOT NULL), '; ') FROM z) SELECT * FROM f WHERE detail <> ''",
)
def request_rules(spark: SparkSession, sf: str) -> DataFrame:
    return D.request_findings(D.parts(_kept(spark, sf, PIECE), "t", OUTCOME), REQUESTS)


@query(
    "structure_rules",
    f"WITH d AS (SELECT doc_id, t, {TYPES}[(doc_id // 7 % {len(TYPES)})::INT + 1] AS kind FROM ({_DRAFTS})) "
    + " UNION ALL ".join(f"SELECT doc_id, kind, '{f.name}' AS name, {f.fatal} AS fatal FROM d WHERE kind = '{f.type}' AND {'NOT ' if f.required else ''}regexp_matches(t, '(?i){f.pattern}')" for f in FORMS),
)
def structure_rules(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.floor(F.col("doc_id") / 7) % len(TYPES)).cast("int"))
    return D.form_findings(_drafts(spark, sf).withColumn("kind", kind), "t", "kind", FORMS)


_QUALITY = ["SUFICIENTE", "PARCIAL", "INSUFICIENTE"]


def _of(values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))


def _of_sql(values: list[str]) -> str:
    return f"{values}[(doc_id % {len(values)})::INT + 1]"


@query(
    "genericity_score",
    f"WITH d AS ({_DRAFTS}) SELECT doc_id, (" + " + ".join(f"regexp_matches(t, '(?i){p}')::INT" for p in GENERIC) + f" + (regexp_matches(t, '(?i){BARE}') AND NOT regexp_matches(t, '(?i){CONTEXT}'))::INT "
    f"+ CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END + CASE {_of_sql(_QUALITY)} WHEN 'INSUFICIENTE' THEN 3 WHEN 'PARCIAL' THEN 1 ELSE 0 END + least(5, len(regexp_extract_all(t, '(?i){TO_FILL}'))))::INT AS score FROM d",
)
def genericity_score(spark: SparkSession, sf: str) -> DataFrame:
    score = D.genericity(F.col("t"), F.col("low"), F.col("doc_id") % 4, F.col("doc_id") % 5, _of(_QUALITY), GENERIC, BARE, CONTEXT, TO_FILL)
    return _drafts(spark, sf).withColumn("low", F.lower("t")).select("doc_id", score.cast("int").alias("score"))


@query("ocr_gate", r"WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', '', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: length(x) > 3 AND regexp_matches(x, '[a-zA-ZÀ-ÿ]'))) >= 25 AS useful FROM w")
def ocr_gate(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", D.enough_words(F.col("text")).alias("useful"))


_AUTHORITIES = [*COURTS, "ministerio.fazenda"]


@query(
    "urn_courts",
    f"WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE 'urn:lex:br:' || {_AUTHORITIES}[(o_orderkey % {len(_AUTHORITIES)})::INT + 1] || ';acordao:' || o_orderdate::DATE END AS urn FROM orders), "
    "a AS (SELECT *, regexp_extract(urn, 'urn:lex:br:([^;]+)', 1) AS a FROM u) SELECT o_orderkey, urn, CASE " + " ".join(f"WHEN a = '{k}' THEN '{v}'" for k, v in COURTS.items()) + " ELSE upper(string_split(a, '.')[-1]) END AS court, replace(replace(urn, ':', '%3A'), ';', '%3B') AS path FROM a",
)
def urn_courts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    authority = F.get(F.array(*map(F.lit, _AUTHORITIES)), (key % len(_AUTHORITIES)).cast("int"))
    urn = F.when(key % 11 == 0, "none").otherwise(F.concat(F.lit("urn:lex:br:"), authority, F.lit(";acordao:"), F.col("o_orderdate").cast("date").cast("string")))
    return read(spark, sf, "orders").select("o_orderkey", urn.alias("urn")).select("o_orderkey", "urn", D.urn_court(F.col("urn"), COURTS).alias("court"), F.url_encode("urn").alias("path"))


_NORMS = ["Constituição Federal", "Emenda Constitucional nº 41/2003", "Emenda Constitucional nº 47/2005", "Lei nº 8.112/1990", "Lei nº 8.213/1991", "Código Civil"]
_THESIS = "direito à paridade conforme emenda constitucional"
_S = {"name": "lower(norm)", "art": "lower(trim(device[5:]))", "number": "regexp_replace(lower(trim(device[5:])), '[º°o]', '', 'g')"}


@query(
    "statute_rank",
    f"WITH p AS (SELECT p_partkey, {_NORMS}[(p_partkey % {len(_NORMS)})::INT + 1] AS norm, 'Art. ' || (p_partkey % 45) || CASE WHEN p_partkey % 45 < 10 THEN 'º' ELSE '' END AS device FROM part), "
    f"q AS (SELECT *, {_S['name']} AS name, {_S['art']} AS art, {_S['number']} AS number FROM p), "
    "f AS (SELECT *, (contains(name, 'nº 41') OR contains(name, '8.213') OR number = '40') AS found FROM q), "
    "g AS (SELECT *, CASE WHEN found THEN 0.6e0 ELSE 0e0 END + 0.15e0 + least(0.2e0, 0.05e0 * (contains(name, 'paridade')::INT + contains(name, 'conforme')::INT + contains(name, 'emenda')::INT + contains(name, 'constitucional')::INT)) "
    "+ CASE WHEN contains(name, 'nº 41') OR contains(name, 'nº 47') THEN 0.2e0 ELSE 0e0 END + CASE WHEN contains(name, '8.112') THEN 0.15e0 ELSE 0e0 END "
    "+ CASE WHEN contains(name, 'constituição') AND art = '40' THEN 0.15e0 ELSE 0e0 END - CASE WHEN contains(name, 'constituição') AND number IN ('1', '2', '3', '4', '5', '6') AND NOT found THEN 0.8e0 ELSE 0e0 END AS score FROM f) "
    "SELECT p_partkey, device, norm, found, contains(name, 'constituição') AND art IN ('1º', '3º', '4º', '5º', '6º') AS blocked, round(score, 3) AS score, round(score, 3) >= 0.3 AND NOT (contains(name, 'constituição') AND art IN ('1º', '3º', '4º', '5º', '6º')) AS accepted FROM g",
)
def statute_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Articles scored for a thesis whose brief names amendment 41 and law 8213, and whose context names article 40."""
    key, at = F.col("p_partkey"), F.col("p_partkey") % 45
    norm = F.get(F.array(*map(F.lit, _NORMS)), (key % len(_NORMS)).cast("int"))
    device = F.concat(F.lit("Art. "), at.cast("string"), F.when(at < 10, "º").otherwise(""))
    rows = read(spark, sf, "part").select("p_partkey", device.alias("device"), norm.alias("norm"))
    score, found, blocked = D.statute_score(F.col("device"), F.col("norm"), _THESIS, "art. 40 da carta", "ec 41 e lei 8213", DOMAIN, CENTRAL)
    return rows.withColumns({"found": found, "blocked": blocked, "score": score}).withColumn("accepted", (F.col("score") >= 0.30) & ~F.col("blocked"))


@query(
    "validity_rates",
    "WITH p AS (SELECT coalesce(toxic = 0, false) AS pass, 1 + n_chars % 5 AS o FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL) SELECT count(*) AS n, avg((NOT (pass AND o <= 2) AND NOT (NOT pass AND o >= 4))::INT) AS agreement, "
    "avg((pass AND o <= 2)::INT) AS false_positive, avg((NOT pass AND o >= 4)::INT) AS false_negative, round(coalesce(corr(pass::INT, (o - 1) / 4e0), 0), 6) AS r FROM p",
)
def validity_rates(spark: SparkSession, sf: str) -> DataFrame:
    marks = read(spark, sf, "documents").select("doc_id", (1 + F.col("n_chars") % 5).alias("overall"))
    checks = read(spark, sf, "labels").select("doc_id", (F.col("toxic") == 0).alias("passed"))
    return D.validity(marks.join(checks, "doc_id"), "passed", "overall").withColumn("r", F.round("r", 6))
