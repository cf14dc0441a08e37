"""The query of conclusions without support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.integrity import Integrity, unsupported
from quarrymill.plans.catalog import query, read

#: Conclusive expressions, what supports them, and what makes them fatal.
RULES = Integrity(
    conclusive="restou comprovado|ficou comprovado|restou demonstrado|ficou demonstrado|é incontroverso|consta dos autos|a documentação comprova|a prova documental demonstra|a prova produzida evidencia|verifica-se que|conclui-se que|é evidente que|não há dúvida de que|todos os requisitos foram preenchidos",
    support=r"\b\d{1,2}/\d{1,2}/\d{2,4}\b|R\$\s*\d+|\b\d{7}-\d{2}\.\d{4}\b"
    r"|\b(?:CNIS|PPP|LTCAT|DER|DIB|DIP|RMI|PBC|NB|CEI|CNPJ|CPF|CTPS|TRCT|GFIP|GPS|RAIS|eSocial|CAT)\b"
    r"|\b(?:laudo|contrato|holerite|extrato|certid[aã]o|carta de indeferimento|processo administrativo|senten[cç]a|ac[oó]rd[aã]o|prova testemunhal|per[ií]cia|protocolo|evento|ID\s*\d+|fls\.?\s*\d*|doc\.?\s*\d*|boletim de ocorr[eê]ncia|depoimento|testemunhas?)\b"
    r"|\b(?:prontu[aá]rio|relat[oó]rio m[eé]dico|atestado|exame|decis[aã]o administrativa|carta de concess[aã]o|nota fiscal|comprovante)\b",
    numbers=r"\b\d{3,}\b",
    law=r"(?:\bart\.?\s*|\bartigo\s*|\blei\s*(?:n[oº]?\.?\s*)?|\binciso\s*|\bpar[aá]grafo\s*)",
    fatal="procedência|improcedência|parcial procedência|condenação|absolvição|extinção|homologação|deferimento|indeferimento|prescrição|decadência|ilegitimidade|falta de interesse|coisa julgada|carência|qualidade de segurado|incapacidade|dano moral|dano material|responsabilidade civil|vínculo empregatício|horas extras|nulidade|prova ilícita|prisão preventiva|tutela de urgência",
    strongest="todos os requisitos foram preenchidos",
    decision=r"\b(?:defiro|indefiro|rejeito|acolho|homologo|extingo|determino bloqueio|determino penhora|revogo|mantenho|concedo|nego)\b",
    types=("SENTENCA", "DECISAO", "PETICAO_INICIAL", "RECURSO", "CONTESTACAO", "CUMPRIMENTO_DE_SENTENCA", "EMBARGOS", "EXCECAO_DE_PRE_EXECUTIVIDADE", "DESPACHO"),
    order="DESPACHO",
)
_KINDS = ["SENTENCA", "despacho", None, "PARECER", ""]
_PASSAGES = ["Restou comprovado o alegado. Conclui-se que sim.", "O laudo existe; é incontroverso.", "Conforme a lei n. 8213, verifica-se que nada.", "Em 10/10/2020 ficou demonstrado; indefiro.", "Todos os requisitos foram preenchidos.", "Há dano moral: é evidente que sim; nego.", "art. 123 e 456, consta dos autos"]


@query(
    "unsupported_conclusions",
    f"WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || {_PASSAGES}[(doc_id % {len(_PASSAGES)})::INT + 1] || chr(10) || coalesce(text, '') AS t, upper(coalesce([" + ", ".join("NULL" if k is None else f"'{k}'" for k in _KINDS) + f"][(doc_id // 7 % {len(_KINDS)})::INT + 1], '')) AS kind FROM documents), "
    f"k AS (SELECT *, string_split_regex(t, '(?i){RULES.conclusive}') AS parts, regexp_extract_all(t, '(?i){RULES.conclusive}') AS hits, regexp_matches(t, '{RULES.decision}', 'i') AS decides FROM d WHERE kind = '' OR kind IN {RULES.types}), "
    "e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM k), "
    "p AS (SELECT *, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::INT AS pos, hits[i] AS expression FROM e), "
    f"w AS (SELECT *, substr(t, greatest(pos - 800, 0) + 1, least(pos, 800)) AS back, substr(t, pos + 1, 250) AS ahead FROM p), "
    f"x AS (SELECT * FROM w WHERE NOT regexp_matches(back, '{RULES.support}', 'i') AND NOT regexp_matches(regexp_replace(back, '{RULES.law}{RULES.numbers}', ' ', 'gi'), '{RULES.numbers}')) "
    f"SELECT doc_id, pos AS \"at\", expression, CASE WHEN (pos > length(t) * 2 / 3e0 OR lower(expression) = '{RULES.strongest}' OR regexp_matches(back, '{RULES.fatal}', 'i') OR regexp_matches(ahead, '{RULES.fatal}', 'i')) AND (kind <> 'DESPACHO' OR decides) THEN 'FATAL' ELSE 'WARNING' END AS severity FROM x",
)
def unsupported_conclusions(spark: SparkSession, sf: str) -> DataFrame:
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    passage = F.get(F.array(*map(F.lit, _PASSAGES)), (i % len(_PASSAGES)).cast("int"))
    drafts = read(spark, sf, "documents").select("doc_id", F.concat(t, F.lit("\n"), passage, F.lit("\n"), t).alias("text"), F.get(F.array(*map(F.lit, _KINDS)), (F.floor(i / 7) % len(_KINDS)).cast("int")).alias("kind"))
    return unsupported(drafts, RULES)
