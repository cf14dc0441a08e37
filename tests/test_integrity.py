"""Conclusions without support against a loop with a real look-behind."""

import random

import regex

from quarrymill.operators.integrity import unsupported
from quarrymill.plans.integrity import RULES

FLAGS = regex.I | regex.V0
B = lambda p: p.replace(r"\b", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))").replace(r"\d", "[0-9]")
NUMBER = regex.compile(r"(?<!" + B(r"\bart\.?\s*|\bartigo\s*|\blei\s*(?:n[oº]?\.?\s*)?|\binciso\s*|\bpar[aá]grafo\s*") + ")" + B(r"\b\d{3,}\b"), FLAGS)


def loop(text, kind):
    kind = (kind or "").upper()
    if text is None or (kind and kind not in RULES.types):
        return []
    out = []
    for m in regex.finditer(RULES.conclusive, text, FLAGS):
        back, ahead = text[max(0, m.start() - 800) : m.start()], text[m.start() : m.start() + 250]
        if regex.search(B(RULES.support), back, FLAGS) or NUMBER.search(back):
            continue
        fatal = m.start() > len(text) * 2 / 3 or m[0].lower() == RULES.strongest or regex.search(RULES.fatal, back, FLAGS) or regex.search(RULES.fatal, ahead, FLAGS)
        if kind == "DESPACHO" and not regex.search(B(RULES.decision), text, FLAGS):
            fatal = False
        out.append((m.start(), m[0], "FATAL" if fatal else "WARNING"))
    return out


def test_windows_against_a_loop(spark):
    rng = random.Random(12)
    pieces = ["restou comprovado", "É incontroverso", "conclui-se que", "todos os requisitos foram preenchidos", "art. 123", "art.   4567", "lei nº 8213", "Lei 999", "inciso 100", "123", "12", "artigo 5 777", "laudo", "R$ 5", "10/10/2020", "dano moral", "defiro", "😀", "é", "x" * 60, "palavra " * 12, "/2020"]
    kinds = [None, "", "sentenca", "DESPACHO", "OUTRO"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 45))), rng.choice(kinds)) for i in range(400)] + [(900, None, None), (901, "", ""), (902, "restou comprovado", "SENTENCA")]
    got = {}
    for r in unsupported(spark.createDataFrame(rows, "doc_id int, text string, kind string"), RULES).collect():
        got.setdefault(r["doc_id"], []).append((r["at"], r["expression"], r["severity"]))
    for i, text, kind in rows:
        assert sorted(got.get(i, [])) == loop(text, kind), (text, kind)
    assert {s for f in got.values() for _, _, s in f} == {"FATAL", "WARNING"} and len(got) > 30
    assert unsupported(spark.createDataFrame(rows, "doc_id int, text string, kind string").limit(0), RULES).count() == 0
