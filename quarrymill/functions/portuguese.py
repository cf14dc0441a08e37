"""Portuguese words for search: stop words and the published Snowball stemmer.

Stemming runs once for each new word of a task; texts are split and lower-cased by Spark's own functions.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The function words of the published stop list.
_FUNCTION_WORDS = """
de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você
essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela
aqueles aquelas isto aquilo
""".split()
#: Forms of estar, haver, ser and ter that no rule gives.
_FORMS = """
estou está estamos estão estava estávamos estavam esteja estejamos estejam esteve hei há havemos hão haja hajamos hajam sou somos são era éramos eram fui foi fomos foram fora fôramos seja sejamos sejam fosse fôssemos
fossem for formos forem tenho tem temos tém tinha tínhamos tinham tenha tenhamos tenham teve
""".split()
_PAST = "e emos eram era éramos esse éssemos essem er ermos erem".split()
_FUTURE = "ei á emos ão ia íamos iam".split()
STOP_WORDS = frozenset([*_FUNCTION_WORDS, *_FORMS, *(s + e for s in ("estiv", "houv", "tiv") for e in _PAST), *(s + e for s in ("houver", "ser", "ter") for e in _FUTURE)])

_VOWELS = "aeiouáéíóúâêô"
#: Suffixes of step 1 by what becomes of them, and of step 2.
_DELETE_R2 = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
_VERBS = """
ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o
ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis
ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras
""".split()
_STEP1 = {s: "r2" for s in _DELETE_R2} | {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente", "amente": "amente", "mente": "mente", "idade": "idade", "idades": "idade"}
_STEP1 |= {s: "iva" for s in ("iva", "ivo", "ivas", "ivos")} | {s: "ira" for s in ("ira", "iras")}
_LONGEST_FIRST = sorted(_STEP1, key=len, reverse=True)
_VERBS_LONGEST_FIRST = sorted(_VERBS, key=len, reverse=True)


def _after(word: str, start: int, vowel_first: bool) -> int:
    """The place after the first vowel (or other letter) from start on."""
    at = start
    while at < len(word) and (word[at] in _VOWELS) != vowel_first:
        at += 1
    return min(at + 1, len(word))


def _regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    n = len(w)
    if n < 3:
        rv = n
    elif w[1] not in _VOWELS:
        rv = _after(w, 2, True)
    elif w[0] in _VOWELS:
        rv = _after(w, 2, False)
    else:
        rv = 3
    r1 = _after(w, _after(w, 0, True), False) if n else 0
    r2 = _after(w, _after(w, r1, True), False)
    return rv, r1, r2


def _ends(w: str, endings: tuple[str, ...], region: int) -> str | None:
    """w without the longest of these endings, if that lies in the region."""
    for e in sorted(endings, key=len, reverse=True):
        if w.endswith(e):
            return w[: -len(e)] if len(w) - len(e) >= region else None
    return None


def _suffix(w: str, r1: int, r2: int, rv: int) -> str | None:
    """Step 1; None if it changes nothing."""
    end = next((s for s in _LONGEST_FIRST if w.endswith(s)), None)
    if end is None:
        return None
    kind, at = _STEP1[end], len(w) - len(end)
    stem = w[:at]
    if kind == "ira":
        return stem + "ir" if at >= rv and stem.endswith("e") else None
    if kind == "amente":
        if at < r1:
            return None
        if (less := _ends(stem, ("iv",), r2)) is not None:
            return _ends(less, ("at",), r2) or less
        return _ends(stem, ("os", "ic", "ad"), r2) or stem
    if at < r2:
        return None
    if kind in ("log", "u", "ente"):
        return stem + kind
    before = {"mente": ("ante", "avel", "ível"), "idade": ("abil", "ic", "iv"), "iva": ("at",)}.get(kind)
    return (_ends(stem, before, r2) or stem) if before else stem


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv, r1, r2 = _regions(w)
    out = _suffix(w, r1, r2, rv)
    if out is None:
        end = next((s for s in _VERBS_LONGEST_FIRST if w.endswith(s) and len(w) - len(s) >= rv), None)
        out = w[: -len(end)] if end else None
    if out is not None:
        if out.endswith("ci") and len(out) > rv:
            out = out[:-1]
    else:
        out = w
        if (less := _ends(w, ("os", "a", "i", "o", "á", "í", "ó"), rv)) is not None:
            out = less
    if out and out[-1] in "eéê" and len(out) > rv:
        out = out[:-1]
        if out.endswith(("gu", "ci")) and len(out) > rv:
            out = out[:-1]
    elif out.endswith("ç"):
        out = out[:-1] + "c"
    return out.replace("a~", "ã").replace("o~", "õ")


#: Letters and digits of any script; points and apostrophes only between them.
WORD = r"[\p{L}\p{M}\p{N}_]+(?:[.'’][\p{L}\p{M}\p{N}_]+)*"


def words(text: Column) -> Column:
    """Lower-case words without stop words, in order; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*sorted(STOP_WORDS)))


def query_words(query: str) -> list[str]:
    """What `words` and `stem` make of a query."""
    found = re.findall(r"\w+(?:[.'’]\w+)*", query.lower())
    return [stem(w) for w in found if w not in STOP_WORDS]
