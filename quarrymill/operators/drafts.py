"""Audits of drafts: guards, parts, windows around matches, rule packs, requests against outcomes, scores.

Rule packs are data (`Pair`, `Form`); every audit is one pass of built-in expressions over the row of its draft, without an exchange.
Null texts are empty, and empty or short ones are skipped by the audits that have a guard.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import ascii_edges, fold, found as has_any, found_in_any_case

_GAP = "\x01"  # no pattern crosses it


def offset(text: Column, pattern: str) -> Column:
    """Code points before the first match, null without one."""
    parts = F.split(text, ascii_edges(pattern), 2)
    return F.when(F.size(parts) == 2, F.char_length(F.get(parts, F.lit(0))))


def span(text: Column, start: Column, length: int | None = None) -> Column:
    """`length` code points (or all) after the first `start`."""
    return F.substring(text, start + 1, F.lit(2**31 - 1 if length is None else length))


def windows(text: Column, pattern: str, before: int, after: int) -> Column:
    """For each match, also overlapping ones, the text from `before` code points ahead of its start to `after` behind it.

    The pattern must have no capturing group. One scan: the windows are looked ahead to from `before` places in front, never from
    within a surrogate pair.
    """
    padded = F.concat(F.lit("\n" * before), text)
    return F.regexp_extract_all(padded, F.lit(rf"(?s)(?!\p{{Cs}})(?=.{{{before}}}(?:{ascii_edges(pattern)}))(?=(.{{1,{before + after}}}))"), F.lit(1))


def _matches(text: Column, patterns: list[str]) -> Column:
    return sum((has_any(text, p).cast("int") for p in patterns), F.lit(0))


def skipped(text: Column, blanks: str, cited: list[str], piece: list[str], least: int = 800) -> Column:
    """Whether a draft is too short without its bracketed blanks, has marks of a form, or looks like pasted decisions only."""
    useful = F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]{3,}\]", ""), r"\s+", " "))
    lower = F.lower(text)
    return (F.char_length(useful) < least) | text.rlike(ascii_edges(blanks)) | ((_matches(lower, cited) >= 4) & (_matches(lower, piece) <= 1))


def parts(drafts: DataFrame, text: str, outcome: str, reasoning: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, whole, reasoning, outcome: the folded text cut at the outcome's first mark, else at 80 % of its length.

    With a mark of the reasoning, the reasoning starts there; without that mark ahead of the outcome's, the cut is at 80 % too.
    """
    base = drafts.select(key, fold(F.coalesce(F.col(text), F.lit(""))).alias("whole"))
    base = base.select(key, "whole", offset(F.col("whole"), outcome).alias("o"), (offset(F.col("whole"), reasoning) if reasoning else F.lit(0)).alias("r"))
    ordered = F.coalesce((F.col("o") > F.col("r")) if reasoning else F.col("o").isNotNull(), F.lit(False))
    at = F.when(ordered, F.col("o")).otherwise(F.floor(F.char_length("whole") * 8 / 10).cast("int"))
    base = base.select(key, "whole", F.when(ordered, F.col("r")).otherwise(0).alias("start"), at.alias("at"))
    return base.select(key, "whole", F.substring("whole", F.col("start") + 1, F.col("at") - F.col("start")).alias("reasoning"), span(F.col("whole"), F.col("at")).alias("outcome"))


class Pair(NamedTuple):
    """Fires if `reason` is in the reasoning, `veto` is not, and `outcome` is in the outcome."""

    code: str
    reason: str
    outcome: str
    veto: str | None = None


def pair_findings(split: DataFrame, rules: list[Pair], key: str = "doc_id") -> DataFrame:
    """key, code of each rule that fires."""
    reason, outcome = F.col("reasoning"), F.col("outcome")

    def fires(r: Pair) -> Column:
        test = has_any(reason, r.reason) & has_any(outcome, r.outcome)
        return test & ~has_any(reason, r.veto) if r.veto else test

    return split.select(key, F.explode(F.array_compact(F.array(*[F.when(fires(r), r.code) for r in rules]))).alias("code"))


class Form(NamedTuple):
    """What a type of draft must (or must not) have."""

    type: str
    name: str
    pattern: str
    required: bool
    fatal: bool


def form_findings(drafts: DataFrame, text: str, kind: str, forms: list[Form], key: str = "doc_id") -> DataFrame:
    """key, kind, name, fatal of each demand of its type that a draft doesn't meet; unknown types have none."""
    def hit(f: Form) -> Column:
        has = found_in_any_case(F.col(text), F.col("_lower"), f.pattern)
        return F.when((F.col(kind) == f.type) & (~has if f.required else has), F.struct(F.lit(f.name).alias("name"), F.lit(f.fatal).alias("fatal")))

    drafts = drafts.withColumn("_lower", F.lower(text))
    return drafts.select(key, F.col(kind).alias("kind"), F.explode(F.array_compact(F.array(*map(hit, forms)))).alias("h")).select(key, "kind", "h.name", "h.fatal")


def _topics(text: Column, topics: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(has_any(text, p), name) for name, p in topics.items()]))


class Requests(NamedTuple):
    """Patterns by which requests and what an outcome does with them are known."""

    topics: dict[str, str]
    section: str
    verbs: str
    actions: str
    blanket: str
    fallback: str
    injunction: str
    injunction_met: str
    triggers: list[tuple[str, str, str]]  # pattern, what must follow within 500 code points, its name


def request_findings(split: DataFrame, r: Requests, key: str = "doc_id") -> DataFrame:
    """key, code, detail: requests that an outcome passes over, relief that nobody asked for, relief without its terms.

    Requested are topics of the requests' section, or, without one, those within 400 code points from a verb of asking;
    granted those from 20 ahead of a verb of granting to 200 behind it. Details follow the order of the topics.
    """
    pre, out = F.col("reasoning"), F.col("outcome")
    asked = offset(pre, r.section)
    scope = F.when(asked.isNotNull(), span(pre, asked)).otherwise(F.array_join(windows(pre, r.verbs, 0, 400), _GAP))
    base = split.select(key, "reasoning", "outcome", scope.alias("scope"), F.array_join(windows(out, r.actions, 20, 200), _GAP).alias("acts"), offset(pre, r.fallback).alias("sub"))
    blanket, acts = has_any(out, r.blanket), has_any(out, r.actions)
    base = base.select(
        key, "reasoning", "outcome", blanket.alias("blanket"), acts.alias("active"), _topics(F.col("scope"), r.topics).alias("asked"), _topics(F.col("acts"), r.topics).alias("granted"),
        _topics(out, r.topics).alias("met"), F.coalesce(_topics(span(pre, F.col("sub"), 500), r.topics), F.array().cast("array<string>")).alias("second"),
    )

    def missing(trigger: str, needs: str, name: str) -> Column:
        after = span(out, offset(out, trigger), 500)
        return F.when(~after.rlike(ascii_edges(needs)), name)

    none = F.array().cast("array<string>")
    some = lambda test, a: F.when(test, a).otherwise(none)
    injunction = has_any(pre, r.injunction) & ~has_any(out, r.injunction_met)
    found = {
        "UNADDRESSED_MAIN_REQUEST": some(~F.col("blanket") & F.col("active"), F.array_except("asked", "met")),
        "UNADDRESSED_SUBSIDIARY_REQUEST": some(~F.col("blanket"), F.array_except("second", "met")),
        "UNADDRESSED_INJUNCTION_REQUEST": some(injunction, F.array(F.lit("injunction"))),
        "RELIEF_NOT_REQUESTED": some(F.size("asked") > 0, F.array_except("granted", "asked")),
        "INCOMPLETE_RELIEF": F.array_compact(F.array(*[missing(*t) for t in r.triggers])),
    }
    rows = F.filter(F.array(*[F.struct(F.lit(c).alias("code"), F.array_join(a, "; ").alias("detail")) for c, a in found.items()]), lambda x: x["detail"] != "")
    return base.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def genericity(text: Column, lower: Column, facts: Column, requests: Column, quality: Column, phrases: list[str], bare: str, context: str, blanks: str) -> Column:
    """Points for generic phrases, missing facts and requests, weak extraction and blanks (five at most); no facts cost five.

    `lower` is the text in lower case, a column like `text`.
    """
    has = lambda p: found_in_any_case(text, lower, p)
    score = sum((has(p).cast("int") for p in phrases), F.lit(0)) + (has(bare) & ~has(context)).cast("int")
    score = score + F.when(facts == 0, 5).when(facts < 2, 2).otherwise(0) + F.when(requests < 1, 2).otherwise(0)
    score = score + F.when(quality == "INSUFICIENTE", 3).when(quality == "PARCIAL", 1).otherwise(0)
    return score + F.least(F.size(F.regexp_extract_all(text, F.lit("(?iu)" + blanks), F.lit(0))), F.lit(5))


def enough_words(text: Column, least: int = 25) -> Column:
    """Whether a text without its addresses has `least` words of four characters or more, each with a letter."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+", ""), r"\s+", " ")), " ")
    return F.size(F.filter(words, lambda w: (F.char_length(w) > 3) & w.rlike("[a-zA-ZÀ-ÿ]"))) >= least


def statute_score(device: Column, norm: Column, thesis: str, context: str, brief: str, terms: list[str], central: list[tuple[tuple[str, ...], float]], constitution: str = "constituição") -> tuple[Column, Column, Column]:
    """(score, found, blocked) of a statute's article for a thesis: named in the brief, of the domain, words in common, central norms; general articles lose.

    Blocked are general articles of the constitution: 1, 3, 4 and 6 always, 5 whole.
    """
    name, at = F.lower(norm), F.lower(F.trim(F.regexp_replace(F.trim(device), r"(?i)^art\.?\s*", "")))
    thesis, context, brief = thesis.lower(), context.lower(), brief.lower()
    number = F.regexp_replace(at, "[º°o]", "")
    said = lambda c: F.contains(F.lit(brief), c)
    amendment = F.regexp_extract(name, r"(?:emenda constitucional|ec)[^0-9]*([0-9]+)", 1)
    law = F.regexp_extract(name, r"lei[^0-9]*([0-9.]+)", 1)
    found = ((amendment != "") & (said(F.concat(F.lit("ec "), amendment)) | (F.lit("emenda constitucional" in brief) & said(amendment)))) | ((law != "") & said(F.replace(law, F.lit("."), F.lit(""))))
    found = found | (F.lit("art. 40" in context) & (number == "40"))
    domain = F.lit(any(t in thesis for t in terms)) | _matches(name, terms).cast("boolean")
    whole = F.concat_ws(" ", at, name)
    hits = sum((whole.contains(w).cast("int") for w in thesis.split(" ") if len(w) > 5), F.lit(0))
    score = F.when(found, 0.60).otherwise(0e0) + F.when(domain, 0.15).otherwise(0e0) + F.least(hits * F.lit(0.05), F.lit(0.20))
    for names, points in central:
        score = score + F.when(F.lit(False) | sum((name.contains(n).cast("int") for n in names), F.lit(0)).cast("boolean"), points).otherwise(0e0)
    general = name.contains(constitution)
    score = score + F.when(general & at.isin("40", "40-a"), 0.15).otherwise(0e0) - F.when(general & number.isin("1", "2", "3", "4", "5", "6") & ~found, 0.80).otherwise(0e0)
    blocked = general & (at.rlike("^[1346][º°o]$") | at.rlike("^5[º°o]$"))
    return F.round(score, 3), found, blocked


def urn_court(urn: Column, courts: dict[str, str]) -> Column:
    """The court of an identifier `urn:lex:br:authority;...`: by table, else the authority's last part in capitals; empty without an authority."""
    authority = F.regexp_extract(urn, "urn:lex:br:([^;]+)", 1)
    known = F.create_map(*[F.lit(x) for kv in courts.items() for x in kv])
    return F.coalesce(F.try_element_at(known, authority), F.upper(F.element_at(F.split(authority, r"\."), -1)))


def validity(pairs: DataFrame, passed: str, overall: str) -> DataFrame:
    """n, agreement, false_positive, false_negative, r: of checks that passed against overall marks of 1 to 5. No rows, or no variance: r is 0."""
    p, o = F.coalesce(F.col(passed), F.lit(False)), F.col(overall)
    fp, fn = p & (o <= 2), ~p & (o >= 4)
    rows = pairs.where(o.isNotNull()).select(p.cast("double").alias("x"), ((o - 1) / 4).alias("y"), fp.alias("fp"), fn.alias("fn"))
    sums = rows.agg(F.count("*").alias("n"), F.count_if("fp").alias("fp"), F.count_if("fn").alias("fn"), *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy")], F.sum("x").alias("x"), F.sum("y").alias("y"))
    n = F.col("n")
    cov, vx, vy = (n * F.col(a + b) - F.col(a) * F.col(b) for a, b in ("xy", "xx", "yy"))
    share = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0e0))
    r = F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy).otherwise(1e0))).otherwise(0e0)
    return sums.select("n", share(n - F.col("fp") - F.col("fn")).alias("agreement"), share(F.col("fp")).alias("false_positive"), share(F.col("fn")).alias("false_negative"), F.coalesce(r, F.lit(0e0)).alias("r"))
