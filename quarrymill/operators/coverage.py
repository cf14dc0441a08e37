"""Coverage of essential topics, as a table of rules: a gate by domain, a trigger, blocks that a draft should have, and how many may be missing.

A rule more is a row more. A draft is folded once, and its row holds the findings of all rules: no exchange. Patterns are over folded text.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import fold, found
from quarrymill.operators.drafts import skipped


class Gate(NamedTuple):
    """When a domain's rules apply: by regime, by justice, by the subject, or by the draft's beginning (for some justices only, if given)."""

    regimes: tuple[str, ...] = ()
    justices: tuple[str, ...] = ()
    subject: str | None = None
    head: str | None = None
    head_chars: int = 3000
    head_justices: tuple[str, ...] = ()


class Topic(NamedTuple):
    domain: str
    topic: str
    trigger: str
    blocks: dict[str, str]
    least_missing: int = 1


def placeholder_share(text: Column) -> Column:
    """The share of lines with a placeholder in brackets."""
    lines = F.split(text, "\n")
    marked = F.filter(lines, lambda x: x.rlike(r"(?iu)\[[A-ZÁÀÂÃÉÊÍÓÔÕÚÇa-záàâãéêíóôõúç0-9\s.,;:!?/_-]{3,}\]"))
    return F.size(marked) / F.size(lines)


def _open(gate: Gate) -> Column:
    tests = []
    if gate.regimes:
        tests.append(F.col("regime").isin(*gate.regimes))
    if gate.justices:
        tests.append(F.col("justice").isin(*gate.justices))
    if gate.subject:
        tests.append(found(F.col("_subject"), gate.subject))
    if gate.head:
        head = found(F.col(f"_head{gate.head_chars}"), gate.head)
        tests.append(head & F.col("justice").isin(*gate.head_justices) if gate.head_justices else head)
    return F.coalesce(reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))


def missing_topics(drafts: DataFrame, gates: dict[str, Gate], topics: list[Topic], blanks: str, cited: list[str], piece: list[str], key: str = "doc_id") -> DataFrame:
    """key, domain, topic, missing (names of blocks, in order) of each topic that a draft treats and does not cover.

    drafts: key, text, regime, justice, subject; any may be null. Drafts that the guard skips (short, forms, over 15 % lines with placeholders, pasted decisions) have no findings.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    heads = {g.head_chars for g in gates.values() if g.head}
    kept = drafts.where(~(skipped(t, blanks, cited, piece) | (placeholder_share(t) > 0.15)))
    folded = kept.select(key, "regime", "justice", fold(F.coalesce("subject", F.lit(""))).alias("_subject"), fold(t).alias("_text"), *[fold(F.substring(t, 1, n)).alias(f"_head{n}") for n in sorted(heads)])
    opened = folded.withColumns({f"_open_{d}": _open(g) for d, g in gates.items()})

    def finding(rule: Topic) -> Column:
        lacking = F.array_compact(F.array(*[F.when(~found(F.col("_text"), p), F.lit(name)) for name, p in rule.blocks.items()]))
        hit = F.col(f"_open_{rule.domain}") & found(F.col("_text"), rule.trigger) & (F.size(lacking) >= rule.least_missing)
        return F.when(hit, F.struct(F.lit(rule.domain).alias("domain"), F.lit(rule.topic).alias("topic"), lacking.alias("missing")))

    return opened.select(key, F.explode(F.array_compact(F.array(*[finding(r) for r in topics]))).alias("f")).select(key, "f.*")


class Profile(NamedTuple):
    """A profile that a subject selects; with `also`, only if that is found too."""

    name: str
    pattern: str
    also: str | None = None


def select_profile(area: Column, regime: Column, subject: Column, known: list[str], by_regime: dict[str, str], profiles: list[Profile], default: str) -> Column:
    """The profile that scores a draft: a known area, else by regime, else the first whose pattern the subject has, without regard to case."""
    has = lambda p: subject.rlike("(?iu)" + p)
    out = F.when(area.isin(*known), area)
    for name, profile in by_regime.items():
        out = out.when(regime == name, profile)
    for p in profiles:
        out = out.when(has(p.pattern) & has(p.also) if p.also else has(p.pattern), p.name)
    return out.otherwise(F.lit(default))
