"""Stance: what authorities and facts say about a claim, and how a draft uses decisions that speak against it.

A case may have any number of authorities. Each is looked at once, in its own row, and what it says becomes bits; a case's bits are
combined by an aggregate that does not depend on order, so a case that most rows belong to is combined in parts.
Citations of a case's precedents are found by automata of up to `AT_ONCE` names, so a draft is scanned once for each so many, not once for each name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import ascii_edges, found, found_in_any_case

#: Names of precedents that one automaton holds.
AT_ONCE = 1000
BEFORE, AFTER = 600, 400
ARTICLE_WINDOW = 250


class Premise(NamedTuple):
    """A premise that defeats a claim: where the claim matches, authorities that match `contrary` contradict it."""

    name: str
    claim: str
    contrary: str


class Marks(NamedTuple):
    distinguishing: str
    subsidiary: str
    favorable: str


def matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?iu)" + ascii_edges(pattern))


def starts(text: Column, pattern: str) -> Column:
    """Code points before each match of a pattern that matches no empty text: from the lengths of the matches and of what lies between them."""
    pattern = ascii_edges(pattern)
    lengths = lambda parts: F.transform(parts, lambda p: F.char_length(p))
    steps = F.arrays_zip(lengths(F.slice(F.split(text, pattern, -1), F.lit(1), F.regexp_count(text, F.lit(pattern)))).alias("gap"), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("hit"))
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(steps, first, lambda a, s: F.struct((a["end"] + s["gap"] + s["hit"]).alias("end"), F.array_append(a["at"], a["end"] + s["gap"]).alias("at")), lambda a: a["at"])


def around(text: Column, pattern: str, before: int, after: int) -> Column:
    """For each match the text from `before` code points ahead of its start to `after` behind it."""
    return F.transform(starts(text, pattern), lambda at: F.substring(text, F.greatest(at - before, F.lit(0)) + 1, F.least(at, F.lit(before)) + after))


def bits(text: Column, patterns: list[str]) -> Column:
    """A long with bit i set if pattern i is found in a text, a column that is lower-cased already."""
    return reduce(Column.bitwiseOR, [F.when(found(text, p.lower()), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(patterns)])


def analyze(claims: DataFrame, authorities: DataFrame, evidence: DataFrame, premises: list[Premise], marks: Marks, case: str = "case") -> DataFrame:
    """case, result, confidence, contradictions, premise, block, distinguishing, subsidiary of each claim.

    claims: a row a case (case, text). authorities and evidence: rows of (case, text), evidence with `pos`, any number, also of cases without a claim,
    which are left out. Null texts say nothing. A fact counts for the first premise that it matches only. A case is contradicted if two premises
    hold, or one against which nothing speaks; it is mixed if one holds and an authority is favourable. It is blocked if contradicted, unless claim or facts
    distinguish or the claim has a subsidiary request. `premise` is the first one found, by authorities before facts; null unless blocked.
    """
    contrary = [p.contrary for p in premises]
    claims, authorities, evidence = (x.withColumn("text", F.lower(F.coalesce("text", F.lit("")))) for x in (claims, authorities, evidence))
    t = F.col("text")
    has = lambda p: found_in_any_case(t, t, p)
    said = claims.select(case, bits(t, [p.claim for p in premises]).alias("claimed"), has(marks.distinguishing).alias("own"), has(marks.subsidiary).alias("subsidiary"))
    of_authorities = authorities.select(case, bits(t, contrary).alias("against"), has(marks.favorable).cast("int").alias("for"))
    per_case = of_authorities.groupBy(case).agg(F.bit_or("against").alias("against"), F.max("for").alias("for"))
    # No filter on what the patterns found: it would be pushed below them, and each pattern would run twice. Equal facts of a case are one.
    facts = evidence.select(case, "pos", bits(t, contrary).alias("fact"), has(marks.distinguishing).alias("differs"))
    facts = facts.groupBy(case, "fact").agg(F.min(F.struct("pos")).alias("at"), F.max("differs").alias("differs"))
    hit = F.coalesce(F.col("fact").bitwiseAND(F.col("claimed")), F.lit(0).cast("long"))
    weighed = said.join(facts, case, "left").withColumn("hit", hit).withColumn("hit", F.col("hit").bitwiseAND(-F.col("hit")))  # the lowest bit
    weighed = weighed.groupBy(case, "claimed", "own", "subsidiary").agg(F.bit_or("hit").alias("facts"), F.min(F.when(F.col("hit") > 0, F.struct("at.pos", "hit"))).alias("first"), F.max("differs").alias("differs"))
    both = weighed.join(per_case, case, "left")
    by_authority = F.coalesce(F.col("against").bitwiseAND(F.col("claimed")), F.lit(0).cast("long"))
    n = F.bit_count(by_authority.bitwiseOR(F.coalesce("facts", F.lit(0).cast("long"))))
    favorable, distinguishing = F.coalesce(F.col("for"), F.lit(0)) > 0, F.col("own") | F.coalesce("differs", F.lit(False))
    result = F.when(n == 0, F.when(favorable, "SUPPORTED").otherwise("UNKNOWN")).when(favorable & (n == 1), "MIXED").otherwise("CONTRADICTED")
    confidence = F.when(n == 0, F.when(favorable, 0.65).otherwise(0.30)).when(favorable & (n == 1), 0.60).when(n > 1, 0.92).otherwise(0.80)
    lead = F.when(by_authority > 0, by_authority.bitwiseAND(-by_authority)).otherwise(F.col("first.hit"))
    name = F.get(F.array(*[F.lit(p.name) for p in premises]), F.log2(lead).cast("int"))
    block = (result == "CONTRADICTED") & ~distinguishing & ~F.col("subsidiary")
    return both.select(case, result.alias("result"), confidence.alias("confidence"), n.alias("contradictions"), F.when(block, name).alias("premise"), block.alias("block"), distinguishing.alias("distinguishing"), "subsidiary")


def citations(drafts: DataFrame, precedents: DataFrame, case: str = "case") -> DataFrame:
    """draft, id, window for each precedent of the draft's case that it cites: the text from 600 code points ahead of the first citation to 400 behind its start.

    drafts: case, draft (an id), text; precedents: case, id, number, court. Cited is a precedent if its lower-cased number occurs in the lower-cased text, or, if not, its court,
    when that has three letters or more. Null or empty numbers are not searched; neither are null texts.
    """
    sized = precedents.groupBy(case).agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("chunks"))
    names = F.struct("id", F.lower("number").alias("number"), F.when(F.char_length("court") >= 3, F.lower("court")).alias("court"))
    chunked = precedents.join(sized, case).withColumn("chunk", F.pmod(F.xxhash64("id", "number"), F.col("chunks"))).groupBy(case, "chunk").agg(F.collect_list(names).alias("names"))
    id_kind, draft_kind = precedents.schema["id"].dataType.simpleString(), drafts.schema["draft"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automata: dict[tuple, object] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                draft, text, at, names_ = (batch.column(j)[i].as_py() for j in range(4))
                if at not in automata:
                    automata.clear()  # rows of one chunk mostly come together
                    machine = automata[at] = ahocorasick.Automaton()
                    for word in {w for n in names_ for w in (n["number"], n["court"]) if w}:
                        machine.add_word(word, word)
                    machine.make_automaton()
                low, first = text.lower(), {}
                for end, word in automata[at].iter(low) if len(automata[at]) else ():
                    first.setdefault(word, end - len(word) + 1)
                hits = [(n["id"], first.get(n["number"], first.get(n["court"]))) for n in names_ if n["number"]]
                hits = [(k, text[max(0, p - BEFORE) : p + AFTER]) for k, p in hits if p is not None]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([draft] * len(hits), batch.schema.field(0).type), pa.array([k for k, _ in hits], batch.schema.field(3).type.value_type.field("id").type), pa.array([w for _, w in hits])], ["draft", "id", "window"])

    pairs = drafts.where("text is not null").join(chunked, case)
    return pairs.select("draft", "text", F.xxhash64(case, "chunk").alias("at"), "names").mapInArrow(find, f"draft {draft_kind}, id {id_kind}, window string")


def misused(drafts: DataFrame, precedents: DataFrame, strong: str, rejection: str, case: str = "case") -> DataFrame:
    """draft, id, score of contrary precedents (stance CONTRARIO) that a draft cites: 2 if the window distinguishes, 1 if it rejects the request, 0: a violation."""
    cited = citations(drafts, precedents.where("stance = 'CONTRARIO'"), case)
    w = F.col("window")
    return cited.select("draft", "id", F.when(matches(w, strong), 2).when(matches(w, rejection), 1).otherwise(0).alias("score"))


def article_context(text: Column, article: str, distinction: list[str], direct: list[str]) -> Column:
    """DIRECT_FOUNDATION, DISTINCTION, AMBIGUOUS or NOT_PRESENT: how a text cites an article of the constitution, by markers within 250 code points of each citation.

    A citation counts for a side if it has markers of that side only; direct use wins over distinction.
    """
    pattern = rf"(?iu:art\.\s*{article}\s*(?:[ºo°]|\b)(?:[^a-zA-Z]|\s)*?(?:da\s+)?(?:cf|constitui[çc][ãa]o))"
    any_of = lambda w, marks: reduce(Column.__or__, [matches(w, m) for m in marks])
    sides = F.transform(around(F.coalesce(text, F.lit("")), pattern, ARTICLE_WINDOW, ARTICLE_WINDOW), lambda w: F.struct(any_of(w, direct).alias("direct"), any_of(w, distinction).alias("differs")))
    some = lambda test: F.exists(sides, test)
    return F.when(F.size(sides) == 0, "NOT_PRESENT").when(some(lambda s: s["direct"] & ~s["differs"]), "DIRECT_FOUNDATION").when(some(lambda s: s["differs"] & ~s["direct"]), "DISTINCTION").otherwise("AMBIGUOUS")
