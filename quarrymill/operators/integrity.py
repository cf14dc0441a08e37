"""Conclusions without support: each conclusive expression of a draft, with what stands in the 800 characters before it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import ascii_edges, found_in_any_case
from quarrymill.operators.stance import matches, starts

BACK, AHEAD = 800, 250


class Integrity(NamedTuple):
    """Patterns without regard to case. `numbers` support unless a `law` stands right before them."""

    conclusive: str
    support: str
    numbers: str
    law: str
    fatal: str
    strongest: str
    decision: str
    types: tuple[str, ...]
    order: str  # the type that is fatal only with a decision


def unsupported(drafts: DataFrame, rules: Integrity, key: str = "doc_id") -> DataFrame:
    """key, at (code points before it), expression, severity of each conclusive expression without concrete support.

    drafts: key, text, kind (null or empty: any). Kinds that the rules don't know have no findings; null texts neither. A finding is fatal in the last third of the text, for the strongest expression, or with a fatal term
    from 800 code points before it to 250 from its start; in an order only if that decides something. A number that a law's name precedes is taken out of the window first, whatever white space lies
    between, which no pattern can look back over.
    """
    pattern = "(?iu)" + rules.conclusive
    kind = F.upper(F.coalesce("kind", F.lit("")))
    known = drafts.where(F.col("text").isNotNull()).select(key, "text", kind.alias("kind")).where((F.col("kind") == "") | F.col("kind").isin(*rules.types))
    known = known.withColumn("n", F.char_length("text")).withColumn("low", F.lower("text")).withColumn("decides", found_in_any_case(F.col("text"), F.col("low"), rules.decision))
    has = found_in_any_case(F.col("text"), F.col("low"), rules.conclusive)
    each = known.select(key, "text", "kind", "n", "decides", F.explode(F.when(has, F.arrays_zip(starts(F.col("text"), pattern).alias("at"), F.regexp_extract_all("text", F.lit(ascii_edges(pattern)), F.lit(0)).alias("expression")))).alias("m"))
    at = F.col("m.at")
    each = each.select(key, "kind", "n", "decides", "m.at", "m.expression", F.substring("text", F.greatest(at - BACK, F.lit(0)) + 1, F.least(at, F.lit(BACK))).alias("back"), F.substring("text", at + 1, F.lit(AHEAD)).alias("ahead"))
    each = each.withColumn("plain", F.regexp_replace("back", "(?iu)" + ascii_edges(rf"{rules.law}{rules.numbers}"), " "))
    bare = each.where(~matches(F.col("back"), rules.support) & ~matches(F.col("plain"), rules.numbers))
    fatal = (F.col("at") > F.col("n") * 2 / 3) | (F.lower("expression") == rules.strongest) | matches(F.col("back"), rules.fatal) | matches(F.col("ahead"), rules.fatal)
    fatal = fatal & ((F.col("kind") != rules.order) | F.col("decides"))
    return bare.select(key, "at", "expression", F.when(fatal, "FATAL").otherwise("WARNING").alias("severity"))
