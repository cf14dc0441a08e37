"""Calibration of findings by feedback, summaries of regression cases and reviews, and guards of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import tokens
from quarrymill.operators.tables import word_hits
from quarrymill.sources.shared import write_once


def by_type(feedback: DataFrame, *more: str) -> DataFrame:
    return feedback.groupBy("type", *more).agg(F.sum("useful").alias("useful"), F.count("*").alias("total"))


def share(useful: Column, total: Column) -> Column:
    """Percentage with one decimal; null without feedback."""
    return F.round(100e0 * useful / F.nullif(total, F.lit(0)), 1)


def confidence_bands(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """band, n and usefulness: feedback on a type counts once for each finding of it in the band; 0 without any."""
    c = F.col("confidence")
    band = F.when(c < 0.8, "0.75-0.79").when(c < 0.9, "0.80-0.89").otherwise("0.90-1.00").alias("band")
    counts = findings.where((c >= 0.75) & (c < 1.01)).groupBy(band, "type").agg(F.count("*").alias("n"))
    out = counts.join(by_type(feedback), "type", "left").groupBy("band").agg(F.sum("n").alias("findings"), share(F.sum(F.col("n") * F.col("useful")), F.sum(F.col("n") * F.col("total"))).alias("u"))
    return out.select("band", F.col("findings").alias("n"), F.coalesce("u", F.lit(0e0)).alias("usefulness"))


def domain_calibration(findings: DataFrame, feedback: DataFrame, none: str = "desconhecido", top: int = 5) -> DataFrame:
    """The most frequent types of each domain, with the usefulness that the domain gives them."""
    domain = F.coalesce("domain", F.lit(none)).alias("domain")
    f = findings.select(domain, "execution", "type")
    whole = f.groupBy("domain").agg(F.count_distinct("execution").alias("executions"), F.round(F.count("*") / F.count_distinct("execution"), 2).alias("mean_findings"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "type"))
    types = f.groupBy("domain", "type").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= top)
    said = by_type(feedback.select(domain, "type", "useful"), "domain").select("domain", "type", share(F.col("useful"), F.col("total")).alias("u"))
    return types.join(whole, "domain").join(said, ["domain", "type"], "left").select("domain", "executions", "mean_findings", "type", "n", "place", F.coalesce("u", F.lit(0e0)).alias("usefulness"))


def provider_comparison(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Executions, findings and milliseconds of each provider; usefulness is that of the types it reports, null without feedback."""
    runs = findings.groupBy("provider", "execution").agg(F.count("*").alias("n"), F.first("ms").alias("ms")).groupBy("provider").agg(F.count("*").alias("executions"), F.round(F.sum("n") / F.count("*"), 2).alias("mean_findings"), F.round(F.avg("ms")).cast("long").alias("mean_ms"))
    said = findings.select("provider", "type").distinct().join(by_type(feedback), "type").groupBy("provider").agg(share(F.sum("useful"), F.sum("total")).alias("usefulness"))
    return runs.join(said, "provider", "left")


def best_examples(findings: DataFrame, feedback: DataFrame, order: list[str], each: int = 3, size: int = 20) -> DataFrame:
    """The first examples of each type, types with most useful feedback first."""
    place = F.row_number().over(Window.partitionBy("type").orderBy(*order))
    first = findings.withColumn("place", place).where(F.col("place") <= each)
    return first.join(by_type(feedback).select("type", "useful"), "type", "left").withColumn("useful", F.coalesce("useful", F.lit(0)).cast("long")).orderBy(F.desc("useful"), "type", "place").limit(size)


def recommendations(findings: DataFrame, feedback: DataFrame, generic: float = 0.8) -> DataFrame:
    """severity, reason, type: little use, types that most executions have, and types without feedback."""
    executions = findings.agg(F.count_distinct("execution").alias("executions"))  # one row
    n = findings.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("execution").alias("e")).join(F.broadcast(executions)).select("type", "n", F.round(F.col("e") / F.col("executions"), 3).alias("g"))
    q = n.join(by_type(feedback), "type", "left").withColumn("u", F.coalesce(100e0 * F.col("useful") / F.col("total"), F.lit(0e0)))
    high, low = (F.col("u") < 30) & (F.col("n") >= 5), (F.col("u") < 50) & (F.col("n") >= 3)
    said = [F.when(high | low, F.struct(F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"), F.lit("usefulness").alias("reason"))), F.when(F.col("g") > generic, F.struct(F.lit("MEDIUM").alias("severity"), F.lit("generic").alias("reason"))), F.when(F.col("total").isNull(), F.struct(F.lit("LOW").alias("severity"), F.lit("no feedback").alias("reason")))]
    return q.select("type", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("x")).select("x.severity", "x.reason", "type")


def _sliced(df: DataFrame, dims: list[str], *aggregates: Column) -> DataFrame:
    """The aggregates over all rows (dim ALL) and by each of the dimensions."""
    pairs = F.explode(F.array(F.struct(F.lit("ALL").alias("dim"), F.lit("ALL").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")
    return df.select("*", pairs).groupBy(F.col("x.dim").alias("dim"), F.col("x.value").alias("value")).agg(*aggregates)


def regression_summary(cases: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6).alias(f"{c}_rate")
    return _sliced(cases, ["domain", "quality"], F.count("*").alias("total"), F.sum("pass").alias("passed"), (F.count("*") - F.sum("pass")).alias("failed"), mean("pass"), mean("score_pass"), mean("finding_pass"))


def provider_ranking(cases: DataFrame, failed: list[str]) -> DataFrame:
    """Providers by 0.40 F1 + 0.25 precision + 0.20 recall + 0.10 cases passed + 0.05 scores passed; failed ones are left out.

    Precision without findings is 1 if none was expected, else 0; recall without expected ones is 1.
    """
    e, a = F.col("expected"), F.col("actual")
    s = cases.where(~F.col("provider").isin(failed)).groupBy("provider").agg(F.count_if((e == 1) & (a == 1)).alias("tp"), F.count_if((e == 0) & (a == 1)).alias("fp"), F.count_if((e == 1) & (a == 0)).alias("fn"), F.avg("pass").alias("cp"), F.avg("score_pass").alias("sp"))
    none = F.when(F.col("tp") + F.col("fn") == 0, 1e0).otherwise(0e0)
    s = s.withColumns({"p": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), none), "r": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1e0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0e0))
    out = s.select("provider", "fp", "fn", F.round(0.40 * f1 + 0.25 * F.col("p") + 0.20 * F.col("r") + 0.10 * F.col("cp") + 0.05 * F.col("sp"), 6).alias("composite"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc("composite"))))  # a row for each provider


def review_slices(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Rates of what reviewers said, the mean score (1 to 5), and 0.4 correct + 0.3 relevant + 0.2 actionable + 0.1 (mean - 1) / 4."""
    out = _sliced(rows, dims, F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("correct", "relevant", "actionable", "score")])
    quality = 0.4 * F.col("correct") + 0.3 * F.col("relevant") + 0.2 * F.col("actionable") + 0.1 * (F.col("score") - 1) / 4
    names = {"correct": "correct_rate", "relevant": "relevance_rate", "actionable": "actionability_rate", "score": "mean_score"}
    return out.select("dim", "value", "n", *[F.round(c, 6).alias(n) for c, n in names.items()], F.round(quality, 6).alias("validated_quality"))


def days_asked(text: str, default: int = 30, most: int = 90) -> int:
    """What a request for days means: `most` at most, `default` if it is no number, or 0."""
    try:
        return min(most, int(text)) or default
    except ValueError:
        return default


def counted_in_windows(df: DataFrame, at: str, now: DataFrame, asked: list[str]) -> DataFrame:
    """asked, days, n: rows of the last days before `now` (one row), in one pass for all requests."""
    days = {a: days_asked(a) for a in asked}
    counts = df.join(F.broadcast(now)).agg(*[F.count_if(F.col(at) >= F.col("now") - F.make_dt_interval(F.lit(n))).alias(f"n_{i}") for i, n in enumerate(days.values())])
    rows = [F.struct(F.lit(a).alias("asked"), F.lit(n).alias("days"), F.col(f"n_{i}").alias("n")) for i, (a, n) in enumerate(days.items())]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def top_codes(df: DataFrame, kinds: dict[str, Column], size: int) -> DataFrame:
    """kind, code, n, place: the most frequent codes of each kind; null is no code."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("code")) for k, c in kinds.items()])).alias("x")
    counts = df.select(pairs).select("x.*").where("code is not null").groupBy("kind", "code").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "code"))).where(F.col("place") <= size)


def rule_metrics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """rule, tp, fp, fn of the rules (k, rule) of cases."""
    both = expected.distinct().withColumn("e", F.lit(True)).join(actual.distinct().withColumn("a", F.lit(True)), ["k", "rule"], "full")
    return both.groupBy("rule").agg(F.count_if(F.col("e") & F.col("a")).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))


def before_and_after(df: DataFrame, key: str, x: Column) -> DataFrame:
    """The least and the largest x (a struct with score and fatal) of each key that has two rows or more."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.min(x).alias("b"), F.max(x).alias("a")).where("n > 1")
    better = (F.col("a.score") > F.col("b.score")) | (F.col("a.fatal") < F.col("b.fatal"))
    worse = (F.col("a.score") < F.col("b.score")) | (F.col("a.fatal") > F.col("b.fatal"))
    columns = [F.col(f"{s}.{c}").alias(f"{c}_{n}") for c in ("score", "fatal") for s, n in (("b", "before"), ("a", "after"))]
    return out.select(key, *columns, F.round(F.col("a.score") - F.col("b.score"), 6).alias("delta"), better.alias("improved"), worse.alias("regressed"))


def runs_to_do(cases: DataFrame, providers: list[int], done: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode(F.array(*map(F.lit, providers))).alias("provider")).join(done, ["case_id", "provider"], "left_anti")


def multiset_overlap(expected: DataFrame, texts: DataFrame, key: list[str], text: str = "text", part: float = 0.3) -> DataFrame:
    """item_id, key, hits: texts whose words, repeats counted, hit ceil(part) of an item's distinct words."""
    items = expected.select("item_id", F.array_distinct(tokens(F.col("text"), 3)).alias("words"))
    items = items.withColumn("need", F.greatest(F.lit(1), F.ceil(F.size("words") * part)))
    return word_hits(items, texts.select(*key, text), key, tokens(F.col(text), 3))


def lookup(key: Column, names: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key), F.lit(default))


def first_of(rules: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(*rules[0])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise(default)


def missing(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """field, missing, pct_filled, in one pass."""
    counts = df.agg(F.count("*").alias("all"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    rows = [F.struct(F.lit(n).alias("field"), F.col(n).alias("missing"), F.round((1 - F.col(n) / F.nullif("all", F.lit(0))) * 100, 6).alias("pct_filled")) for n in tests]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def history(df: DataFrame, isin: dict[str, list], where: Column, order: list[Column], size: int) -> DataFrame:
    """Rows that meet all criteria, newest first; an empty list of values is no criterion."""
    for name, values in isin.items():
        df = df.where(F.col(name).isin(values)) if values else df
    return df.where(where).orderBy(*order).limit(size)


def confidence(mode: Column, classified: Column, facts: Column, claims: Column, theses: Column, extraction: Column, audit: Column, generic: Column, fatal: Column) -> Column:
    """The confidence of a document: fixed for skeletons (0.20) and templates (0.50), else weighted, with two decimals, capped at
    0.49 with fatal findings and at 0.69 from three generic phrases on."""
    one = lambda c: F.least(c, F.lit(1e0))
    quality = F.when(extraction == "SUFICIENTE", 1e0).when(extraction == "PARCIAL", 0.5).otherwise(0.2)
    matrix = F.when(claims > 0, one(F.try_divide(theses, claims))).otherwise(0.5)
    total = one(classified) * 0.20 + one(facts / 3) * 0.18 + one(claims / 2) * 0.13 + matrix * 0.18 + quality * 0.10 + one(audit / 100) * 0.15 + (1 - F.least(generic * 0.05, F.lit(0.25))) * 0.06
    final = F.least(F.greatest(F.lit(0e0), F.floor(total * 100 + 0.5) / 100), F.when(fatal, 0.49).otherwise(1e0), F.when(generic >= 3, 0.69).otherwise(1e0))
    return F.when(mode == "SAFE_SKELETON", 0.2).when(mode == "TEMPLATE_MODEL", 0.5).otherwise(final)


def document_status(mode: Column, score: Column, fatal: Column) -> Column:
    caveats = "APROVADA COM RESSALVAS"
    return F.when(mode.isin("SAFE_SKELETON", "TEMPLATE_MODEL"), caveats).when(fatal, "REPROVADA").when(score >= 90, "MINUTA APROVADA").when(score >= 81, caveats).otherwise("REPROVADA")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with its place from 1 in an order, without a window over all rows: sorted by ranges, then each range's rows before it added.

    `order` must tell rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = write_once(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")  # ranges are sampled: pinned, as they are read twice
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")  # a row for each partition
    return placed.join(F.broadcast(before), "part").withColumn(name, F.col("at") + F.col("before") + 1).drop("part", "at", "before")


def rolled_cycles(df: DataFrame, now: str) -> DataFrame:
    """cycle_start and cycle_end: months added to `start` one by one, each clamped to its month's last day, until the end is after `now`.

    Once a month was short the day stays short, so the months can't be added at once: the steps are folded within the row, one for each
    month since `start`. A null start stays null.
    """
    step = lambda s, i: F.when(s["end"] > F.lit(now).cast("date"), s).otherwise(F.struct(s["end"].alias("start"), F.add_months(s["end"], 1).alias("end")))
    first = F.struct(F.col("start").alias("start"), F.add_months("start", 1).alias("end"))
    months = F.greatest(F.lit(1), F.ceil(F.months_between(F.lit(now).cast("date"), "start")).cast("int") + 2)
    rolled = df.withColumn("c", F.when(F.col("start").isNotNull(), F.aggregate(F.sequence(F.lit(1), months), first, step)))
    return rolled.withColumns({"cycle_start": F.col("c.start"), "cycle_end": F.col("c.end")}).drop("c", "start")


def cost(service: Column, tokens_in: Column, tokens_out: Column, rates: dict[str, tuple[float, float]], other: tuple[float, float]) -> Column:
    """Cost by rates for a thousand tokens in and out."""
    rate = [None, None]
    for k in (0, 1):
        case = F.lit(None).cast("double")
        for name, pair in rates.items():
            case = F.when(service == name, pair[k]).otherwise(case)
        rate[k] = F.coalesce(case, F.lit(other[k]))
    return tokens_in / 1e3 * rate[0] + tokens_out / 1e3 * rate[1]


def since(asked: Column, cursor: Column, overlap: int, first: str) -> Column:
    return F.coalesce(asked, F.date_sub(cursor, overlap), F.lit(first).cast("date"))
