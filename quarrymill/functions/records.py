"""Records made of free text: statutes by article, the first JSON object, repairs of doubtful fields, files of unknown encoding."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import ascii_edges, clean, fold, html_to_text

# Files


def html_files(spark: SparkSession, path: str, pattern: str = "*.htm*") -> DataFrame:
    """path, html of the files in a folder and its folders, read in parallel: UTF-16 by its mark or by the zero bytes of ASCII, UTF-8 by its mark or if valid, else ISO-8859-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.select("path", sniffed(F.col("content")).alias("html"))


def sniffed(content: Column) -> Column:
    """Bytes as text."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    second, first = F.substring(content, 2, 1) == F.unhex(F.lit("00")), F.substring(content, 1, 1) == F.unhex(F.lit("00"))
    return (
        F.when(head(3) == "EFBBBF", F.decode(F.substring(content, 4, 2**31 - 1), "UTF-8")).when(head(2).isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(second & ~first, F.decode(content, "UTF-16LE")).when(first & ~second, F.decode(content, "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    )


# Statutes

#: What is struck out, notes of amendments, and the lines that open an article or close it.
STRUCK = r"(?is)<(strike|s|del)\b[^>]*>.*?</\1\s*>|<(span)\b[^>]*style\s*=\s*[\"'][^\"']*line-through[^>]*>.*?</span\s*>"
NOTES = (r"\(Redação dada pel[^)]+\)", r"\(Incluído pel[^)]+\)", r"\(Vide[^)]+\)")
ARTICLE = r"Art\.\s*[0-9]+[ºo.]?"
HEADINGS = "LIVRO|TÍTULO|CAPÍTULO|SEÇÃO"


def statute_text(html: Column) -> Column:
    """The text in force of a statute's page: without what is struck out and notes of amendments."""
    text = html_to_text(F.regexp_replace(F.coalesce(html, F.lit("")), STRUCK, ""))
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), NOTES, text)


def articles(text: Column) -> Column:
    """Array of (device, text) in order: from each line that opens an article up to the next one or to a heading; lines are trimmed, empty ones go.

    What comes before the first article or after a heading belongs to none. The text is cut at once where lines open or close, so it may be of any length.
    Null has none.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), clean), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    parts = F.split(joined, rf"(?imu)^(?={ARTICLE}|{HEADINGS})", -1)
    number = lambda p: F.regexp_extract(p, r"(?iu)^Art\.\s*([0-9]+)", 1)
    opened = F.filter(parts, lambda p: number(p) != "")
    return F.transform(opened, lambda p: F.struct(F.concat(F.lit("Art. "), number(p)).alias("device"), F.btrim(p, F.lit("\n")).alias("text")))


def devices(statutes: DataFrame, norm: str, text: str, order: str) -> DataFrame:
    """norm, device, text: of articles with one number the last counts, by `order` of the rows and place in the text."""
    each = statutes.select(norm, order, F.posexplode(articles(F.col(text))).alias("place", "a"))
    return each.groupBy(norm, F.col("a.device").alias("device")).agg(F.max_by("a.text", F.struct(order, "place")).alias("text"))


# JSON


def first_json(text: Column) -> Column:
    """The first object in free text, as a variant: from the first brace to the one that closes it. Null if it is not closed or no JSON.

    Braces within strings do not count, nor do quotes after a backslash. Whatever follows the object is left out.
    """
    start = F.instr(text, "{")
    rest = F.when(start > 0, F.substring(text, start, F.char_length(text)))
    tokens = F.regexp_extract_all(rest, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}]|[^"{}]++'), F.lit(0))
    nothing = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def step(a: Column, t: Column) -> Column:
        depth = a["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(a["closed"], a).otherwise(F.struct(depth.alias("depth"), (a["size"] + F.char_length(t)).alias("size"), (depth == 0).alias("closed")))

    end = F.aggregate(tokens, nothing, step)
    return F.try_parse_json(F.when(end["closed"], F.substring(rest, F.lit(1), end["size"])))


# Repairs


def suspicious_case(value: Column) -> Column:
    """Whether a case number is doubtful: empty, or without a digit and short."""
    t = clean(F.coalesce(value, F.lit("")))
    words = F.size(F.split(t, " "))
    return (t == "") | (~t.rlike("[0-9]") & (((words <= 2) & (F.char_length(t) <= 16)) | (F.char_length(t) < 7)))


def suspicious_name(value: Column) -> Column:
    """Whether a rapporteur's name is doubtful: empty, cut at its beginning, under eight characters, or without three letters in a row."""
    t = clean(F.coalesce(value, F.lit("")))
    return (t == "") | fold(t).rlike("^(istro |inistro |inistra )") | (F.char_length(t) < 8) | ~t.rlike("[A-Za-z]{3,}")


def mended_name(value: Column) -> Column:
    """Titles in one form, and the letters back that scans cut off a title."""
    t = clean(F.coalesce(value, F.lit("")))
    low = fold(t)
    after = lambda n: F.trim(F.substring(t, n + 1, F.char_length(t)))
    return (
        F.when(low.startswith("min. "), F.concat(F.lit("Min. "), after(5))).when(low.startswith("ministro "), F.concat(F.lit("Ministro "), after(9))).when(low.startswith("ministra "), F.concat(F.lit("Ministra "), after(9)))
        .when(low.startswith("istro "), F.concat(F.lit("Min"), t)).when(low.startswith("inistro ") | low.startswith("inistra "), F.concat(F.lit("M"), t)).otherwise(t)
    )


class Rule(NamedTuple):
    """How a field takes a repair: where it is `doubtful`, or, with a margin, where the repair is longer by more than that. Repairs are cut to `most` characters."""

    doubtful: object  # Column -> Column
    margin: int | None
    most: int
    mend: object = clean


def _blank(value: Column) -> Column:
    return clean(F.coalesce(value, F.lit(""))) == ""


#: Margins and lengths of the fields.
FIELDS = {
    "processo": Rule(suspicious_case, 4, 120), "relator": Rule(suspicious_name, 2, 100, mended_name), "orgao_julgador": Rule(_blank, None, 180), "data_julgamento": Rule(_blank, None, 20),
    "data_publicacao": Rule(_blank, None, 20), "tema": Rule(_blank, 12, 500), "destaque": Rule(_blank, 20, 2000),
}


def repaired(records: DataFrame, repairs: DataFrame, key: str, fields: dict[str, Rule], least: float) -> DataFrame:
    """`records` with their fields repaired, and `changed`.

    repairs: key, confidence and fields, any number for a record, in any order. Those under the least confidence do not count (one that is no number is 0). Of the rest each field has
    one candidate: for fields with a margin the longest, then the surest; for others the surest, then the longest; then the greatest text. So the result does not depend on the order of the repairs,
    and one repair does what it would do alone. Null fields are empty. Records without repairs stay as they are.
    """
    sure = F.least(F.greatest(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0e0)), F.lit(0e0)), F.lit(1e0))
    new = {f: r.mend(F.substring(clean(F.coalesce(F.col(f), F.lit(""))), 1, r.most)) for f, r in fields.items()}
    offers = repairs.withColumn("_sure", sure).where(F.col("_sure") >= least).select(key, "_sure", *[c.alias(f) for f, c in new.items()])
    rank = lambda f, r: F.struct(*([F.char_length(f).alias("n"), F.col("_sure").alias("s")] if r.margin is not None else [F.col("_sure").alias("s"), F.char_length(f).alias("n")]), F.col(f).alias("t"))
    best = offers.groupBy(key).agg(*[F.max(F.when(F.col(f) != "", rank(f, r)))["t"].alias(f"_new_{f}") for f, r in fields.items()])
    both = records.join(best, key, "left")
    takes = {}
    for f, r in fields.items():
        offer, old = F.col(f"_new_{f}"), F.coalesce(F.col(f), F.lit(""))
        wanted = r.doubtful(F.col(f)) if r.margin is None else r.doubtful(F.col(f)) | (F.char_length(offer) > F.char_length(old) + r.margin)
        takes[f] = offer.isNotNull() & wanted
    columns = [F.when(takes[c], F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns]
    return both.select(*columns, F.coalesce(reduce(Column.__or__, takes.values()), F.lit(False)).alias("changed"))


# Page text

_CAPITALS = "[A-ZÀ-ÖØ-Þ]{4,}"


def undoubled(text: Column) -> Column:
    """Runs of capitals in which every letter stands twice, as scans leave them, with each letter once; other runs stay."""
    between, runs = F.split(text, _CAPITALS, -1), F.regexp_extract_all(text, F.lit(_CAPITALS), F.lit(0))
    once = F.transform(runs, lambda r: F.when(r.rlike(r"^(?:(.)\1)+$"), F.regexp_replace(r, r"(.)\1", "$1")).otherwise(r))
    return F.array_join(F.transform(F.arrays_zip(between.alias("gap"), once.alias("run")), lambda x: F.concat(x["gap"], F.coalesce(x["run"], F.lit("")))), "")


def flattened(text: Column, headers: tuple[str, ...] = (), rejoin: bool = True) -> Column:
    """Lines as one, words that a hyphen broke at a line's end as one, headers off, single spaces."""
    out = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), " {2,}", " ")
    if rejoin:
        out = F.regexp_replace(out, "([A-Za-zÀ-ÿ])- ([A-Za-zÀ-ÿ])", "$1$2")
    for header in headers:
        out = F.regexp_replace(out, header, " ")
    return clean(F.regexp_replace(F.regexp_replace(out, " {2,}", " "), r" \.", "."))


#: What opens a section: a thesis, a number, a Roman numeral, a line of capitals after an article, or one of these words.
SECTION_MARKS = (
    r"\bTese\s+\d+|^\s*\d+\.\s+\S|^\s*[IVX]+\s*[.\x{2014}\x{2013}\-\):;]|\b[IVX]{1,4}\s*[\x{2014}\x{2013}\-\.\)]\s+[A-ZÁÀÂÃÉÊÍÓÔÕÚa-záàâãéêíóôõú]|^\s*D[AO]S?\s+[A-Z\x{00C0}-\x{00D6}\x{00D8}-\x{00DE}]{3}"
    r"|^\s*(?:RELAT[OÓ]RIO|FUNDAMENTA[CÇ][AÃ]O|DISPOSITIVO|PEDIDOS?|CONCLUS[AÃ]O|S[IÍ]NTESE|PRE[AÂ]MBULO|CABE[CÇ]ALHO|HIST[OÓ]RICO|PROVAS?|DIREITO|M[EÉ]RITO"
    r"|MOTIVA[CÇ][AÃ]O|DO\s+M[EÉ]RITO|DA\s+CAUSA|DOS\s+FATOS?|DO\s+DIREITO|DA\s+FUNDAMENTA|DOS\s+PEDIDOS?|DOS\s+FUNDAMENTOS?|DA\s+CONCLUS[AÃ]O)\b"
)


def section_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?imu)" + ascii_edges(SECTION_MARKS)))
