"""Column expressions for text, identifiers and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"
# fixed values: names of categories, the words of a text that scores compare, the expressions that ask for a comparison
CATEGORY_LABELS = {1: "Business", 2: "Financial / operations", 3: "Risk", 4: "Recent developments"}
SCORED_WORD = r"(?U)\b\w+(?:[.-]\w+)*\b"
COMPARISON = r"(?i)\b(?:compar(?:e|ed|ing|ison)|versus|vs\.?|relative\s+to)(?!\w)"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WS, " "))


def is_missing(c: Column) -> Column:
    """Null or blank; linear in the text, whatever runs of spaces it holds."""
    return c.isNull() | ~c.cast("string").rlike(r"(?U)\S")


def words(c: Column) -> Column:
    """Maximal runs of characters other than white space, as they stand; of a null text none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS), lambda w: w != "")


def lexical_tokens(c: Column) -> Column:
    """Tokenizer ``lower-whitespace-v1``: words of the lower-cased text, punctuation kept."""
    return words(F.lower(c))


def scoring_tokens(c: Column) -> Column:
    """Lower-cased words; points and hyphens inside one, as in ``10-k`` or ``3.14``, belong to it."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(SCORED_WORD), F.lit(0))


def pipe_list(c: Column) -> Column:
    """The parts of a list separated by ``|``, stripped, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), lambda x: x != "")


def parse_boolean(c: Column) -> Column:
    """true, 1, yes / false, 0, no in any case; else null."""
    v = F.lower(strip(c))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)


def parse_judge(c: Column) -> Column:
    """A digit from 1 to 5, a point after it allowed, and nothing else; else null."""
    v = strip(c)
    return F.when(v.rlike(r"^[1-5]\.?$"), F.substring(v, 1, 1).cast("int"))


def pad_cik(c: Column) -> Column:
    """Ten digits; what isn't a number stays."""
    v = strip(c)
    return F.when(v.rlike("^[0-9]+$"), F.lpad(F.coalesce(F.nullif(F.regexp_replace(v, "^0+", ""), F.lit("")), F.lit("0")), 10, "0")).otherwise(v)


def safe_name(c: Column) -> Column:
    """For file names: runs of other characters than letters, digits, ``._-`` as a hyphen; ``unknown`` if nothing is left."""
    v = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("unknown"))


def chunk_id(ticker: Column, accession: Column, index: Column) -> Column:
    """Ticker, accession number and index; the index has four digits, or as many as it needs."""
    return F.concat_ws("_", F.lower(strip(ticker)), F.regexp_replace(accession, "[^A-Za-z0-9]+", ""), F.format_string("%04d", index))


def doc_id(ticker: Column, form: Column, date: Column) -> Column:
    return F.concat_ws("_", F.upper(strip(ticker)), strip(form), strip(date))


def norm_ticker(c: Column) -> Column:
    """Upper case without padding; null where blank."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def parse_date(c: Column) -> Column:
    """A date written ``YYYY-MM-DD`` or ``MM/DD/YYYY``; else null."""
    v = strip(c)
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(v, F.lit("yyyy-MM-dd"))).when(v.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(v, F.lit("MM/dd/yyyy"))).cast("date")


def form_mentions(c: Column) -> Column:
    """The forms a question names, in the order of first mention; white space and one dash between number and letter are optional."""
    gap = r"\s*[-–—]?\s*"
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?iU)\b(?:10{gap}[KQ]|8{gap}K)\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.regexp_extract(x, "^[0-9]+", 0), F.lit("-"), F.upper(F.right(x, F.lit(1))))))


def compares(c: Column) -> Column:
    """Whether a question asks for a comparison."""
    return F.coalesce(c.rlike(COMPARISON), F.lit(False))


def share(n: Column, d: Column, digits: int = 2, factor: int = 100) -> Column:
    """``factor * n / d`` rounded; 0 where ``d`` is."""
    return F.when(d != 0, F.round(factor * n / d, digits)).otherwise(0.0)


def unit(v: Column) -> Column:
    """A vector at length 1, in doubles; one of length 0 stays."""
    d = v.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
