"""Parsing of messy catalog text into numbers and dates.

The rules reproduce pandas' ``read_csv`` + ``to_numeric(errors='coerce')``
behaviour that the catalog exports rely on, expressed as built-in Spark
expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cell texts that pandas' CSV reader treats as missing by
# default (exact match, no trimming).  "-" is deliberately not among them.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Date layouts tried in order; the first that parses wins.  Each is tried
# only on text of its shape (a failed parse costs an exception per cell).
DATE_FORMATS = ("yyyy-M-d", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy", "yyyy-MM-dd'T'HH:mm:ss",
                "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy H:mm", "yyyyMMdd", "yyyy")
DATE_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{4,} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,} \d{4}$",
    "M/d/yyyy H:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$",
    "yyyyMMdd": r"^\d{8}$",
    "yyyy": r"^\d{4}$",
}

# What pandas' numeric parser accepts: optional sign, digits with optional
# fraction (or a bare fraction) and optional exponent, surrounded by optional
# whitespace; or inf / infinity in any case with an optional sign and no
# surrounding whitespace.  (nan needs no match: it ends up missing / 0
# either way.)  Java-only forms (1.5d, 2f, hex, 1_000) never reach the cast.
NUMERIC_TEXT = r"^(\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*|[+-]?(?i:inf|infinity))$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_words(c: Column | str, words: Sequence[str] = NA_WORDS) -> Column:
    """Turn the missing-value words into NULL (read-time NA handling)."""
    c = _col(c)
    return F.when(c.isin(list(words)), F.lit(None).cast("string")).otherwise(c)


def _coerce_double(text: Column) -> Column:
    """pandas-style ``to_numeric(errors='coerce')`` on text; NULL when not a number.

    Spark's string->double cast follows Java and also accepts type suffixes
    (``1.5d``, ``2f``) and hex floats; pandas rejects those, so only text of
    pandas' numeric shape is cast (which also spares the cast's exception on
    junk).  Text that overflows to infinity without spelling ``inf`` is
    likewise not a number for pandas.
    """
    v = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    overflow = (F.abs(v) == F.lit(float("inf"))) & ~F.lower(text).contains("inf")
    return F.when(overflow, F.lit(None).cast("double")).otherwise(v)


def parse_money(c: Column | str) -> Column:
    """Money text -> DOUBLE, never NULL.

    ``$`` ``,`` ``)`` and spaces are removed and ``(`` becomes ``-`` (so
    accounting negatives ``(500)`` read as -500); anything that is then not a
    number, NaN included, becomes 0.
    """
    scrubbed = F.translate(F.coalesce(_col(c), F.lit("nan")), "($,) ", "-")
    return F.coalesce(F.nanvl(_coerce_double(scrubbed), F.lit(0.0)), F.lit(0.0))


def parse_quantity(c: Column | str) -> Column:
    """Quantity text -> DOUBLE, never NULL; no symbol scrub (``1,200`` -> 0)."""
    return F.coalesce(F.nanvl(_coerce_double(_col(c)), F.lit(0.0)), F.lit(0.0))


def parse_number(c: Column | str) -> Column:
    """Numeric text -> DOUBLE keeping missing as NULL (NaN -> NULL)."""
    v = _coerce_double(_col(c))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def parse_date(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date text -> DATE; unparseable text -> NULL (never raises under ANSI)."""
    c = F.trim(_col(c))
    tries = []
    for f in formats:
        attempt = F.to_date(F.try_to_timestamp(c, F.lit(f)))
        shape = DATE_SHAPES.get(f)
        tries.append(F.when(c.rlike(shape), attempt) if shape else attempt)
    return F.coalesce(*tries)


# The same as SQL text over a column's name: a plan over many columns takes one
# parse in the JVM for each instead of dozens of client calls.

def null_words_sql(name: str, words: Sequence[str] = NA_WORDS) -> str:
    return f"CASE WHEN {name} IN ({', '.join(repr(w) for w in words)}) THEN NULL ELSE {name} END"


def _coerce_sql(text: str) -> str:
    v = f"CASE WHEN {text} RLIKE r'{NUMERIC_TEXT}' THEN try_cast({text} AS DOUBLE) END"
    return f"CASE WHEN abs({v}) = double('infinity') AND NOT contains(lower({text}), 'inf') THEN NULL ELSE {v} END"


def money_text_sql(name: str) -> str:
    """What is left of money text when symbols are taken out."""
    return f"translate({name}, '($,) ', '-')"


def parse_money_sql(name: str) -> str:
    return parse_quantity_sql(money_text_sql(f"coalesce({name}, 'nan')"))


def parse_quantity_sql(name: str) -> str:
    return f"coalesce(nanvl({_coerce_sql(name)}, 0.0D), 0.0D)"


def not_money_sql(name: str) -> str:
    """Whether a non-blank cell doesn't parse as money."""
    v = _coerce_sql(money_text_sql(name))
    return f"{name} IS NOT NULL AND ({v} IS NULL OR isnan({v}))"
