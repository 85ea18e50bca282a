"""Column -> Column building blocks (all JVM-side built-ins, no Python UDFs)."""

from backlist.functions.clean import (
    NA_WORDS, null_words, parse_date, parse_money, parse_number, parse_quantity,
)
from backlist.functions.fmt import (
    date_stamp, money_text, pct_text, round_half_even, tidy_name,
)
from backlist.functions.agg import money_sum, pct_change

__all__ = [
    "NA_WORDS", "null_words", "parse_date", "parse_money", "parse_number",
    "parse_quantity", "date_stamp", "money_text", "pct_text", "round_half_even",
    "tidy_name", "money_sum", "pct_change",
]
