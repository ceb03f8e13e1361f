"""Category labels and tag lists kept in one text cell."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premiumscope.functions.numeric import DECIMAL_TEXT, is_integral, to_number
from premiumscope.spec import MISSING

# Policy coverage codes by category number.
COVERAGE_LABELS = {
    1: "A", 2: "A2", 3: "B1", 4: "B", 5: "B2", 6: "XB", 7: "C1", 8: "C4", 9: "C1+", 10: "C", 11: "C2",
    12: "C3", 13: "D2C", 14: "D2H", 15: "D6%", 16: "D5%", 17: "D4%", 18: "D3%", 19: "D5", 20: "D6",
    21: "D2%", 22: "D1%", 23: "D54", 24: "D32", 25: "D2I", 26: "D36", 27: "D2", 28: "D3I", 29: "D3",
    30: "D4I", 31: "D4", 32: "D", 33: "D1",
}


def text_or_missing(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def coverage_label(
    value: Column, dtype: T.DataType, labels: dict[int, str] = COVERAGE_LABELS
) -> Column:
    """Label of an integer-valued category number; other values keep their text; missing -> ``Missing``."""
    if isinstance(dtype, T.IntegralType):
        entries = ((F.lit(k), F.lit(v)) for k, v in labels.items())
        known = F.try_element_at(F.create_map(*chain.from_iterable(entries)), value.try_cast("int"))
    else:
        number = to_number(value, dtype, allow_infinite=False)
        entries = ((F.lit(float(k)), F.lit(v)) for k, v in labels.items())
        known = F.when(
            is_integral(number), F.try_element_at(F.create_map(*chain.from_iterable(entries)), number)
        )
    return F.coalesce(known, value.cast("string"), F.lit(MISSING))


def _canonical_tag(tag: Column) -> Column:
    whole = F.when(tag.rlike(r"^[+-]?\d+$"), tag.try_cast("decimal(38,0)").cast("string"))
    number = F.when(tag.rlike(DECIMAL_TEXT), tag.try_cast("double"))
    integral = F.when(is_integral(number), number.try_cast("decimal(38,0)").cast("string"))
    # Most tags are words: look at the first character before trying any pattern.
    may_be_number = F.substring(tag, 1, 1).isin(*"+-.0123456789")
    return F.when(may_be_number, F.coalesce(whole, integral, tag)).otherwise(tag)


def tag_tokens(value: Column) -> Column:
    """Split ``'16.0, x,,7'`` into ``['16', 'x', '7']``; a missing cell gives an empty list."""
    stripped = F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")
    parts = F.split(stripped, r"(?U)\s*,\s*")
    tags = F.transform(F.filter(parts, lambda part: part != ""), _canonical_tag)
    return F.coalesce(tags, F.array().cast("array<string>"))


def tag_order(tag: str) -> tuple[bool, int, str]:
    """Driver-side vocabulary order: plain digits by value, then the rest by text."""
    return (False, int(tag), "") if tag.isdigit() else (True, 0, tag)
