"""Number parsing, missing-value and rounding-safe aggregate expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Double epsilon, and the text forms accepted as numbers. Spark's own cast also accepts
# '7d' / '7f', which must stay text, hence the guard in front of the cast.
EPS = 2.220446049250313e-16
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE_TEXT = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def text_to_number(value: Column, allow_infinite: bool = True) -> Column:
    pattern = f"{DECIMAL_TEXT}|{INFINITE_TEXT}" if allow_infinite else DECIMAL_TEXT
    return F.when(value.rlike(pattern), F.trim(value).try_cast("double"))


def to_number(value: Column, dtype: T.DataType, allow_infinite: bool = True) -> Column:
    """Number of any value, NULL where it has none (NaN counts as none)."""
    if is_text(dtype):
        return text_to_number(value, allow_infinite)
    if is_floating(dtype):
        return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        micros = F.unix_micros(value.cast("timestamp"))
        return micros.cast("double") * F.lit(1000.0)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in floating columns, so that NULL is the only missing value."""
    wanted = set(df.columns if columns is None else columns)
    fixed = [
        F.nanvl(col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if f.name in wanted and is_floating(f.dataType)
        else col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*fixed)


def is_finite(value: Column) -> Column:
    """True for a number that is neither missing, NaN nor infinite; never NULL."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_integral(value: Column) -> Column:
    return F.coalesce((value == F.floor(value)) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def total_of(columns: Iterable[Column]) -> Column:
    """Row sum in list order."""
    return reduce(add, columns)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def least_of(values: Sequence[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def fixed_sum(value: Column, decimals: int | None) -> Column:
    """Sum of a column. With ``decimals`` the values are known to be fixed-point money and are added as
    decimals, which makes the result independent of how rows were spread over tasks."""
    return F.sum(value) if decimals is None else F.sum(value.cast(T.DecimalType(20, decimals)))


def mean_of(value: Column, decimals: int | None = None) -> Column:
    if decimals is None:
        return F.avg(value)
    return fixed_sum(value, decimals).cast("double") / F.when(F.count(value) > 0, F.count(value))
