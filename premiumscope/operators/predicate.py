"""Row selection: a JSON predicate language compiled to one ``Column``, plus SQL and portfolio filters.

Comparisons with missing values are two-valued (a missing cell is "not equal", and ``not`` keeps it), so every
leaf is built to never be NULL: ``isNotNull & comparison``, ``eqNullSafe`` or its negation. These forms are
also pushed down to the Parquet scan, negated or not.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premiumscope.functions.numeric import col, dtype_of, is_finite, is_floating, is_text, nan_to_null, to_number
from premiumscope.spec import COVERAGE_COLUMN, SPLIT, TARIFF_COLUMN

Node = dict[str, Any]


def _is_missing(literal: Any) -> bool:
    return literal is None or (isinstance(literal, float) and math.isnan(literal))


def _comparable(dtype: T.DataType, literal: Any) -> Column | None:
    """The literal as a column of a type Spark compares with ``dtype`` without a cast error, else None."""
    if isinstance(dtype, T.BooleanType) and isinstance(literal, (bool, int, float)):
        return F.lit(bool(literal)) if literal in (0, 1) else None
    if isinstance(dtype, T.NumericType) and isinstance(literal, (bool, int, float)):
        return F.lit(int(literal) if isinstance(literal, bool) else literal)
    if is_text(dtype) and isinstance(literal, str):
        return F.lit(literal)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(literal, str):
            try:
                dt.datetime.fromisoformat(literal)
            except ValueError:
                return None
            return F.lit(literal).cast(dtype)
        if isinstance(literal, dt.date):
            return F.lit(literal).cast(dtype)
    return None


@dataclass(frozen=True)
class Cell:
    """A column under selection: what counts as present, and how it compares with a literal."""

    value: Column
    dtype: T.DataType
    nan_is_missing: bool

    @property
    def present(self) -> Column:
        if self.nan_is_missing and is_floating(self.dtype):
            return self.value.isNotNull() & ~F.isnan(self.value)
        return self.value.isNotNull()

    def ordered(self, compare: Callable[[Any, Any], Any], literal: Any) -> Column:
        """Two-valued comparison; nothing compares with a missing literal."""
        if _is_missing(literal):
            return F.lit(False)
        other = _comparable(self.dtype, literal)
        if other is None:  # a truth value against a number
            return self.present & compare(self.value.cast("int"), F.lit(literal))
        return self.present & compare(self.value, other)

    def equal(self, literal: Any) -> Column:
        other = None if _is_missing(literal) else _comparable(self.dtype, literal)
        return F.lit(False) if other is None else self.value.eqNullSafe(other)

    def member(self, candidates: Sequence[Any]) -> Column:
        known = [_comparable(self.dtype, c) for c in candidates if not _is_missing(c)]
        usable = [c for c in known if c is not None]
        member = self.present & self.value.isin(*usable) if usable else F.lit(False)
        if is_text(self.dtype) and any(_is_missing(c) for c in candidates):
            member = member | self.value.isNull()
        return member


# Which ends of a range belong to it: (comparison with the lower end, comparison with the upper end).
ENDS: dict[Any, tuple[Callable, Callable]] = {
    True: (operator.ge, operator.le), "both": (operator.ge, operator.le),
    False: (operator.gt, operator.lt), "neither": (operator.gt, operator.lt),
    "left": (operator.ge, operator.lt), "right": (operator.gt, operator.le),
}


def _no_order(dtype: T.DataType, literal: Any) -> bool:
    number = isinstance(dtype, T.BooleanType) and isinstance(literal, (int, float))
    return not (_is_missing(literal) or number or _comparable(dtype, literal) is not None)


def _wrong_literal(*names: str) -> Callable[[T.DataType, Node], str | None]:
    def check(dtype: T.DataType, node: Node) -> str | None:
        wrong = {name: node.get(name) for name in names if _no_order(dtype, node.get(name))}
        return f"a {dtype.simpleString()} has no order with {wrong}" if wrong else None

    return check


def _wrong_list(dtype: T.DataType, node: Node) -> str | None:
    return None if isinstance(node["values"], list) else f"values is {node['values']!r}, not a list"


def _wrong_range(dtype: T.DataType, node: Node) -> str | None:
    side = node.get("inclusive", True)
    known = isinstance(side, (bool, str)) and side in ENDS
    return _wrong_literal("lower", "upper")(dtype, node) if known else f"inclusive is {side!r}, not one of {list(ENDS)}"


@dataclass(frozen=True)
class Operation:
    """What a comparison needs beside its field, what is wrong with its operands, and the column it stands for."""

    build: Callable[[Cell, Node], Column]
    needs: tuple[str, ...] = ()
    problem: Callable[[T.DataType, Node], str | None] = lambda dtype, node: None


def _range(cell: Cell, node: Node) -> Column:
    low, high = ENDS[node.get("inclusive", True)]
    return cell.ordered(low, node["lower"]) & cell.ordered(high, node["upper"])


OPERATIONS: dict[str, Operation] = {
    "eq": Operation(lambda cell, node: cell.equal(node.get("value"))),
    "ne": Operation(lambda cell, node: ~cell.equal(node.get("value"))),
    **{
        name: Operation(lambda cell, node, compare=compare: cell.ordered(compare, node.get("value")), (), _wrong_literal("value"))
        for name, compare in {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}.items()
    },
    "in": Operation(lambda cell, node: cell.member(node["values"]), ("values",), _wrong_list),
    "not_in": Operation(lambda cell, node: ~cell.member(node["values"]), ("values",), _wrong_list),
    "between": Operation(_range, ("lower", "upper"), _wrong_range),
    "is_null": Operation(lambda cell, node: ~cell.present),
    "not_null": Operation(lambda cell, node: cell.present),
}
# Joiners of selections: how the parts' columns become one, and whether the body is a list of parts or a single one.
JOINERS: dict[str, tuple[Callable[[list[Column]], Column], bool]] = {
    "all": (lambda parts: reduce(operator.and_, parts), True),
    "any": (lambda parts: reduce(operator.or_, parts), True),
    "not": (lambda parts: ~parts[0], False),
}


def _parts(key: str, body: Any) -> list[tuple[str, Any]]:
    """The selections a joiner holds, each with its place."""
    return [(f"{key}[{i}]", part) for i, part in enumerate(body)] if JOINERS[key][1] else [(key, body)]


def selection_problems(expression: Any, schema: T.StructType, place: str = "selection") -> Iterator[str]:
    """Everything wrong with a selection, each with the place of the node it is about. No data is read."""
    if not isinstance(expression, dict):
        yield f"{place} is {expression!r}, not an object"
        return
    joiners = [key for key in JOINERS if key in expression]
    if joiners:
        others = sorted(set(expression) - {joiners[0]})
        if others:
            yield f"{place} has {others} beside {joiners[0]!r}"
        body = expression[joiners[0]]
        if JOINERS[joiners[0]][1] and not (isinstance(body, list) and body):
            yield f"{place}.{joiners[0]} is {body!r}, not a list of selections"
            return
        for own, part in _parts(joiners[0], body):
            yield from selection_problems(part, schema, f"{place}.{own}")
        return
    name, op = expression.get("field"), expression.get("op")
    if not isinstance(name, str) or name not in schema.fieldNames():
        yield f"{place}.field is {name!r}, which is no column"
    elif not isinstance(op, str) or op not in OPERATIONS:
        yield f"{place}.op is {op!r}; {name!r} can be compared by {', '.join(OPERATIONS)}"
    else:
        lacking = [key for key in OPERATIONS[op].needs if key not in expression]
        wrong = f"{op!r} lacks {lacking}" if lacking else OPERATIONS[op].problem(schema[name].dataType, expression)
        if wrong:
            yield f"{place}: {wrong}"


def compile_predicate(expression: Node | None, schema: T.StructType, nan_is_missing: bool = False) -> Column:
    """Boolean column for a selection; None selects all rows.

    The whole selection is checked before any of it is compiled, and all its problems are reported together. With
    ``nan_is_missing`` NaN in a floating column counts as missing, for tables that were not written by this package.
    """
    if expression is None:
        return F.lit(True)
    problems = list(selection_problems(expression, schema))
    if problems:
        raise ValueError("; ".join(problems))

    def column(node: Node) -> Column:
        key = next((key for key in JOINERS if key in node), None)
        if key is not None:
            return JOINERS[key][0]([column(part) for _, part in _parts(key, node[key])])
        cell = Cell(col(node["field"]), schema[node["field"]].dataType, nan_is_missing)
        return OPERATIONS[node["op"]].build(cell, node)

    return column(expression)


def select_raw_rows(df: DataFrame, expression: Node | None) -> DataFrame:
    """``select_rows`` on a table that may hold NaN: the selection reads the columns as they are stored, so that it
    reaches the scan, and NaN becomes NULL behind it."""
    return nan_to_null(df.filter(compile_predicate(expression, df.schema, nan_is_missing=True)))


def select_rows(df: DataFrame, expression: Node | None) -> DataFrame:
    return df.filter(compile_predicate(expression, df.schema))


# ---- free-form and portfolio filters ----------------------------------------------------------------

def free_filter(df: DataFrame, condition: str | None) -> DataFrame:
    """Rows matching a Spark SQL condition (back-quoted names allowed); blank keeps all rows."""
    if condition is None or not condition.strip():
        return df
    try:
        return df.filter(F.expr(condition))
    except (AnalysisException, ParseException) as error:
        raise ValueError(f"{condition!r} is no condition on this table: {error}") from error


def by_split(df: DataFrame, label: str) -> DataFrame:
    return df.filter(col(SPLIT) == label)


def portfolio_filter(
    df: DataFrame,
    tariffs: Sequence[str] = (),
    coverages: Sequence[str] = (),
    ages: tuple[float, float] | None = None,
    age_column: str = "antig",
) -> DataFrame:
    """Tariff and coverage multi-selects (empty = all) and an inclusive age range (missing ages drop out)."""
    kept = df
    for name, chosen in ((TARIFF_COLUMN, tariffs), (COVERAGE_COLUMN, coverages)):
        if chosen and name in df.columns:
            kept = kept.filter(col(name).cast("string").isin(list(chosen)))
    if ages is not None and age_column in df.columns:
        age = col(age_column)
        if not isinstance(dtype_of(df, age_column), T.NumericType):
            age = to_number(age, dtype_of(df, age_column))
        kept = kept.filter((age >= ages[0]) & (age <= ages[1]))
    return kept


def option_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a filter column."""
    value = col(column).cast("string").alias("value")
    return df.select(value).filter("value IS NOT NULL").distinct().orderBy("value")


def age_bounds(df: DataFrame, column: str = "antig") -> DataFrame:
    """Whole-number ends of the age slider (truncated, as the options show them)."""
    age = to_number(col(column), dtype_of(df, column))
    return df.agg(F.min(age).cast("long").alias("lower"), F.max(age).cast("long").alias("upper"))


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(operator.and_, [is_finite(col(name).cast("double")) for name in columns]))
