"""Feature encoders. Data-dependent schemas are learnt by ``fit_*`` (small aggregates) and applied by pure
projections, so the transform itself is one lazy ``select`` per step."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premiumscope.functions.labels import coverage_label, tag_order, tag_tokens, text_or_missing
from premiumscope.functions.numeric import col, dtype_of, is_floating, is_text, to_number
from premiumscope.operators.scale import attach, bounded_table, materialise, row_width, running_total
from premiumscope.spec import (
    COVERAGE_COLUMN,
    PAIR_PREFIX,
    RAW_COVERAGE_COLUMN,
    TAGS_COLUMN,
    TARIFF_COLUMN,
)

# One output column per vocabulary entry: the width a Spark plan is asked to carry. Beyond it entries are numbered.
MAX_ENCODED_COLUMNS = 10_000
TAG_POSITIONS, PAIR_POSITION = f"{TAGS_COLUMN}_positions", f"{PAIR_PREFIX}_positions"
# Rows up to this many bytes are de-duplicated by their columns, wider ones by a fingerprint first.
WIDE_BYTES = 100
# Up to this many categories the codes are looked up in a literal array, beyond it by a join.
INLINE_CATEGORIES = 256


class TooManyEntries(ValueError):
    """A vocabulary exceeds the columns a plan is asked to carry."""


def _vocabulary(entries: DataFrame, what: str, limit: int) -> list[str]:
    table = bounded_table(entries.distinct(), limit)
    if table is None:
        raise TooManyEntries(f"{what} has more than {limit} distinct entries, too many for a column each; number them instead")
    return table.column(0).to_pylist()


def try_vocabulary(fit: Callable[..., list[str]], *arguments) -> list[str] | None:
    """What ``fit`` finds, or None if it is more than a column each can hold."""
    try:
        return fit(*arguments)
    except TooManyEntries:
        return None


# ---- rows -------------------------------------------------------------------------------------------

def drop_rows_without_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(targets))


def fill_features(df: DataFrame, targets: Iterable[str]) -> DataFrame:
    """Missing numeric features become 0; targets stay as they are."""
    skip = set(targets)
    numeric = [
        f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)
    ]
    return df.select(
        *[
            F.coalesce(col(name), F.lit(0).cast(dtype_of(df, name))).alias(name) if name in numeric else col(name)
            for name in df.columns
        ]
    )


def features_then_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    keep = [name for name in df.columns if name not in set(targets)]
    return df.select(*[col(name) for name in [*keep, *targets]])


def drop_duplicates_keep_first(
    df: DataFrame,
    identity: Sequence[str],
    order_by: Sequence[str] | None = None,
    helpers: Sequence[str] = (),
) -> DataFrame:
    """One row per combination of all non-identity columns: the one that is first by ``order_by``.

    Only the identity is left out of the comparison. A column that carries nothing but an order (a line
    number) is named in ``helpers`` to be left out as well.

    Narrow rows are grouped by their columns, copies collapsing in the tasks. Of wide rows a fingerprint is counted first,
    with nothing beside it. If few fingerprints repeat, rows with another one stay where they are and only the others are
    grouped by their columns; if more repeat than a broadcast holds, all rows are grouped, which moves each of them once.
    Only columns decide which rows are equal: rows that share a fingerprint by chance fall into groups of their own.
    """
    ids = [name for name in identity if name in df.columns]
    order = list(order_by or ids)
    left_out = {*ids, *helpers}
    compared = [name for name in df.columns if name not in left_out]
    carried = dict.fromkeys([*order, *ids, *helpers])
    first = F.min(F.struct(F.lit(0).alias("_any"), *[col(name) for name in carried])).alias("_first")
    # Adding 0.0 gives -0.0 and 0.0 the same hash; grouping treats them as equal anyway.
    hashed = [col(c) + F.lit(0.0) if is_floating(dtype_of(df, c)) else col(c) for c in compared]
    chosen = [F.col("_first").getField(name).alias(name) if name in left_out else col(name) for name in df.columns]
    mark = F.xxhash64(*hashed).alias("_mark")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy(mark, *[col(c) for c in compared]).agg(first).select(*chosen)

    if row_width(df.select(*[col(c) for c in compared])) <= WIDE_BYTES:
        return grouped(df)
    counted = df.groupBy(mark).agg(F.count(F.lit(1)).alias("_times"))
    repeated = bounded_table(counted.filter("_times > 1").select("_mark", F.lit(True).alias("_again")))
    if repeated is None:
        return grouped(df)
    if not repeated.num_rows:
        return df
    marked = df.withColumn("_mark", mark).join(F.broadcast(df.sparkSession.createDataFrame(repeated)), "_mark", "left")
    copies = materialise(grouped(marked.filter("_again")))
    return marked.filter("_again IS NULL").select(*[col(name) for name in df.columns]).unionByName(copies)


# ---- labels -----------------------------------------------------------------------------------------

def add_coverage_label(
    df: DataFrame, source: str = RAW_COVERAGE_COLUMN, target: str = COVERAGE_COLUMN
) -> DataFrame:
    """Replace the category number by its label (appended, the source column is removed)."""
    label = coverage_label(col(source), dtype_of(df, source))
    return df.withColumn(target, label).drop(source)


def fill_label(df: DataFrame, column: str = TARIFF_COLUMN) -> DataFrame:
    return df.withColumn(column, text_or_missing(col(column)))


# ---- tag lists --------------------------------------------------------------------------------------

def tag_rows(df: DataFrame, identity: str, tags: str = TAGS_COLUMN) -> DataFrame:
    """Long form of a tag list: one (identity, tag) row per distinct tag. Works for any vocabulary size."""
    tokens = F.array_distinct(tag_tokens(col(tags)))
    return df.select(col(identity), F.explode(tokens).alias("tag"))


def fit_tags(df: DataFrame, tags: str = TAGS_COLUMN, limit: int = MAX_ENCODED_COLUMNS) -> list[str]:
    """Vocabulary of a tag column: digits by value first, then text order. Cells are made distinct before
    they are split, so repeated combinations are split once per task."""
    cells = df.select(col(tags)).filter(col(tags).isNotNull()).distinct()
    words = _vocabulary(cells.select(F.explode(tag_tokens(col(tags)))), f"Column '{tags}'", limit)
    return sorted(words, key=tag_order)


def multi_hot(df: DataFrame, vocabulary: Sequence[str], tags: str = TAGS_COLUMN) -> DataFrame:
    """Replace the tag column by one 0/1 column per vocabulary entry; no-op if it is absent."""
    if tags not in df.columns:
        return df
    split = df.withColumn("_tokens", tag_tokens(col(tags)))
    flags = [
        F.array_contains("_tokens", F.lit(tag)).cast("int").alias(f"{tags}_{tag}") for tag in vocabulary
    ]
    return split.select(*[col(name) for name in df.columns if name != tags], *flags)


# ---- dictionaries of any size -----------------------------------------------------------------------

def numbered(values: DataFrame, digits_first: bool = False) -> DataFrame:
    """``values(value)`` made distinct and numbered from 0 in text order, as ``(value, number)``.

    With ``digits_first`` plain digits come before other text, by their value. The rank is taken over sorted ranges,
    so the dictionary is never held by one task or the driver.
    """
    distinct = values.select("value").filter("value IS NOT NULL").distinct()
    order = ["value"]
    if digits_first:
        plain = F.col("value").rlike(r"^[0-9]+$")
        digits = F.when(plain, F.regexp_replace("value", "^0+(?=.)", ""))
        distinct = distinct.withColumns({"_word": ~plain, "_long": F.coalesce(F.length(digits), F.lit(0)), "_digits": F.coalesce(digits, F.lit(""))})
        order = ["_word", "_long", "_digits", "value"]
    return running_total(distinct, order, out="_rank").select("value", (F.col("_rank") - 1).alias("number"))


def fit_tag_dictionary(df: DataFrame, tags: str = TAGS_COLUMN) -> DataFrame:
    """``fit_tags`` for a vocabulary of any size: ``(value, number)``."""
    cells = df.select(col(tags)).filter(col(tags).isNotNull()).distinct()
    return numbered(cells.select(F.explode(tag_tokens(col(tags))).alias("value")), digits_first=True)


def fit_pair_dictionary(df: DataFrame, tariff: str = TARIFF_COLUMN, coverage: str = COVERAGE_COLUMN) -> DataFrame:
    """``fit_pairs`` for any number of pairs: ``(value, number)``."""
    return numbered(df.select(pair_key(tariff, coverage).alias("value")))


def tag_positions(df: DataFrame, dictionary: DataFrame, tags: str = TAGS_COLUMN, out: str = TAG_POSITIONS) -> DataFrame:
    """Replace the tag column by the ascending numbers of its distinct tags (``array<long>``), whatever their number.

    Each distinct cell is split, looked up and gathered once; rows then look up their cell. Both lookups find and
    spread heavy keys if they cannot be broadcast. A missing cell and tags outside the dictionary give no number.
    """
    cells = df.select(col(tags).alias("_cell")).filter("_cell IS NOT NULL").distinct()
    long = cells.select("_cell", F.explode(F.array_distinct(tag_tokens(F.col("_cell")))).alias("value"))
    gathered = attach(long, dictionary, ["value"], "inner").groupBy("_cell")
    coded = materialise(gathered.agg(F.array_sort(F.collect_list("number")).alias(out)))
    kept = [name for name in df.columns if name != tags]
    found = attach(df.withColumn("_cell", col(tags)), coded, ["_cell"])
    nothing = F.array().cast("array<long>")
    return found.select(*[col(name) for name in kept], F.coalesce(col(out), nothing).alias(out))


def pair_position(
    df: DataFrame,
    dictionary: DataFrame,
    tariff: str = TARIFF_COLUMN,
    coverage: str = COVERAGE_COLUMN,
    out: str = PAIR_POSITION,
) -> DataFrame:
    """Add the number of the row's pair as an array of one, none for a pair outside the dictionary."""
    found = attach(df.withColumn("value", pair_key(tariff, coverage)), dictionary, ["value"])
    position = F.when(F.col("number").isNull(), F.array().cast("array<long>")).otherwise(F.array("number"))
    return found.withColumn(out, position).select(*[col(name) for name in df.columns], out)


def sparse_vectors(df: DataFrame, blocks: Sequence[tuple[str, int]], out: str = "features") -> DataFrame:
    """Add a ``SparseVector`` of 0/1 entries: the position columns of ``blocks`` (name, size) one after the other.

    The vector's fields are built as columns and written once; reading them back under the vector type needs no
    Python and no list of columns. One vector has at most 2**31 - 1 entries, the limit of its type.
    """
    def moved(name: str, by: int) -> Column:
        return F.transform(col(name), lambda n: (n + F.lit(by)).cast("int"))

    before, parts = 0, []
    for name, size in blocks:
        parts.append(moved(name, before))
        before += size
    if before >= 1 << 31:
        raise ValueError(f"{before} entries do not fit a vector; its positions are 32-bit numbers")
    indices = F.concat(*parts) if parts else F.array().cast("array<int>")
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(before).alias("size"),
        indices.alias("indices"),
        F.transform(indices, lambda _: F.lit(1.0)).alias("values"),
    )
    built = df.withColumn(out, vector)
    fields = [T.StructField(f.name, VectorUDT(), True) if f.name == out else f for f in built.schema.fields]
    return materialise(built, T.StructType(fields))


# ---- tariff x coverage pairs ------------------------------------------------------------------------

def pair_key(tariff: str = TARIFF_COLUMN, coverage: str = COVERAGE_COLUMN) -> Column:
    return F.concat(text_or_missing(col(tariff)), F.lit("__"), text_or_missing(col(coverage)))


def fit_pairs(
    df: DataFrame,
    tariff: str = TARIFF_COLUMN,
    coverage: str = COVERAGE_COLUMN,
    limit: int = MAX_ENCODED_COLUMNS,
) -> list[str]:
    return sorted(_vocabulary(df.select(pair_key(tariff, coverage)), "The tariff-coverage pair", limit))


def pair_one_hot(
    df: DataFrame, pairs: Sequence[str], tariff: str = TARIFF_COLUMN, coverage: str = COVERAGE_COLUMN
) -> DataFrame:
    keyed = df.withColumn("_pair", pair_key(tariff, coverage))
    flags = [(F.col("_pair") == F.lit(p)).cast("byte").alias(f"{PAIR_PREFIX}_{p}") for p in pairs]
    return keyed.select(*[col(name) for name in df.columns], *flags)


def unused_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """0/1 columns that are zero in every row of ``df``: one fused aggregate."""
    if not columns:
        return []
    row = df.agg(*[F.max(col(name).cast("int")).alias(f"m{i}") for i, name in enumerate(columns)]).first()
    return [name for i, name in enumerate(columns) if not row[f"m{i}"]]


# ---- numbers held as text ---------------------------------------------------------------------------

def numeric_like_counts(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Per text column: how many values are present and how many of them parse. One pass, one wide row,
    then reshaped."""
    skip = set(exclude)
    text = [f.name for f in df.schema.fields if is_text(f.dataType) and f.name not in skip]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, present long, parsed long")
    wide = df.agg(
        *[F.count(col(name)).alias(f"c{i}") for i, name in enumerate(text)],
        *[F.count(to_number(col(name), T.StringType())).alias(f"p{i}") for i, name in enumerate(text)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("column"), F.col(f"c{i}").alias("present"), F.col(f"p{i}").alias("parsed"))
            for i, name in enumerate(text)
        ]
    )
    return wide.select(F.inline(rows))


def fit_numeric_like(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Text columns whose every present value is a number (a column without values qualifies)."""
    rows = numeric_like_counts(df, exclude).collect()
    return [row["column"] for row in rows if row["present"] == row["parsed"]]


def cast_numeric_like(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    chosen = set(columns)
    return df.select(
        *[
            to_number(col(name), dtype_of(df, name)).alias(name) if name in chosen else col(name)
            for name in df.columns
        ]
    )


def coerce_all_numeric(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Every column as a number, unparsable values as NULL; columns in ``keep`` are left alone."""
    skip = set(keep)
    return df.select(
        *[
            col(f.name) if f.name in skip else to_number(col(f.name), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


# ---- ordinal categories -----------------------------------------------------------------------------

@dataclass
class OrdinalModel:
    """Category codes per column: small dictionaries as sorted lists, large ones as (value, code) tables."""

    inline: dict[str, list[str]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in skip and (is_text(f.dataType) or isinstance(f.dataType, T.BooleanType))
    ]


def ordinal_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): rank of each distinct value in text order, computed as a distributed global rank."""
    return numbered(df.select(col(column).cast("string").alias("value"))).withColumnRenamed("number", "code")


def fit_ordinal(df: DataFrame, columns: Sequence[str], inline_limit: int = INLINE_CATEGORIES) -> OrdinalModel:
    model = OrdinalModel()
    if not columns:
        return model
    sizes = df.agg(
        *[F.approx_count_distinct(col(name).cast("string")).alias(f"n{i}") for i, name in enumerate(columns)]
    ).first()
    small = [name for i, name in enumerate(columns) if sizes[f"n{i}"] <= inline_limit]
    if small:
        cells = F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), col(n).cast("string").alias("value")) for n in small])
        )
        found = df.select(cells.alias("cell")).select("cell.*").filter("value IS NOT NULL").distinct()
        table = bounded_table(found, 4 * inline_limit * len(small))
        if table is None:
            small = []
        else:
            model.inline = {name: [] for name in small}
            for row in table.to_pylist():
                model.inline[row["name"]].append(row["value"])
            for values in model.inline.values():
                values.sort()
    for name in columns:
        if name not in model.inline:
            model.tables[name] = ordinal_dictionary(df, name)
    return model


def ordinal_codes(df: DataFrame, model: OrdinalModel) -> DataFrame:
    """Replace each fitted column by its category code; missing or unseen values give -1. Codes of a dictionary that
    is looked up by a join are 64-bit numbers."""
    coded = df
    for name, table in model.tables.items():
        keyed = coded.withColumn("value", col(name).cast("string"))
        coded = attach(keyed, table, ["value"]).withColumn(name, F.coalesce("code", F.lit(-1).cast("long"))).drop("value", "code")
    columns = []
    for name in df.columns:
        if name in model.inline:
            known = F.array(*[F.lit(v) for v in model.inline[name]]).cast("array<string>")
            place = F.array_position(known, col(name).cast("string"))
            columns.append((F.coalesce(place, F.lit(0)) - 1).cast("int").alias(name))
        else:
            columns.append(col(name))
    return coded.select(*columns)
