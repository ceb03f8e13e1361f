"""Patterns that keep an operator exact when one group holds a large share of all rows.

* ``bounded_table``      - bring a table to the driver only if it is proven small
* ``attach``             - lookup join: broadcast when proven small, else heavy keys are found and spread
* ``materialise``        - cut lineage through a table in the shared checkpoint folder
* ``running_total``      - global prefix sums without a single-partition window
* ``numbered_ranges``    - rows in sorted ranges with their place, moved once
* ``grouped_quantiles``  - exact interpolated quantiles of all groups in one search, nothing sorted or collected
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premiumscope.functions.numeric import col

LOOKUP_MAX_ROWS = 200_000
LOOKUP_MAX_BYTES = 64 * 1024 * 1024
# Keys the frequent-items sketch reports and items it tracks; rows of one key that are left to one task.
HEAVY_KEYS, SKETCH_ITEMS, KEY_ROWS = 200, 10_000, 2_000_000
# Bytes of a sorted range at most, and rows that are worth a range of their own.
RANGE_BYTES, RANGE_ROWS = 128 * 1024 * 1024, 50_000
# Keys drawn per sorted range, between which the ends of the ranges are taken.
KEYS_PER_RANGE = 40
# Values of a bracket that are ranked at once, accuracy of the percentile sketch, marks of a later round.
SLICE_ROWS, QUANTILE_ACCURACY, SPACED_MARKS = 100_000, 10_000, 100


def bounded_table(
    df: DataFrame, max_rows: int = LOOKUP_MAX_ROWS, max_bytes: int = LOOKUP_MAX_BYTES
) -> pa.Table | None:
    """The rows of ``df`` if they fit the bound, else None. Never moves more than ``max_rows + 1`` rows."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows and table.nbytes <= max_bytes else None


def local_frame(spark: SparkSession, columns: dict[str, list], schema: pa.Schema) -> DataFrame:
    """Driver-side values (one list per column) as a local relation, whose size the optimizer knows."""
    return spark.createDataFrame(pa.table(columns, schema=schema))


def attach(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = LOOKUP_MAX_ROWS,
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Join ``df`` with a lookup table that has one row per key.

    The lookup is computed once and measured. Within the bound it is broadcast, so the large side is not
    shuffled. Beyond it both sides are shuffled by key, and keys that hold many rows are spread over as many tasks
    as their measured size asks for (``spread_join``).
    """
    table = bounded_table(lookup, max_rows)
    if table is not None:
        small = df.sparkSession.createDataFrame(table, schema=lookup.schema)
        return df.join(F.broadcast(small), list(on), how)
    return spread_join(df, lookup, on, how, key_rows)


def attach_rows(
    df: DataFrame, lookup: DataFrame, rows: int, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """``attach`` for a lookup whose row count is already known."""
    if rows <= LOOKUP_MAX_ROWS:
        return df.join(F.broadcast(lookup), list(on), how)
    return spread_join(df, lookup, on, how)


def heavy_keys(df: DataFrame, on: Sequence[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """(_hash, _salts) of the keys that hold more than ``key_rows`` rows: one pass of a frequent-items sketch.

    At most ``HEAVY_KEYS`` rows. A key the sketch overrates is spread for nothing, which changes no result; one that
    is not among the heaviest holds less than 1 / ``HEAVY_KEYS`` of the rows and is left to its own task.
    """
    hashed = df.select(F.xxhash64(*[col(name) for name in on]).alias("_hash"))
    found = hashed.agg(F.expr(f"approx_top_k(_hash, {HEAVY_KEYS}, {SKETCH_ITEMS})").alias("_top"))
    rows = [(r["item"], -(-r["count"] // key_rows)) for r in found.first()["_top"] or [] if r["count"] > key_rows]
    schema = pa.schema([("_hash", pa.int64()), ("_salts", pa.int64())])
    return local_frame(df.sparkSession, {"_hash": [h for h, _ in rows], "_salts": [n for _, n in rows]}, schema)


def spread_join(
    df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", key_rows: int = KEY_ROWS
) -> DataFrame:
    """Shuffle join on (keys, salt). Rows of a heavy key are dealt out by their position, so that equal rows part
    as well; the lookup row of such a key is repeated once per salt, every other key keeps the one salt 0."""
    heavy = F.broadcast(heavy_keys(df, on, key_rows))
    key = F.xxhash64(*[col(name) for name in on])
    salts = F.coalesce(F.col("_salts"), F.lit(1).cast("long"))
    dealt = (
        df.withColumn("_hash", key)
        .join(heavy, "_hash", "left")
        .withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts))
        .drop("_hash", "_salts")
    )
    repeated = (
        lookup.withColumn("_hash", key)
        .join(heavy, "_hash", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        .drop("_hash", "_salts")
    )
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for a local session."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    root = tempfile.mkdtemp(prefix="premiumscope-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def materialise(df: DataFrame, schema: T.StructType | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back, under ``schema`` if one is given. ``codec``
    is the compression, by default that of the session.

    Unlike a cached plan the copy survives lost executors, and unlike an RDD checkpoint later scans of it
    still prune columns and push filters down.
    """
    path = f"{checkpoint_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """A small result that several jobs read: kept as a local relation if it fits the lookup bound, else written."""
    table = bounded_table(df)
    return materialise(df) if table is None else df.sparkSession.createDataFrame(table, schema=df.schema)


def running_total(
    df: DataFrame,
    order_by: Sequence[str | Column],
    weight: Column | None = None,
    out: str = "_running",
    range_bytes: int = RANGE_BYTES,
    known_rows: int | None = None,
) -> DataFrame:
    """Add the inclusive prefix sum of ``weight`` (default 1, a rank) in the global order of ``order_by``.

    The order should be unique per row (group before calling), so that a range never has to hold one value's copies;
    rows that tie are numbered in any order. Rows are written once, which tells their size (unless ``known_rows`` says
    how many there are); then they move once, to as many sorted ranges as the size asks for, and each range adds up its
    rows in the order they lie in. Totals per range (one row each) give the offsets, which are added in a map. A table
    that fits one range needs none of this but the sort.
    """
    one = F.lit(1).cast("long") if weight is None else weight
    rows = df.withColumn("_weight", one)
    if known_rows is None:
        rows = materialise(rows)
        known_rows = rows.count()
    # As many as the bytes ask for, and as many as there are cores if that leaves each of them enough to do.
    cores = df.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-known_rows * row_width(rows) // range_bytes), min(cores, known_rows // RANGE_ROWS))
    if ranges == 1:
        return ranged_totals(rows, order_by, 1).withColumnRenamed("_within", out).drop("_range", "_weight")
    ranged = materialise(ranged_totals(rows, order_by, ranges))
    totals = ranged.groupBy("_range").agg(F.sum("_weight").alias("_total")).collect()
    ranges = sorted(totals, key=lambda r: r["_range"])
    offsets = [0]
    for row in ranges:
        offsets.append(offsets[-1] + row["_total"])
    amount = pa.float64() if isinstance(ranged.schema["_weight"].dataType, T.FractionalType) else pa.int64()
    small = local_frame(
        df.sparkSession,
        {"_range": [row["_range"] for row in ranges], "_offset": offsets[:-1]},
        pa.schema([("_range", pa.int32()), ("_offset", amount)]),
    )
    with_offset = ranged.join(F.broadcast(small), "_range")
    return with_offset.withColumn(out, F.col("_within") + F.col("_offset")).drop("_range", "_weight", "_within", "_offset")


def row_width(df: DataFrame) -> int:
    """Bytes of a row as Spark's own estimate counts them: 8 per number, 20 per text."""
    return 8 + sum(20 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 for f in df.schema.fields)


def ranged_totals(rows: DataFrame, order_by: Sequence[str | Column], ranges: int) -> DataFrame:
    """``rows`` in sorted ranges, numbered ``_range``, with the prefix sum of ``_weight`` inside each. One exchange."""
    order = [col(by) if isinstance(by, str) else by for by in order_by]
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("_within", ordered.schema["_weight"].dataType)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            within = pc.cumulative_sum(batch.column("_weight"), start=reached)
            reached = within[-1]
            yield pa.record_batch([*batch.columns, within], names=[*batch.schema.names, "_within"])

    return ordered.mapInArrow(add_up, schema).withColumn("_range", F.spark_partition_id())


def numbered_ranges(
    df: DataFrame,
    key: Sequence[Column],
    out: str,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``df`` sorted by ``key`` (ascending, missing values first), with the 1-based place of each row as ``out``.

    A partition is a range of the order and follows the one before it, so files written from here do as well. Rows move
    once and are not stored on the way: ends of the ranges are taken from drawn keys, one pass over the keys counts the
    rows of each range, and these counts are the offsets of the places. The key should be unique, as a range holds all rows
    of one key; rows that tie are numbered in any order.
    """
    order = F.struct(*[part.alias(f"k{i}") for i, part in enumerate(key)])  # made anew where it is needed, so it does not travel
    keys = df.select(order.alias("_order"))
    rows = keys.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-rows * row_width(df) // range_bytes), min(cores, rows // RANGE_ROWS))
    ends = _range_ends(keys, rows, ranges)
    types = [field.dataType for field in keys.schema["_order"].dataType.fields]
    listed = F.array(*[F.struct(*[F.lit(value).cast(t).alias(f"k{i}") for i, (value, t) in enumerate(zip(end, types))]) for end in ends])
    number = lambda place: _range_number(place, listed, len(ends))
    held = dict(keys.groupBy(number(F.col("_order")).alias("_range")).count().collect())
    reached = [0]
    for n in range(len(ends)):
        reached.append(reached[-1] + held.get(n, 0))
    ordered = df.repartitionById(len(reached), number(order)).sortWithinPartitions(*key)
    inside = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in reached]), F.spark_partition_id())
    return ordered.withColumn(out, offset + inside + 1)


def _range_ends(keys: DataFrame, rows: int, ranges: int) -> list:
    """At most ``ranges - 1`` drawn keys in ascending order; their number is bounded by the number of ranges."""
    if ranges < 2:
        return []
    share = min(1.0, ranges * KEYS_PER_RANGE / rows)
    drawn = keys.sample(share, 42).orderBy("_order").limit(2 * ranges * KEYS_PER_RANGE).collect()
    picked = [drawn[len(drawn) * i // ranges]["_order"] for i in range(1, ranges)] if drawn else []
    return [end for i, end in enumerate(picked) if i == 0 or end != picked[i - 1]]


def _range_number(key: Column, listed: Column, count: int) -> Column:
    """How many of the ``count`` ascending ends in ``listed`` do not lie behind ``key``: one comparison per halving."""
    if not count:
        return F.lit(0)
    number, step = F.lit(0), 1 << (count.bit_length() - 1)
    while step:
        number = F.transform(F.array(number), _reach(key, listed, step, count))[0]
        step //= 2
    return number


def _reach(key: Column, listed: Column, step: int, count: int):
    return lambda at: at + F.when((at + step <= count) & (key >= F.get(listed, at + step - 1)), step).otherwise(0)


# ---- order statistics -------------------------------------------------------------------------------

def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    slice_rows: int = SLICE_ROWS,
    accuracy: int = QUANTILE_ACCURACY,
) -> list[float]:
    """Exact quantiles of one column with linear interpolation between neighbours (NULLs ignored)."""
    return column_quantiles(df, {column: probabilities}, slice_rows, accuracy)[column]


def column_quantiles(
    df: DataFrame,
    wanted: dict[str, Sequence[float]],
    slice_rows: int = SLICE_ROWS,
    accuracy: int = QUANTILE_ACCURACY,
) -> dict[str, list[float]]:
    """Exact quantiles of several columns in one search: {column: probabilities} -> {column: values}.

    Three jobs whatever the number of ranks: sketches bracket all order statistics of all columns, one aggregate counts
    what lies below and on the bracket ends, and one grouped job looks into all open brackets. If they hold more than
    ``slice_rows`` values, the columns go through ``grouped_quantiles``, whose rounds narrow the brackets further.
    """
    names = list(wanted)
    rows = df.select(*[col(name).cast("double").alias(f"x{i}") for i, name in enumerate(names)])
    sketched = [
        f"struct(count(x{i}) AS n, min(x{i}) AS low, max(x{i}) AS high, "
        f"percentile_approx(x{i}, array({', '.join(map(repr, _near(wanted[name], accuracy)))}), {accuracy}) AS ends) AS s{i}"
        for i, name in enumerate(names)
    ]
    sketches = rows.agg(*map(F.expr, sketched)).first()
    empty = [name for i, name in enumerate(names) if not sketches[i]["n"]]
    if empty:
        raise ValueError(f"No values to take quantiles of in {empty}.")
    bounds = [sorted({s["low"], *s["ends"], s["high"]}) for s in sketches]
    placed = [
        f"array({', '.join(f'struct(count_if(x{i} < {_literal(b)}) AS below, count_if(x{i} = {_literal(b)}) AS here)' for b in ends)}) AS p{i}"
        for i, ends in enumerate(bounds)
    ]
    places = rows.agg(*map(F.expr, placed)).first()
    found: list[dict[int, float]] = [{} for _ in names]
    brackets: dict[tuple[int, int], list[int]] = {}
    for i, name in enumerate(names):
        for rank in {r for q in wanted[name] for r in _neighbours(sketches[i]["n"], q)}:
            at = max(j for j, place in enumerate(places[i]) if place["below"] <= rank)
            if rank < places[i][at]["below"] + places[i][at]["here"]:
                found[i][rank] = bounds[i][at]
            else:
                brackets.setdefault((i, at), []).append(rank)
    skipped = {(i, at): places[i][at]["below"] + places[i][at]["here"] for i, at in brackets}
    if sum(places[i][at + 1]["below"] - skipped[i, at] for i, at in brackets) > slice_rows:
        return _through_groups(rows, wanted, slice_rows, accuracy)
    if brackets:
        inside = " OR ".join(f"(of = {i} AND v > {_literal(bounds[i][at])} AND v < {_literal(bounds[i][at + 1])})" for i, at in brackets)
        cells = rows.selectExpr("inline(array(" + ", ".join(f"struct({i} AS of, x{i} AS v)" for i in range(len(names))) + "))")
        values = sorted(tuple(r) for r in cells.filter(inside).groupBy("of", "v").count().collect())
        for (i, at), ranks in brackets.items():
            reached, own = skipped[i, at], [(v, n) for of, v, n in values if of == i and bounds[i][at] < v < bounds[i][at + 1]]
            for v, n in own:
                found[i].update({rank: v for rank in ranks if reached <= rank < reached + n})
                reached += n
    return {
        name: [_between(*[found[i][r] for r in _neighbours(sketches[i]["n"], q)], (sketches[i]["n"] - 1) * q % 1) for q in wanted[name]]
        for i, name in enumerate(names)
    }


def _literal(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _neighbours(count: int, q: float) -> tuple[int, int]:
    """Zero-based ranks a quantile lies between."""
    spot = (count - 1) * q
    return math.floor(spot), math.ceil(spot)


def _between(low: float, high: float, share: float) -> float:
    return low if low == high else low + (high - low) * share


def _through_groups(rows: DataFrame, wanted: dict[str, Sequence[float]], slice_rows: int, accuracy: int) -> dict[str, list[float]]:
    """Columns as groups of one long column."""
    cells = rows.selectExpr("inline(array(" + ", ".join(f"struct({i} AS of, x{i} AS v)" for i in range(len(wanted))) + "))")
    every = sorted({q for qs in wanted.values() for q in qs})
    found = {r["of"]: dict(zip(every, r["values"])) for r in grouped_quantiles(cells, ["of"], "v", every, slice_rows, accuracy).collect()}
    return {name: [found[i][q] for q in wanted[name]] for i, name in enumerate(wanted)}


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    probabilities: Sequence[float],
    slice_rows: int = SLICE_ROWS,
    accuracy: int = QUANTILE_ACCURACY,
) -> DataFrame:
    """Exact quantiles per group: the ``by`` columns and ``values``, one per probability (NULLs ignored; a group
    without values is left out). Interpolated linearly between neighbours.

    All order statistics of all groups are searched together. A mergeable sketch brackets each of them, one counting
    pass tells how many values lie on and between the bracket ends, and only open brackets are looked at again, by
    the same step with evenly spaced marks; brackets of at most ``slice_rows`` values are ranked as distinct values.
    Each round leaves a small share of the rows, whatever the number of ranks; no group is sorted or collected.
    """
    # One struct as the key: its parts may be missing and still be joined on.
    keys = ["_by"]
    group = F.struct(*[col(name).alias(f"k{i}") for i, name in enumerate(by)]).alias("_by")
    rows = df.select(group, col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_bracket_columns(_near(probabilities, accuracy), accuracy))
    sizes = settle(sizes)
    asked = ", ".join(f"struct({i} AS at, {float(q)!r}D AS q)" for i, q in enumerate(probabilities))
    targets = sizes.selectExpr(*keys, f"explode(array({asked})) AS s", "_n").selectExpr(*keys, "s.at AS at", "(_n - 1) * s.q AS spot")
    ends = targets.selectExpr(*keys, "at", "spot - floor(spot) AS share", "explode(array(floor(spot), ceil(spot))) AS rank")
    found = _ranked_values(rows, keys, sizes, ends.select(*keys, "rank").distinct(), slice_rows, accuracy)
    # The neighbours of a spot, or one value for both.
    beside = ends.join(found, [*keys, "rank"]).groupBy(*keys, "at").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("share").alias("share"))
    value = F.expr("struct(at, IF(low = high, low, low + (high - low) * share) AS value)")
    listed = beside.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_all"))
    return listed.select(*[F.col("_by")[f"k{i}"].alias(name) for i, name in enumerate(by)], F.col("_all.value").alias("values"))


def _near(probabilities: Sequence[float], accuracy: int) -> list[float]:
    slack = 2.0 / accuracy
    return sorted({min(1.0, max(0.0, q + d)) for q in probabilities for d in (-slack, slack)})


def _bracket_columns(marks: Sequence[float], accuracy: int) -> list[Column]:
    """Ends of brackets in ascending order: minimum, the approximate percentiles at ``marks``, maximum."""
    return [F.min("v").alias("_lowest"), F.percentile_approx("v", list(marks), accuracy).alias("_ends"), F.max("v").alias("_highest")]


def _ranked_values(
    rows: DataFrame, keys: list[str], sizes: DataFrame, ranks: DataFrame, slice_rows: int, accuracy: int
) -> DataFrame:
    """(keys, rank, v): the value at each zero-based rank of its group.

    ``sizes`` has the group's row count and bracket ends; it decides which groups are ranked whole.
    """
    pieces = []
    counts = sizes.agg(F.count_if(F.col("_n") <= slice_rows), F.count_if(F.col("_n") > slice_rows), F.max(F.size("_ends"))).first()
    small, large, marks = counts
    if small:
        whole = rows if not large else attach(rows, sizes.filter(F.col("_n") <= slice_rows).select(*keys), keys, "left_semi")
        pieces.append(_direct(whole, keys, ranks))
    if large:
        names = [f"_e{i}" for i in range(marks + 2)]
        inner = [f"_ends[{i}] AS {name}" for i, name in enumerate(names[1:-1])]
        brackets = sizes.filter(F.col("_n") > slice_rows).selectExpr(*keys, "_lowest AS _e0", *inner, f"_highest AS {names[-1]}")
        lower = " + ".join(f"CAST(v > {e} AS INT)" for e in names)
        # Slot 2i: equal to the i-th end; 2i + 1: between the ends below and above.
        slot = f"IF({' OR '.join(f'v = {e}' for e in names)}, 2 * ({lower}), 2 * ({lower}) - 1) AS _slot"
        placed = attach(rows, brackets, keys, "inner").selectExpr(*keys, slot, "v")
        counted = placed.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_size"), F.min("v").alias("_one"))
        reached = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("_before", reached - F.col("_size"))
        inside = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_size"))
        hit = settle(ranks.join(counted, keys).filter(inside))
        settled = hit.filter("_slot % 2 = 0 OR _size = 1")
        pieces.append(settled.select(*keys, "rank", F.col("_one").alias("v")))
        open_ = hit.filter("_slot % 2 = 1 AND _size > 1")
        widest = open_.agg(F.max("_size")).first()[0]
        if widest:
            pieces.append(_inside_brackets(placed, keys, open_, widest, slice_rows, accuracy))
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionByName(piece)
    return result


def _inside_brackets(
    placed: DataFrame, keys: list[str], open_: DataFrame, widest: int, slice_rows: int, accuracy: int
) -> DataFrame:
    """The same search among the values inside open brackets, which are groups of their own there."""
    deeper = [*keys, "_slot"]
    names = {key: f"{key}_" for key in deeper}
    inner = list(names.values())
    left = attach(placed, open_.select(*deeper).distinct(), deeper, "left_semi").withColumnsRenamed(names)
    asked = open_.select(*[F.col(a).alias(b) for a, b in names.items()], (F.col("rank") - F.col("_before")).alias("rank")).distinct()
    if widest <= slice_rows:
        values = _direct(left, inner, asked)
    else:
        left = materialise(left)
        marks = [i / SPACED_MARKS for i in range(1, SPACED_MARKS)]
        sizes = materialise(left.groupBy(*inner).agg(F.count(F.lit(1)).alias("_n"), *_bracket_columns(marks, accuracy)))
        values = _ranked_values(left, inner, sizes, asked, slice_rows, accuracy)
    back = open_.withColumnsRenamed(names).withColumn("_rank", F.col("rank") - F.col("_before"))
    joined = back.join(values.withColumnRenamed("rank", "_rank"), [*inner, "_rank"])
    return joined.select(*[F.col(names[key]).alias(key) for key in keys], "rank", "v")


def _direct(rows: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """Ranks looked up among the distinct values of groups that are known to be small."""
    counted = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("_size"))
    reached = F.sum("_size").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("_until", reached)
    inside = (F.col("rank") < F.col("_until")) & (F.col("rank") >= F.col("_until") - F.col("_size"))
    return ranks.join(counted, keys).filter(inside).select(*keys, "rank", "v")
