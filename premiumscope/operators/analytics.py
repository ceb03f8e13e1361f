"""Error and impact analytics: the tables behind the error and counterfactual reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premiumscope.functions.numeric import EPS, col, dtype_of, is_finite, to_number
from premiumscope.operators.metrics import absolute_percentage_error
from premiumscope.operators.predicate import finite_rows
from premiumscope.operators.scale import column_quantiles, exact_quantiles, running_total
from premiumscope.spec import readable_columns

ABSOLUTE, PERCENT, SIGNED = "Absolute error", "Absolute percent error", "Signed error"
ERROR_MODES = (ABSOLUTE, PERCENT, SIGNED)
TAIL_PROBABILITIES = (0.90, 0.95, 0.99)
MIN_BINS, MAX_BINS = 15, 60


def _number(df: DataFrame, name: str) -> Column:
    return to_number(col(name), dtype_of(df, name))


# ---- row measures -----------------------------------------------------------------------------------

def error_rows(df: DataFrame, actual: str, predicted: str, mode: str = ABSOLUTE) -> DataFrame:
    """Add ``_Actual``, ``_Predicted``, ``_Metric`` and keep rows where all three are finite."""
    if mode not in ERROR_MODES:
        raise ValueError(f"errors are measured as {', '.join(ERROR_MODES)}, not as {mode!r}")
    measured = df.withColumns({"_Actual": _number(df, actual), "_Predicted": _number(df, predicted)})
    signed = F.col("_Predicted") - F.col("_Actual")
    metric = {
        ABSOLUTE: F.abs(signed),
        PERCENT: absolute_percentage_error(F.col("_Actual"), F.col("_Predicted")),
        SIGNED: signed,
    }[mode]
    return finite_rows(measured.withColumn("_Metric", metric), ["_Actual", "_Predicted", "_Metric"])


def zero_target_rows(df: DataFrame, actual: str) -> DataFrame:
    """Rows a percentage error leaves out because the actual value is zero or missing."""
    usable = F.coalesce(F.abs(_number(df, actual)) > EPS, F.lit(False))
    return df.agg(F.count_if(~usable).alias("excluded"))


def error_summary(errors: DataFrame) -> DataFrame:
    actual, predicted = F.col("_Actual"), F.col("_Predicted")
    return errors.agg(
        F.count(F.lit(1)).alias("policies"),
        F.avg(F.abs(actual - predicted)).alias("mae"),
        F.avg(absolute_percentage_error(actual, predicted)).alias("mape_percent"),
        F.avg("_Metric").alias("mean_measure"),
    )


def change_rows(df: DataFrame, baseline: str, counterfactual: str) -> DataFrame:
    """Add ``_Baseline``, ``_Counterfactual``, ``_Change``, ``_PercentChange``; the percentage is signed by
    the baseline and NULL where that is zero."""
    base, scenario = _number(df, baseline), _number(df, counterfactual)
    measured = df.withColumns({"_Baseline": base, "_Counterfactual": scenario}).withColumn(
        "_Change", F.col("_Counterfactual") - F.col("_Baseline")
    )
    percent = F.when(F.abs(F.col("_Baseline")) > EPS, F.col("_Change") / F.col("_Baseline") * 100)
    return finite_rows(
        measured.withColumn("_PercentChange", percent), ["_Baseline", "_Counterfactual", "_Change"]
    )


def measured_rows(changes: DataFrame, measure: str) -> DataFrame:
    return finite_rows(changes, [measure])


def unmeasured_count(changes: DataFrame, measure: str) -> DataFrame:
    """Rows the chosen measure is undefined for."""
    return changes.agg(F.count_if(~is_finite(col(measure))).alias("excluded"))


def impact_kpis(changes: DataFrame, measure: str = "_Change") -> DataFrame:
    """Portfolio totals, their change, mean policy changes, spread of the measure, share increased."""
    percent = F.when(is_finite(F.col("_PercentChange")), F.col("_PercentChange"))
    chosen = F.when(is_finite(col(measure)), col(measure))
    base, scenario = F.sum("_Baseline"), F.sum("_Counterfactual")
    return changes.agg(
        F.count(F.lit(1)).alias("policies"),
        base.alias("baseline_total"),
        scenario.alias("counterfactual_total"),
        (scenario - base).alias("portfolio_change"),
        F.when(F.abs(base) > EPS, (scenario - base) / base * 100).alias("portfolio_percent"),
        F.avg("_Change").alias("mean_change"),
        F.avg(percent).alias("mean_percent_change"),
        F.stddev_pop(chosen).alias("measure_std"),
        F.avg((F.col("_Change") > 0).cast("double")).alias("share_increased"),
    )


def component_contributions(df: DataFrame, components: Sequence[str]) -> DataFrame:
    """Mean signed change of every component that has both columns."""
    present = [c for c in components if {f"{c}_Baseline", f"{c}_Counterfactual"} <= set(df.columns)]
    if not present:
        return df.sparkSession.createDataFrame([], "component string, mean_change double")
    wide = df.agg(
        *[
            F.avg(_number(df, f"{c}_Counterfactual") - _number(df, f"{c}_Baseline")).alias(f"m{i}")
            for i, c in enumerate(present)
        ]
    )
    rows = [
        F.struct(F.lit(c).alias("component"), F.col(f"m{i}").alias("mean_change")) for i, c in enumerate(present)
    ]
    return wide.select(F.inline(F.array(*rows)))


# ---- distributions ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class CentralView:
    """Display bounds around the central share of a measure. ``lower``/``upper`` are padded if they meet;
    ``cut`` is the unpadded upper end that decides which rows are inside."""

    lower: float
    upper: float
    cut: float
    symmetric: bool

    def contains(self, value: Column) -> Column:
        return (F.abs(value) if self.symmetric else value) <= F.lit(self.cut)


def _close(a: float, b: float) -> bool:
    # Relative and absolute tolerance of the usual "is close" test.
    return abs(a - b) <= 1e-8 + 1e-5 * abs(b)


class ReportRanks:
    """Every order statistic a report shows, found in one search: of the measure (minimum, median, P90, P95) and of its
    size (the view's percentile and the tails; the size of a signed measure is its magnitude)."""

    def __init__(self, df: DataFrame, measure: str, percentile: float, symmetric: bool):
        self.share, self.symmetric = percentile / 100, symmetric
        shown, sizes = [0.0, 0.5, 0.90, 0.95], [self.share, *TAIL_PROBABILITIES]
        rows = df.select(col(measure).alias("value"), F.abs(col(measure)).alias("size"))
        wanted = {"value": shown, "size": sizes} if symmetric else {"value": [*shown, *sizes]}
        found = column_quantiles(rows, wanted)
        self.value = dict(zip(wanted["value"], found["value"]))
        self.size = dict(zip(sizes, found["size"])) if symmetric else self.value


def central_view(
    df: DataFrame, measure: str, percentile: float, symmetric: bool, ranks: ReportRanks | None = None
) -> CentralView:
    """Bounds of the central share: up to the percentile, from its mirror image for a signed measure, else from the
    minimum."""
    if ranks is not None:
        cut, lowest = ranks.size[ranks.share], ranks.value[0.0]
    else:
        size = df.select((F.abs(col(measure)) if symmetric else col(measure)).alias("v"))
        lowest, cut = exact_quantiles(size, "v", [0.0, percentile / 100])
    lower, upper = (-cut if symmetric else lowest), cut
    if _close(lower, upper):
        padding = max(abs(lower) * 0.05, 1.0)
        lower, upper = lower - padding, upper + padding
    return CentralView(lower, upper, cut, symmetric)


def outside_view(df: DataFrame, measure: str, view: CentralView) -> DataFrame:
    return df.agg(F.count_if(~view.contains(col(measure))).alias("outside_view"))


def tail_summary(
    df: DataFrame, measure: str, symmetric: bool, view: CentralView | None = None, ranks: ReportRanks | None = None
) -> DataFrame:
    """P90, P95, P99 and maximum (of magnitudes if signed), and rows outside the view."""
    value = F.abs(col(measure)) if symmetric else col(measure)
    sized = df.select(value.alias("v"), col(measure).alias("m"))
    p90, p95, p99 = [ranks.size[q] for q in TAIL_PROBABILITIES] if ranks else exact_quantiles(sized, "v", TAIL_PROBABILITIES)
    outside = F.count_if(~view.contains(F.col("m"))) if view else F.lit(0).cast("long")
    return sized.agg(
        F.lit(p90).alias("p90"),
        F.lit(p95).alias("p95"),
        F.lit(p99).alias("p99"),
        F.max("v").alias("maximum"),
        outside.alias("outside_view"),
    )


def bin_count(df: DataFrame, measure: str) -> DataFrame:
    """Freedman-Diaconis bin count held within 15 .. 60; 15 for fewer than two rows or a constant."""
    stats = df.agg(
        F.count(col(measure)).alias("n"), F.min(col(measure)).alias("low"), F.max(col(measure)).alias("high")
    )
    n, low, high = stats.first()
    if n < 2 or low == high:
        q25 = q75 = low or 0.0
    else:
        q25, q75 = exact_quantiles(df, measure, [0.25, 0.75])
    width = F.lit(2.0 * (q75 - q25)) / F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))
    suggested = F.ceil((F.col("high") - F.col("low")) / F.when(width > 0, width))
    bins = F.greatest(F.least(F.coalesce(suggested, F.lit(1)), F.lit(MAX_BINS)), F.lit(MIN_BINS))
    return stats.select(bins.cast("int").alias("bins"))


def histogram(df: DataFrame, measure: str, bins: int, lower: float, upper: float) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the bounds, empty bins included; the upper end belongs
    to the last bin. Rows outside the bounds are not counted."""
    if bins < 1 or not upper > lower:
        raise ValueError(f"{bins} bins from {lower} to {upper} make no histogram")
    value = col(measure)
    place = F.floor((value - F.lit(lower)) / F.lit(upper - lower) * F.lit(float(bins)))
    counts = (
        df.filter((value >= lower) & (value <= upper))
        .groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("policies"))
    )
    step = (upper - lower) / bins
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(lower) + F.col("id") * F.lit(step)).alias("bin_lower"),
        (F.lit(lower) + (F.col("id") + 1) * F.lit(step)).alias("bin_upper"),
    )
    return edges.join(F.broadcast(counts), "bin", "left").withColumn(
        "policies", F.coalesce("policies", F.lit(0).cast("long"))
    )


def histogram_references(df: DataFrame, measure: str, view: CentralView, ranks: ReportRanks | None = None) -> DataFrame:
    """Mean and median, clipped into the view and flagged when they lie outside of it."""
    median = ranks.value[0.5] if ranks else exact_quantiles(df, measure, [0.5])[0]
    wide = df.agg(F.avg(col(measure)).alias("mean"))
    rows = F.inline(
        F.array(
            F.struct(F.lit("Mean").alias("label"), F.col("mean").alias("value")),
            F.struct(F.lit("Median").alias("label"), F.lit(median).alias("value")),
        )
    )
    return clip_references(wide.select(rows), view)


def clip_references(references: DataFrame, view: CentralView) -> DataFrame:
    plotted = F.greatest(F.least(F.col("value"), F.lit(view.upper)), F.lit(view.lower))
    return references.withColumn("plotted", plotted).withColumn(
        "outside_view", F.col("plotted") != F.col("value")
    )


def empirical_cdf(df: DataFrame, measure: str, log_axis: bool = False) -> DataFrame:
    """One point per distinct value: rows at or below it and their share of all rows.

    With a log axis only positive values are kept, at their full-set shares; if there is none, the axis
    falls back to linear. Copies of a value collapse before the shuffle; the prefix sum runs over range
    partitions.
    """
    points = (
        df.select(col(measure).cast("double").alias("value"))
        .filter("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("policies"))
    )
    steps = running_total(points, ["value"], F.col("policies"), "cumulative")
    total = steps.agg(F.max("cumulative")).scalar()
    curve = steps.withColumn("share", F.col("cumulative") / total)
    if log_axis and not curve.filter("value > 0").isEmpty():
        return curve.filter("value > 0")
    return curve


def cdf_references(df: DataFrame, measure: str, ranks: ReportRanks | None = None) -> DataFrame:
    p90, p95 = [ranks.value[q] for q in (0.90, 0.95)] if ranks else exact_quantiles(df, measure, [0.90, 0.95])
    return df.sparkSession.createDataFrame([("P90", p90), ("P95", p95)], "label string, value double")


# ---- rankings ---------------------------------------------------------------------------------------

def deviation_from_mean(df: DataFrame, measure: str) -> DataFrame:
    """Add ``_deviation``: distance from the mean of the whole input (a scalar subquery)."""
    mean = df.agg(F.avg(col(measure)).alias("mean")).scalar()
    return df.withColumn("_deviation", F.abs(col(measure) - mean))


def furthest_from_mean(
    df: DataFrame,
    measure: str,
    rows: int,
    identity: str,
    extra: dict[str, str] | None = None,
    deviation_name: str = "Deviation from mean",
) -> DataFrame:
    """The ``rows`` policies furthest from the mean, readable columns first, then ``extra`` (output name ->
    source column) and the deviation. Ties are settled by identity. Runs as a per-task top-k, not a sort."""
    ranked = deviation_from_mean(df, measure).orderBy(F.desc("_deviation"), col(identity)).limit(rows)
    shown = readable_columns(df.columns, identity)
    return ranked.select(
        *[col(name) for name in shown],
        *[col(source).alias(name) for name, source in (extra or {}).items()],
        F.col("_deviation").alias(deviation_name),
    )


def normalised_scatter(df: DataFrame, identity: str, actual: str, predicted: str) -> DataFrame:
    """Actual and predicted, both divided by the mean actual."""
    mean = df.agg(F.avg(col(actual)).alias("mean")).scalar()
    return df.select(
        col(identity), (col(actual) / mean).alias("actual_norm"), (col(predicted) / mean).alias("predicted_norm")
    )


def error_histograms(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Two histograms of the absolute error: 30 bins over everything, 50 bins up to its P90."""
    errors = df.select(F.abs(col(actual) - col(predicted)).alias("e"))
    (p90,) = exact_quantiles(errors, "e", [0.90])
    e = F.col("e")
    low, high, zoomed = errors.agg(F.min(e), F.max(e), F.max(F.when(e <= p90, e))).first()

    def table(name: str, bins: int, top: float) -> DataFrame:
        ends = (low, top) if top > low else (low - 0.5, top + 0.5)
        return histogram(errors.filter(e <= top), "e", bins, *ends).withColumn("histogram", F.lit(name))

    return table("all", 30, high).unionByName(table("p90", 50, zoomed))
