"""Error report tables of a scored dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from premiumscope.functions.numeric import col
from premiumscope.operators import analytics
from premiumscope.operators.predicate import free_filter
from premiumscope.operators.scale import materialise
from premiumscope.spec import FINAL_TARGET_LABEL, IDENTITY_COLUMN, scored_targets


def error_report(
    scored: DataFrame,
    condition: str | None = "`Dataset Split` = 'test'",
    target: str = FINAL_TARGET_LABEL,
    mode: str = analytics.ABSOLUTE,
    percentile: float = 99.5,
    rows: int = 25,
    log_cdf: bool = True,
    identity: str = IDENTITY_COLUMN,
) -> dict[str, DataFrame]:
    """All tables of the error report. The measured rows are written once; every table reads that copy."""
    actual, predicted = scored_targets(scored.columns)[target]
    chosen = free_filter(scored, condition)
    errors = materialise(analytics.error_rows(chosen, actual, predicted, mode))
    if errors.isEmpty():
        raise ValueError(f"the selection {condition!r} leaves no row with a finite {mode!r} of {target!r}")
    symmetric = mode == analytics.SIGNED
    ranks = analytics.ReportRanks(errors, "_Metric", percentile, symmetric)
    view = analytics.central_view(errors, "_Metric", percentile, symmetric, ranks)
    central = errors.filter(view.contains(col("_Metric")))
    bins = analytics.bin_count(central, "_Metric").first()["bins"]
    tables = {
        "summary": analytics.error_summary(errors),
        "tails": analytics.tail_summary(errors, "_Metric", symmetric, view, ranks),
        "histogram": analytics.histogram(central, "_Metric", bins, view.lower, view.upper),
        "references": analytics.histogram_references(errors, "_Metric", view, ranks),
        "cdf": analytics.empirical_cdf(errors, "_Metric", log_axis=log_cdf and not symmetric),
        "cdf_references": analytics.cdf_references(errors, "_Metric", ranks),
        "furthest": analytics.furthest_from_mean(errors, "_Metric", rows, identity, {mode: "_Metric"}),
    }
    if mode == analytics.PERCENT:
        tables["excluded"] = analytics.zero_target_rows(chosen, actual)
    return tables
