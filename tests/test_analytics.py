import numpy as np
import pytest

from premiumscope.operators import analytics


def frame(spark, values):
    return spark.createDataFrame([(f"p{i}", float(v)) for i, v in enumerate(values)], "NroPoliza string, m double")


def test_change_rows(spark):
    df = spark.createDataFrame([(1, 100.0, 115.0), (2, 0.0, 5.0), (3, None, 1.0)], "NroPoliza int, b double, c double")
    rows = analytics.change_rows(df, "b", "c").orderBy("NroPoliza").collect()
    assert [r["_Change"] for r in rows] == [15.0, 5.0]
    assert rows[0]["_PercentChange"] == pytest.approx(15.0) and rows[1]["_PercentChange"] is None
    kpis = analytics.impact_kpis(analytics.change_rows(df, "b", "c"), "_PercentChange").first()
    assert (kpis["policies"], kpis["baseline_total"], kpis["portfolio_change"], kpis["share_increased"]) == (2, 100.0, 20.0, 1.0)
    assert kpis["portfolio_percent"] == pytest.approx(20.0) and kpis["measure_std"] == 0.0
    assert analytics.unmeasured_count(analytics.change_rows(df, "b", "c"), "_PercentChange").first()[0] == 1


def test_error_rows(spark):
    df = spark.createDataFrame([("a", 10.0, 12.0), ("b", 0.0, 1.0), ("c", None, 1.0), ("d", -4.0, -5.0)], "NroPoliza string, y double, p double")
    by = {mode: {r["NroPoliza"]: r["_Metric"] for r in analytics.error_rows(df, "y", "p", mode).collect()} for mode in analytics.ERROR_MODES}
    assert by[analytics.ABSOLUTE] == {"a": 2.0, "b": 1.0, "d": 1.0}
    assert by[analytics.PERCENT] == pytest.approx({"a": 20.0, "d": 25.0})
    assert by[analytics.SIGNED] == {"a": 2.0, "b": 1.0, "d": -1.0}
    assert analytics.zero_target_rows(df, "y").first()[0] == 2
    with pytest.raises(ValueError, match="errors are measured as"):
        analytics.error_rows(df, "y", "p", "other")


@pytest.mark.parametrize("values", [[5.0], [2.0] * 9, list(np.random.default_rng(0).normal(size=400)), [0.0] * 50 + [1.0]])
def test_bins_and_view(spark, values):
    df = frame(spark, values).cache()
    array = np.array(values)
    expected = 15 if len(array) < 2 or np.all(array == array[0]) else max(15, min(60, len(np.histogram_bin_edges(array, "fd")) - 1))
    assert analytics.bin_count(df, "m").first()["bins"] == expected
    view = analytics.central_view(df, "m", 90, symmetric=True)
    cut = np.percentile(np.abs(array), 90)
    if np.isclose(-cut, cut):
        padding = max(abs(-cut) * 0.05, 1.0)
        assert (view.lower, view.upper) == (-cut - padding, cut + padding)
    else:
        assert (view.lower, view.upper) == (-cut, cut)
    assert analytics.outside_view(df, "m", view).first()[0] == int((np.abs(array) > cut).sum())
    one_sided = analytics.central_view(df, "m", 90, symmetric=False)
    low, high = array.min(), np.percentile(array, 90)
    if not np.isclose(low, high):
        assert (one_sided.lower, one_sided.upper) == (low, high)
        inside = array[array <= high]
        counts = [r["policies"] for r in analytics.histogram(df, "m", 15, low, high).orderBy("bin").collect()]
        assert counts == list(np.histogram(inside, 15, (low, high))[0])


def test_empirical_cdf(spark):
    values = [3.0, -1.0, 2.0, 2.0, 0.0, 3.0, 3.0]
    df = frame(spark, values)
    curve = {r["value"]: r["share"] for r in analytics.empirical_cdf(df, "m").collect()}
    assert curve == pytest.approx({-1.0: 1 / 7, 0.0: 2 / 7, 2.0: 4 / 7, 3.0: 1.0})
    positive = analytics.empirical_cdf(df, "m", log_axis=True)
    assert {r["value"]: r["share"] for r in positive.collect()} == pytest.approx({2.0: 4 / 7, 3.0: 1.0})
    negative = analytics.empirical_cdf(frame(spark, [-2.0, -1.0]), "m", log_axis=True)
    assert negative.count() == 2
    refs = {r["label"]: r["value"] for r in analytics.cdf_references(df, "m").collect()}
    assert refs == pytest.approx({"P90": np.quantile(values, 0.9), "P95": np.quantile(values, 0.95)})


def test_furthest_from_mean_settles_ties(spark):
    df = frame(spark, [0.0, 10.0, 0.0, 10.0, 5.0])
    top = analytics.furthest_from_mean(df, "m", 3, "NroPoliza", {"Measure": "m"})
    assert [r["NroPoliza"] for r in top.collect()] == ["p0", "p1", "p2"]
    assert top.columns == ["NroPoliza", "m", "Measure", "Deviation from mean"]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_references_are_clipped(spark):
    df = frame(spark, [0.0, 0.0, 0.0, 100.0])
    view = analytics.CentralView(-10.0, 10.0, 10.0, True)
    rows = {r["label"]: (r["value"], r["plotted"], r["outside_view"]) for r in analytics.histogram_references(df, "m", view).collect()}
    assert rows == {"Mean": (25.0, 10.0, True), "Median": (0.0, 0.0, False)}


def test_error_histograms(spark):
    rng = np.random.default_rng(5)
    actual, predicted = rng.normal(10, 3, 300), rng.normal(10, 3, 300)
    df = spark.createDataFrame(list(zip(map(float, actual), map(float, predicted))), "y double, p double")
    errors = np.abs(actual - predicted)
    zoomed = errors[errors <= np.percentile(errors, 90)]
    found = {}
    for row in analytics.error_histograms(df, "y", "p").orderBy("bin").collect():
        found.setdefault(row["histogram"], []).append(row["policies"])
    assert found["all"] == list(np.histogram(errors, 30)[0]) and found["p90"] == list(np.histogram(zoomed, 50)[0])
