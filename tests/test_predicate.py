import math
import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from premiumscope.functions.numeric import nan_to_null
from premiumscope.operators import predicate

ROWS = [
    (i, n, t)
    for i, (n, t) in enumerate(
        [(1.0, "X"), (2.0, "X"), (4.0, "Y"), (None, "X"), (6.0, None), (None, None), (2.0, "Z"), (-1.5, "Y")]
    )
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id int, n double, t string").cache()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def picked(frame, expression):
    return ids(predicate.select_rows(frame, expression))


def test_range_and_category(frame):
    both = {"all": [{"field": "n", "op": "between", "lower": 2, "upper": 5}, {"field": "t", "op": "eq", "value": "X"}]}
    assert picked(frame, both) == [1]
    assert picked(frame, None) == list(range(len(ROWS)))


@pytest.mark.parametrize(
    "expression, expected",
    [
        ({"field": "n", "op": "ne", "value": 2}, [0, 2, 3, 4, 5, 7]),
        ({"not": {"field": "n", "op": "gt", "value": 1.5}}, [0, 3, 5, 7]),
        ({"field": "n", "op": "eq", "value": None}, []),
        ({"field": "n", "op": "ne"}, list(range(8))),
        ({"field": "n", "op": "gt", "value": None}, []),
        ({"field": "n", "op": "eq", "value": "2"}, []),
        ({"field": "t", "op": "ne", "value": 2}, list(range(8))),
        ({"field": "n", "op": "in", "values": [2, None, "x"]}, [1, 6]),
        ({"field": "t", "op": "in", "values": ["Y", None]}, [2, 4, 5, 7]),
        ({"field": "t", "op": "not_in", "values": ["X"]}, [2, 4, 5, 6, 7]),
        ({"field": "n", "op": "in", "values": []}, []),
        ({"field": "n", "op": "not_in", "values": []}, list(range(8))),
        ({"field": "n", "op": "between", "lower": 1, "upper": 4, "inclusive": False}, [1, 6]),
        ({"field": "n", "op": "between", "lower": 1, "upper": 4, "inclusive": "left"}, [0, 1, 6]),
        ({"field": "n", "op": "between", "lower": 1, "upper": 4, "inclusive": "right"}, [1, 2, 6]),
        ({"field": "n", "op": "is_null"}, [3, 5]),
        ({"field": "n", "op": "not_null"}, [0, 1, 2, 4, 6, 7]),
    ],
)
def test_leaves(frame, expression, expected):
    assert picked(frame, expression) == expected


@pytest.mark.parametrize(
    "expression",
    [
        {"all": []},
        {"all": {}},
        {"all": [{"field": "n", "op": "is_null"}], "any": [{"field": "n", "op": "is_null"}]},
        {"not": [{"field": "n", "op": "is_null"}]},
        {"field": "zz", "op": "eq", "value": 1},
        {"field": "n"},
        {"field": "n", "op": "like", "value": 1},
        {"field": "n", "op": "in", "values": 1},
        {"field": "n", "op": "between", "lower": 1},
        {"field": "n", "op": "between", "lower": 1, "upper": 2, "inclusive": "sides"},
        {"field": "t", "op": "gt", "value": 1},
        {"field": "n", "op": "lt", "value": "a"},
    ],
)
def test_errors(frame, expression):
    with pytest.raises(ValueError):
        predicate.select_rows(frame, expression)


def test_all_problems_are_named_with_their_place(frame):
    bad = {"any": [{"field": "zz", "op": "eq", "value": 1}, {"not": {"all": [{"field": "n", "op": "lt", "value": "a"}, {"field": "t"}]}}]}
    with pytest.raises(ValueError) as error:
        predicate.select_rows(frame, bad)
    for place in ("selection.any[0].field", "selection.any[1].not.all[0]", "selection.any[1].not.all[1].op"):
        assert place in str(error.value)


def test_raw_columns_may_hold_nan(spark, tmp_path):
    rows = [(0, 1.0), (1, math.nan), (2, None), (3, 5.0), (4, -2.0)]
    path = str(tmp_path / "raw.parquet")
    spark.createDataFrame(rows, "id int, n double").write.parquet(path)
    raw = spark.read.parquet(path)
    clean = nan_to_null(raw)
    for expression in (
        {"field": "n", "op": "gt", "value": 0}, {"not": {"field": "n", "op": "gt", "value": 0}}, {"field": "n", "op": "is_null"},
        {"field": "n", "op": "not_null"}, {"field": "n", "op": "ne", "value": 1}, {"field": "n", "op": "not_in", "values": [5]},
        {"field": "n", "op": "between", "lower": -3, "upper": 2}, {"field": "n", "op": "eq", "value": math.nan},
    ):
        assert ids(predicate.select_raw_rows(raw, expression)) == ids(predicate.select_rows(clean, expression)), expression
    plan = predicate.select_raw_rows(raw, {"field": "n", "op": "gt", "value": 0})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,0.0)" in plan.split("PushedFilters")[1]


COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def plain(expression, row):
    """Two-valued reference evaluator."""
    if "all" in expression:
        return all(plain(e, row) for e in expression["all"])
    if "any" in expression:
        return any(plain(e, row) for e in expression["any"])
    if "not" in expression:
        return not plain(expression["not"], row)
    value, op = row[{"n": 1, "t": 2}[expression["field"]]], expression["op"]
    if op in ("is_null", "not_null"):
        return (value is None) == (op == "is_null")
    if value is None:
        return op == "ne"
    return COMPARE[op](value, expression["value"])


leaves = st.one_of(
    st.builds(
        lambda op, v: {"field": "n", "op": op, "value": v},
        st.sampled_from(sorted(COMPARE)),
        st.sampled_from([-1.5, 0, 1, 2, 2.0, 4, 7]),
    ),
    st.builds(lambda op, v: {"field": "t", "op": op, "value": v}, st.sampled_from(["eq", "ne", "gt", "lte"]), st.sampled_from("WXYZ")),
    st.builds(lambda f, op: {"field": f, "op": op}, st.sampled_from("nt"), st.sampled_from(["is_null", "not_null"])),
)
trees = st.recursive(
    leaves,
    lambda inner: st.one_of(
        st.builds(lambda xs: {"all": xs}, st.lists(inner, min_size=1, max_size=3)),
        st.builds(lambda xs: {"any": xs}, st.lists(inner, min_size=1, max_size=3)),
        st.builds(lambda x: {"not": x}, inner),
    ),
    max_leaves=6,
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch=st.lists(trees, min_size=8, max_size=8))
def test_any_expression_matches_the_plain_evaluator(frame, batch):
    flags = frame.select("id", *[predicate.compile_predicate(e, frame.schema).alias(f"p{i}") for i, e in enumerate(batch)])
    for row in flags.collect():
        for i, expression in enumerate(batch):
            assert row[f"p{i}"] is plain(expression, ROWS[row["id"]]), expression


def test_negated_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(ROWS, "id int, n double, t string").write.parquet(path)
    df = predicate.select_rows(spark.read.parquet(path), {"not": {"field": "n", "op": "gt", "value": 2}})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(n),LessThanOrEqual(n,2.0))]" in plan


def test_free_filter(frame):
    assert ids(predicate.free_filter(frame, "`n` >= 2 AND t IN ('X', 'Z')")) == [1, 6]
    assert len(ids(predicate.free_filter(frame, "  "))) == 8
    for bad in ("nope = 1", "n >="):
        with pytest.raises(ValueError, match="is no condition"):
            predicate.free_filter(frame, bad)


def test_portfolio_filter(spark):
    rows = [(1, "A", "B1", 1.0), (2, "A", "B2", 3.7), (3, "R", "B1", None), (4, "R", "B2", 9.0)]
    df = spark.createDataFrame(rows, "id int, Pol6TTaCod string, CoberturaLabel string, antig double")
    assert ids(predicate.portfolio_filter(df)) == [1, 2, 3, 4]
    assert ids(predicate.portfolio_filter(df, ["A"], (), (1, 3))) == [1]
    assert ids(predicate.portfolio_filter(df, (), ["B2"], (1, 9))) == [2, 4]
    assert tuple(predicate.age_bounds(df).first()) == (1, 9)


def test_finite_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.nan), (3, math.inf), (4, None)], "id int, v double")
    assert ids(predicate.finite_rows(df, ["v"])) == [1]
