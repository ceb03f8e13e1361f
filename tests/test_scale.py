import numpy as np
import pytest
from pyspark.sql import functions as F

from premiumscope.operators import scale


def test_exact_quantiles_match_numpy_on_every_path(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(2500, 0.25), np.round(rng.normal(size=2000), 1)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(4).cache()
    wanted = [0, 0.01, 0.25, 0.5, 0.66, 0.9, 0.995, 1]
    for slice_rows, accuracy in ((10**6, 10_000), (500, 200), (40, 60)):
        found = scale.exact_quantiles(df, "x", wanted, slice_rows, accuracy)
        np.testing.assert_allclose(found, np.quantile(values, wanted), rtol=0, atol=0)
    assert scale.exact_quantiles(df.limit(1).select(F.lit(2.0).alias("x")), "x", [0.1, 0.9]) == [2.0, 2.0]
    with pytest.raises(ValueError, match="No values"):
        scale.exact_quantiles(df.filter("x > 1e9"), "x", [0.5])


@pytest.mark.parametrize("slice_rows", [10**6, 20])
def test_quantiles_of_groups_and_of_columns_in_one_search(spark, slice_rows):
    rng = np.random.default_rng(8)
    groups = {"hot": rng.normal(size=4000), "flat": np.full(700, 3.5), None: rng.integers(0, 9, 900).astype(float), "one": np.array([1.25])}
    rows = [(g, float(v), float(v) * 2 - 1) for g, vs in groups.items() for v in vs] + [("empty", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    wanted = [0.0, 0.1, 0.5, 0.93, 1.0]
    found = {r["g"]: r["values"] for r in scale.grouped_quantiles(df, ["g"], "x", wanted, slice_rows, 50).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        np.testing.assert_allclose(found[g], np.quantile(vs, wanted), rtol=1e-15)
    every = np.concatenate(list(groups.values()))
    both = scale.column_quantiles(df, {"x": [0.25, 0.5], "y": [0.9]}, slice_rows, 50)
    np.testing.assert_allclose(both["x"], np.quantile(every, [0.25, 0.5]), rtol=1e-15)
    np.testing.assert_allclose(both["y"], np.quantile(every * 2 - 1, [0.9]), rtol=1e-15)


def test_number_of_searches_does_not_follow_the_number_of_ranks(spark, monkeypatch):
    df = spark.range(20_000).select((F.hash("id") % 100_000).cast("double").alias("x")).cache()
    written = []
    keep = scale.materialise
    monkeypatch.setattr(scale, "materialise", lambda rows: written.append(1) or keep(rows))
    rounds = []
    for wanted in ([0.5], [i / 40 for i in range(41)]):
        written.clear()
        scale.exact_quantiles(df, "x", wanted, 1000, 1000)
        rounds.append(len(written))
    assert rounds[0] == rounds[1] <= 4


def test_running_total_is_a_global_prefix_sum(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("w")).repartition(6)
    rows = scale.running_total(df, ["k"], F.col("w")).orderBy("k").collect()
    assert [r["_running"] for r in rows] == list(np.cumsum([r["w"] for r in rows]))
    ranks = scale.running_total(df, ["k"], out="rank").orderBy("k").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 1001))


@pytest.mark.parametrize("weight", [None, "w", "d"])
def test_running_total_moves_rows_once(spark, weight):
    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("k"), (F.col("id") % 5).alias("w"), (F.col("id") * 0.5).alias("d"))
    rows = scale.running_total(df.repartition(3), ["k"], F.col(weight) if weight else None, range_bytes=8_000).orderBy("k").collect()
    assert [r["_running"] for r in rows] == list(np.cumsum([r[weight] if weight else 1 for r in rows]))
    ranged = scale.ranged_totals(df.withColumn("_weight", F.lit(1)), ["k"], 7)
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    assert ranged.select("_range").distinct().count() == 7


@pytest.mark.parametrize("limit", [10**6, 0])
def test_attach_gives_the_same_rows_broadcast_or_spread(spark, limit):
    # One key holds most rows, one key has no match.
    big = spark.range(900).select(F.when(F.col("id") < 800, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k1", 3)], "k string, v int")
    joined = scale.attach(big, small, ["k"], max_rows=limit, key_rows=100)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (limit == 0)
    found = {r["k"]: (r["n"], r["v"]) for r in joined.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v")).collect()}
    assert found == {"hot": (800, 1), "k0": (33, 2), "k1": (33, 3), "k2": (34, None)}


def test_equal_rows_of_a_heavy_key_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v")).repartition(5)
        lookup = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        assert {r["_salts"] for r in scale.heavy_keys(same, ["k"], 100).collect()} == {21}
        joined = scale.spread_join(same, lookup, ["k"], key_rows=100)
        tasks = joined.filter("k = 7").groupBy(F.spark_partition_id().alias("t")).count().collect()
        assert sum(r["count"] for r in tasks) == 2001 and len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert joined.filter("w = 2 * k").count() == 6000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_materialised_table_has_no_lineage(spark):
    df = scale.materialise(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.agg(F.sum("x")).first()[0] == 90


def test_bounded_table(spark):
    assert scale.bounded_table(spark.range(11), 10) is None
    assert scale.bounded_table(spark.range(10), 10).num_rows == 10
    assert scale.bounded_table(spark.range(10), 10, max_bytes=1) is None
