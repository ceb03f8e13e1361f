import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premiumscope.functions.labels import coverage_label, tag_tokens
from premiumscope.functions.numeric import nan_to_null, to_number
from premiumscope.operators import encode, scale
from premiumscope.plans.build import encode_portfolio


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, value) for i, value in enumerate(values)], f"i int, c {kind}")


def values(df, name="out"):
    return [row[name] for row in df.orderBy("i").collect()]


def test_tag_tokens(spark):
    cells = [None, "", ",", "16, 46", "16.0,x,,7", "7d", "-3", "inf", "007", "2.5", " a b , c ", "1e3", "-0"]
    out = column(spark, cells).select("i", tag_tokens(F.col("c")).alias("out"))
    assert values(out) == [
        [], [], [], ["16", "46"], ["16", "x", "7"], ["7d"], ["-3"], ["inf"], ["7"], ["2.5"], ["a b", "c"], ["1000"], ["0"],
    ]


def test_coverage_labels(spark):
    numbers = column(spark, [None, 1.0, 33.0, 34.0, 0.0, 2.5], "double")
    out = numbers.select("i", coverage_label(F.col("c"), T.DoubleType()).alias("out"))
    assert values(out) == ["Missing", "A", "D1", "34.0", "0.0", "2.5"]
    text = column(spark, [None, "1", "2.0", "B", "inf", "7d"])
    out = text.select("i", coverage_label(F.col("c"), T.StringType()).alias("out"))
    assert values(out) == ["Missing", "A", "A2", "B", "inf", "7d"]
    whole = column(spark, [None, 1, 40], "int")
    out = whole.select("i", coverage_label(F.col("c"), T.IntegerType()).alias("out"))
    assert values(out) == ["Missing", "A", "40"]


def test_text_to_number_guards_java_suffixes(spark):
    out = column(spark, [" 7 ", "1e3", "7f", "7d", "+5", "inf", "", None]).select(
        "i", to_number(F.col("c"), T.StringType()).alias("out")
    )
    assert values(out) == [7.0, 1000.0, None, None, 5.0, float("inf"), None, None]


def test_nan_becomes_null(spark):
    df = spark.sql("SELECT 1 AS i, CAST('NaN' AS DOUBLE) AS c, 2.0D AS d")
    assert nan_to_null(df).first() == (1, None, 2.0)


def test_numeric_like_columns(spark):
    df = spark.createDataFrame(
        [("1", "1", None, "x"), (" 2 ", "b", None, "1"), (None, "3", None, "2")],
        "good string, bad string, empty string, skip string",
    )
    assert encode.fit_numeric_like(df, ["skip"]) == ["good", "empty"]
    cast = encode.cast_numeric_like(df, ["good"])
    assert [row["good"] for row in cast.collect()] == [1.0, 2.0, None]
    assert encode.fit_numeric_like(df.select(F.lit(1).alias("n"))) == []


def test_vocabulary_order_and_multi_hot(spark):
    df = spark.createDataFrame([(1, "16, 2"), (2, "x, -3"), (3, None), (4, "2.0, 2.5")], "i int, Accesorios string")
    words = encode.fit_tags(df)
    assert words == ["2", "16", "-3", "2.5", "x"]
    hot = encode.multi_hot(df, words)
    assert hot.columns == ["i", *[f"Accesorios_{w}" for w in words]]
    assert [tuple(r)[1:] for r in hot.orderBy("i").collect()] == [
        (1, 1, 0, 0, 0), (0, 0, 1, 0, 1), (0, 0, 0, 0, 0), (1, 0, 0, 1, 0),
    ]
    assert encode.multi_hot(df.drop("Accesorios"), words).columns == ["i"]
    with pytest.raises(ValueError, match="too many"):
        encode.fit_tags(df, limit=3)


@pytest.mark.parametrize("limit", [256, 0])
def test_ordinal_codes(spark, limit):
    df = spark.createDataFrame(
        [(1, "b", True), (2, None, False), (3, "a", None), (4, "b", True), (5, "ñ", True)], "i int, c string, f boolean"
    )
    model = encode.fit_ordinal(df, encode.categorical_columns(df), inline_limit=limit)
    assert bool(model.tables) == (limit == 0)
    rows = encode.ordinal_codes(df, model).orderBy("i").collect()
    assert [(r["c"], r["f"]) for r in rows] == [(1, 1), (-1, 0), (0, -1), (1, 1), (2, 1)]


@pytest.mark.parametrize("wide", [0, 1000])
def test_dedupe_keeps_first_by_key(spark, monkeypatch, wide):
    monkeypatch.setattr(encode, "WIDE_BYTES", wide)
    rows = [("p3", 1.0, "a"), ("p1", 1.0, "a"), ("p2", 2.0, None), ("p4", 2.0, None), ("p5", -0.0, "z"), ("p6", 0.0, "z")]
    df = spark.createDataFrame(rows * 3, "NroPoliza string, v double, t string")
    kept = encode.drop_duplicates_keep_first(df, ["NroPoliza"])
    assert sorted(r["NroPoliza"] for r in kept.collect()) == ["p1", "p2", "p5"]
    assert kept.columns == df.columns


def test_dedupe_compares_whole_rows_only_where_a_fingerprint_repeats(spark, monkeypatch):
    monkeypatch.setattr(encode, "WIDE_BYTES", 0)
    rows = [(f"p{i}", i % 40, "x" if i % 3 else None) for i in range(200)] + [(f"u{i}", 1000 + i, "y") for i in range(50)]
    df = spark.createDataFrame(rows * 2, "id string, v int, t string").repartition(4)
    kept = encode.drop_duplicates_keep_first(df, ["id"])
    first = {}
    for i, *rest in sorted(rows):
        first.setdefault(tuple(rest), i)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(i, *rest) for rest, i in first.items()], key=str)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan
    unique = df.dropDuplicates()
    assert encode.drop_duplicates_keep_first(unique.filter("v >= 1000"), ["id"]).count() == 50


def test_wide_rows_with_many_copies_move_once(spark, monkeypatch):
    monkeypatch.setattr(encode, "WIDE_BYTES", 0)
    monkeypatch.setattr(encode, "bounded_table", lambda *arguments: None)
    monkeypatch.setattr(scale, "LOOKUP_MAX_ROWS", 0)
    df = spark.range(600).selectExpr("concat('p', id) AS id", "IF(id % 7 = 0, NULL, CAST(id % 90 AS DOUBLE)) AS v", "concat('t', id % 4) AS t")
    kept = encode.drop_duplicates_keep_first(df, ["id"])
    first = {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        first.setdefault((r["v"], r["t"]), r["id"])
    assert {(r["v"], r["t"]): r["id"] for r in kept.collect()} == first and kept.count() == len(first)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_rows_with_one_fingerprint_that_differ_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(encode, "WIDE_BYTES", 0)
    monkeypatch.setattr(encode.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), ("d", None)], "id string, v int")
    kept = encode.drop_duplicates_keep_first(df, ["id"]).collect()
    assert sorted(map(tuple, kept)) == [("a", 1), ("c", 2), ("d", None)]


def test_numbers_of_tags_and_pairs_beyond_the_columns_of_a_plan(spark):
    n = encode.MAX_ENCODED_COLUMNS + 1
    raw = spark.range(n).selectExpr(
        "concat('P', id) AS NroPoliza", "concat('T', id) AS Pol6TTaCod", "CAST(1 AS INT) AS Cobertura",
        "concat(id, ', common, ', id, ',', id % 7) AS Accesorios", "CAST(id AS DOUBLE) AS PrimaRC", "CAST(id AS DOUBLE) AS Prima",
    )
    built = encode_portfolio(raw)
    assert built.tags == built.pairs == []
    assert set(built.data.columns) == {
        "NroPoliza", "Pol6TTaCod", "CoberturaLabel", encode.TAG_POSITIONS, encode.PAIR_POSITION, "PrimaRC", "Prima"
    }
    rows = built.with_vectors().orderBy("PrimaRC").collect()
    # Digits by value come first, so tag i has the number i; "common" is the last.
    pairs = {f"T{i}__A": k for k, i in enumerate(sorted(range(n), key=lambda i: f"T{i}__A"))}
    assert len(rows) == n
    for i in (0, 3, 7, 8, 4321, n - 1):
        vector = rows[i]["features"]
        assert vector.size == 2 * n + 1
        assert list(vector.indices) == sorted({i, i % 7, n}) + [n + 1 + pairs[f"T{i}__A"]] and set(vector.values) == {1.0}
    plan = built.data._jdf.queryExecution().optimizedPlan().toString()
    assert "Accesorios_5" not in plan and "TariffCoverage_T5" not in plan


def test_tag_positions_of_missing_and_unknown_tags(spark):
    df = spark.createDataFrame([(1, "16, 2"), (2, "x, 016, x"), (3, None), (4, " , ")], "i int, Accesorios string")
    known = encode.fit_tag_dictionary(df)
    assert {r["value"]: r["number"] for r in known.collect()} == {t: i for i, t in enumerate(encode.fit_tags(df))}
    found = encode.tag_positions(df.union(spark.createDataFrame([(5, "2, new")], df.schema)), known)
    rows = {r["i"]: r[encode.TAG_POSITIONS] for r in found.collect()}
    assert rows == {1: [0, 1], 2: [1, 2], 3: [], 4: [], 5: [0]}


def test_unused_columns(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "`TariffCoverage_X__A.1` int, b int")
    assert encode.unused_columns(df, df.columns) == ["b"]


def test_portfolio_encoding(spark):
    raw = spark.createDataFrame(
        [
            ("P1", "X", 1, "16, 2", "7", "rojo", 10.0, 100.0, 20.0, 120.0),
            ("P2", "X", 2, None, "8", None, None, 110.0, 25.0, 135.0),
            ("P3", "Y", 1, "x", None, "azul", 30.0, 120.0, 30.0, 150.0),
            ("P4", "Y", 1, "x", None, "azul", 30.0, 120.0, 30.0, 150.0),
            ("P5", "Y", None, "x", None, "azul", 30.0, 120.0, None, 150.0),
        ],
        "NroPoliza string, Pol6TTaCod string, Cobertura int, Accesorios string, Puertas string, Color string, "
        "Feature double, PrimaRC double, PrimaCasco double, Prima double",
    )
    built = encode_portfolio(raw, drop=["Missing", "Prima"])
    assert built.components == ["PrimaRC", "PrimaCasco"] and built.reporting == ["CoberturaLabel", "Pol6TTaCod"]
    assert {c for c in built.data.columns if c.startswith("TariffCoverage_")} == {
        "TariffCoverage_X__A", "TariffCoverage_X__A2", "TariffCoverage_Y__A",
    }
    assert built.data.columns[-3:] == ["PrimaRC", "PrimaCasco", "Prima"]
    rows = {r["NroPoliza"]: r for r in built.data.collect()}
    assert set(rows) == {"P1", "P2", "P3"}
    assert (rows["P2"]["Feature"], rows["P2"]["Color"], rows["P3"]["Color"]) == (0.0, -1, 0)
    assert (rows["P1"]["Puertas"], rows["P3"]["Puertas"]) == (7.0, 0.0)
    record = built.metadata()
    assert (record["duplicate_rows_removed"], record["row_count"], record["dropped_columns"]) == (1, 3, [])


def test_duplicates_differ_in_order_columns(spark):
    df = spark.createDataFrame([("p1", "a", 1), ("p2", "a", 2), ("p3", "a", 2)], "id string, x string, seq int")
    kept = encode.drop_duplicates_keep_first(df, ["id"], ["seq", "id"])
    assert sorted(map(tuple, kept.collect())) == [("p1", "a", 1), ("p2", "a", 2)]
    alone = encode.drop_duplicates_keep_first(df, ["id"], ["seq", "id"], helpers=["seq"])
    assert [tuple(r) for r in alone.collect()] == [("p1", "a", 1)]
