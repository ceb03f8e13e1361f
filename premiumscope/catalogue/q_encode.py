"""Projections, schema operators and encoders."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.catalogue import views as v
from premiumscope.catalogue.registry import query, rounded
from premiumscope.catalogue.sql import COMPONENTS, r, sql
from premiumscope.functions.labels import tag_tokens
from premiumscope.functions.numeric import col, total_of
from premiumscope.operators import encode
from premiumscope.operators.scale import materialise
from premiumscope.operators.scaling import fit_scaling
from premiumscope.operators.validate import training_frame
from premiumscope.plans.build import encode_portfolio
from premiumscope.spec import (
    droppable_columns,
    identity_first,
    infer_components,
    infer_total_target,
    readable_columns,
    scenario_targets,
    scored_targets,
)


@query("P1_total_target", sql(f"SELECT 'Prima' AS target, {r('sum(Prima)', 'total', 2)} FROM portfolio"))
def total_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir)
    target = infer_total_target(df.columns)
    return rounded(df.agg(F.lit(target).alias("target"), F.sum(col(target)).alias("total")), 2)


@query(
    "P2_component_targets",
    sql(" UNION ALL ".join(f"SELECT '{c}' AS target, {r(f'sum({c})', 'total', 2)} FROM portfolio" for c in COMPONENTS)),
)
def component_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir)
    names = infer_components(df.columns, infer_total_target(df.columns))
    wide = df.agg(*[F.struct(F.lit(n).alias("target"), F.sum(col(n)).alias("total")).alias(n) for n in names])
    return rounded(wide.select(F.inline(F.array(*names))), 2)


@query("P3_drop_columns", sql("SELECT * EXCLUDE (Marca, Accesorios) FROM portfolio"))
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir)
    asked = ["Marca", "Prima", "Accesorios", "NotThere", "Marca"]
    return df.drop(*droppable_columns(df.columns, asked, v.SPEC.targets))


@query("P4_rows_with_targets", sql("SELECT NroPoliza, PrimaAccesorio, Prima FROM portfolio WHERE PrimaAccesorio >= 0"))
def rows_with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).withColumn("PrimaAccesorio", F.expr("nullif(PrimaAccesorio, -1D)"))
    return encode.drop_rows_without_targets(df, v.SPEC.targets).select("NroPoliza", "PrimaAccesorio", "Prima")


@query("P5_coverage_label", sql("SELECT NroPoliza, CoberturaLabel FROM labelled"))
def coverage_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.add_coverage_label(v.portfolio(spark, sf_dir)).select("NroPoliza", "CoberturaLabel")


@query("P6_text_label", sql("SELECT NroPoliza, coalesce(Accesorios, 'Missing') AS Accesorios FROM portfolio"))
def text_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.fill_label(v.portfolio(spark, sf_dir), "Accesorios").select("NroPoliza", "Accesorios")


TEXT_COLUMNS = ("NroPoliza", "Pol6TTaCod", "Accesorios", "ModoFacturacion", "Marca")


@query(
    "P7_numeric_like",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS present, count(TRY_CAST({c} AS DOUBLE)) AS parsed FROM portfolio"
            for c in TEXT_COLUMNS
        )
    ),
)
def numeric_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.numeric_like_counts(v.portfolio(spark, sf_dir))


@query(
    "P7_numeric_like_cast",
    sql("SELECT NroPoliza, CAST(ModoFacturacion AS DOUBLE) AS ModoFacturacion, Marca FROM portfolio"),
)
def numeric_like_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("NroPoliza", "ModoFacturacion", "Marca")
    return encode.cast_numeric_like(df, encode.fit_numeric_like(df))


@query(
    "P8_fill_features",
    sql("SELECT NroPoliza, coalesce(Cobertura, 0) AS Cobertura, coalesce(FactorCasco, 0) AS FactorCasco, Prima FROM portfolio"),
)
def fill_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("NroPoliza", "Cobertura", "FactorCasco", "Prima")
    return encode.fill_features(df, ["Prima"])


@query(
    "P9_feature_order",
    sql("""SELECT u.NroPoliza, u.position, u.name FROM (
             SELECT NroPoliza, unnest([1, 2, 3, 4]) AS position,
                    unnest(['NroPoliza', 'Marca', 'PrimaRC', 'Prima']) AS name FROM portfolio) u"""),
)
def feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("Prima", "NroPoliza", "PrimaRC", "Marca")
    names = encode.features_then_targets(df, ["PrimaRC", "Prima"]).columns
    listed = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("position", "name")
    return df.select("NroPoliza", listed).withColumn("position", F.col("position") + 1)


@query(
    "P10_all_numbers",
    sql("""SELECT NroPoliza, CAST(Cobertura AS DOUBLE) AS Cobertura, CAST(ModoFacturacion AS DOUBLE) AS ModoFacturacion,
                  CAST(NULL AS DOUBLE) AS Marca, Prima FROM portfolio"""),
)
def all_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("NroPoliza", "Cobertura", "ModoFacturacion", "Marca", "Prima")
    return encode.coerce_all_numeric(df, keep=["NroPoliza"])


@query(
    "P11_training_rows",
    sql(f"""SELECT NroPoliza, CAST(antig AS DOUBLE) AS antig, FactorCasco, {", ".join(COMPONENTS)}, Prima
            FROM numeric_clean"""),
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.numeric_clean(spark, sf_dir).select("NroPoliza", "antig", "FactorCasco", *v.SPEC.targets)
    rows, features = training_frame(df, v.COMPONENTS, v.TOTAL, [v.ID])
    return rows.select("NroPoliza", *features, *v.SPEC.targets)


@query(
    "P13_readable_columns",
    sql(f"""SELECT NroPoliza, antig, TasaCasco, {r('TasaCasco_Counterfactual', 'TasaCasco_Counterfactual')}, Pol6TTaCod, CoberturaLabel,
                   {r('Prima_Baseline', 'Prima_Baseline')} FROM counterfactual"""),
)
def readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = v.counterfactual(spark, sf_dir)
    shown = readable_columns(table.select(
        "NroPoliza", "antig", "TasaCasco", "TasaCasco_Counterfactual", "Pol6TTaCod", "CoberturaLabel", "Prima_Baseline",
        F.lit(1).alias("Accesorios_16"), F.lit(1).alias("_hidden"), F.lit(1).alias("MarcaEncoded"),
    ).columns)
    return rounded(table.select(*[col(n) for n in shown]))


@query(
    "P14_error_targets",
    sql(
        " UNION ALL ".join(
            f"SELECT '{label}' AS target, {r(f'avg(abs({a} - {p}))', 'mae', 4)} FROM scored"
            for label, a, p in [("Final Prima", "Prima", "Prediction")]
            + [(c, c, f'"{c} Prediction"') for c in COMPONENTS]
        )
    ),
)
def error_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.scored(spark, sf_dir)
    pairs = scored_targets(df.columns)
    wide = df.agg(
        *[
            F.struct(F.lit(label).alias("target"), F.avg(F.abs(col(a) - col(p))).alias("mae")).alias(f"t{i}")
            for i, (label, (a, p)) in enumerate(pairs.items())
        ]
    )
    return rounded(wide.select(F.inline(F.array(*[F.col(f"t{i}") for i in range(len(pairs))]))), 4)


@query(
    "P15_impact_targets",
    sql(
        " UNION ALL ".join(
            f"SELECT '{label}' AS target, {r(f'sum({c}_Counterfactual - {c}_Baseline)', 'change', 2)} FROM counterfactual"
            for label, c in [("Final Prima", "Prima")] + [(c, c) for c in COMPONENTS]
        )
    ),
)
def impact_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.counterfactual(spark, sf_dir)
    pairs = scenario_targets(df.columns)
    wide = df.agg(
        *[
            F.struct(F.lit(label).alias("target"), F.sum(col(c) - col(b)).alias("change")).alias(f"t{i}")
            for i, (label, (b, c)) in enumerate(pairs.items())
        ]
    )
    return rounded(wide.select(F.inline(F.array(*[F.col(f"t{i}") for i in range(len(pairs))]))), 2)


@query("P16_identity_first", sql("SELECT NroPoliza, 'NroPoliza' AS first_column, Prima FROM portfolio"))
def id_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("Prima", "NroPoliza")
    names = identity_first(df.columns)
    return df.select(*names, F.lit(names[0]).alias("first_column"))


@query("P17_identity_text", "SELECT CAST(l_orderkey AS VARCHAR) AS NroPoliza, l_extendedprice AS Prima FROM lineitem")
def identity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = v.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS NroPoliza", "l_extendedprice AS Prima")
    return encode_portfolio(raw, dedupe=False).data


NARROW = ("NroPoliza", "Pol6TTaCod", "Cobertura", "antig", "TasaCasco", "PrimaCasco", "Prima")
NARROW_SQL = """SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, antig, TasaCasco FROM labelled"""


@query(
    "D1_dedupe_keep_first",
    sql(f"""SELECT * EXCLUDE (place) FROM (
              SELECT *, row_number() OVER (PARTITION BY Pol6TTaCod, CoberturaLabel, antig, TasaCasco ORDER BY NroPoliza) AS place
              FROM ({NARROW_SQL})) WHERE place = 1"""),
)
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.labelled(spark, sf_dir).select("NroPoliza", "Pol6TTaCod", "CoberturaLabel", "antig", "TasaCasco")
    return encode.drop_duplicates_keep_first(rows, ["NroPoliza"])


WIDE = """
copied AS (
  SELECT * FROM labelled UNION ALL SELECT * REPLACE ('copy-' || NroPoliza AS NroPoliza) FROM labelled WHERE antig % 2 = 0
  UNION ALL SELECT * REPLACE ('again-' || NroPoliza AS NroPoliza) FROM labelled WHERE antig % 6 = 0
)"""


@query(
    "D1_dedupe_wide",
    sql("""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY COLUMNS(* EXCLUDE (NroPoliza)) ORDER BY NroPoliza) AS place
           FROM copied) WHERE place = 1""".replace("COLUMNS(* EXCLUDE (NroPoliza))", ", ".join(
        ["Accesorios", "antig", "TasaCasco", "FactorCasco", "SumaAsegurada", "ModoFacturacion", "Marca", "PrimaRC", "PrimaCasco",
         "PrimaClausulaAjuste", "PrimaAccesorio", "Prima", "Pol6TTaCod", "CoberturaLabel"])), WIDE),
)
def dedupe_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column compared, over rows of which half have one copy under another id and some have two."""
    labelled = rows = materialise(v.labelled(spark, sf_dir), codec="zstd")
    for prefix, chosen in (("copy-", "antig % 2 = 0"), ("again-", "antig % 6 = 0")):
        copies = labelled.filter(chosen).withColumn("NroPoliza", F.concat(F.lit(prefix), "NroPoliza"))
        rows = rows.unionByName(copies)
    return encode.drop_duplicates_keep_first(rows, ["NroPoliza"])


@query(
    "P18_build_metadata",
    sql("""SELECT 'Prima' AS target_column, count(*) AS row_count,
                  (SELECT count(*) FROM portfolio) - count(*) AS duplicate_rows_removed
           FROM (SELECT DISTINCT antig, TasaCasco, Pol6TTaCod, CoberturaLabel, PrimaCasco, Prima
                 FROM labelled)"""),
)
def build_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = encode_portfolio(v.portfolio(spark, sf_dir).select(*NARROW)).metadata()
    names = ["target_column", "row_count", "duplicate_rows_removed"]
    return spark.createDataFrame([tuple(built[n] for n in names)], "target_column string, row_count long, duplicate_rows_removed long")


# ---- encoders ---------------------------------------------------------------------------------------

TOKENS = """
cells AS (SELECT NroPoliza, unnest(string_split(coalesce(Accesorios, ''), ',')) AS raw FROM portfolio),
tokens AS (
  SELECT NroPoliza, CASE WHEN regexp_full_match(trim(raw), '[0-9]+[.]0') THEN split_part(trim(raw), '.', 1) ELSE trim(raw) END AS tag
  FROM cells WHERE trim(raw) <> ''
)"""


@query(
    "E1_tag_tokens",
    sql("""SELECT p.NroPoliza, coalesce(t.tags, '') AS tags, coalesce(t.n, 0) AS n FROM portfolio p LEFT JOIN (
             SELECT NroPoliza, string_agg(tag, '|' ORDER BY tag) AS tags, count(*) AS n FROM tokens GROUP BY NroPoliza) t
           USING (NroPoliza)""", TOKENS),
)
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = v.portfolio(spark, sf_dir).select("NroPoliza", tag_tokens(col("Accesorios")).alias("t"))
    return tags.select(
        "NroPoliza", F.concat_ws("|", F.array_sort("t")).alias("tags"), F.size("t").cast("long").alias("n")
    )


@query(
    "E2_tag_vocabulary",
    sql("""SELECT tag, row_number() OVER (ORDER BY TRY_CAST(tag AS BIGINT) IS NULL, TRY_CAST(tag AS BIGINT), tag) AS position
           FROM (SELECT DISTINCT tag FROM tokens)""", TOKENS),
)
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = encode.fit_tags(v.portfolio(spark, sf_dir))
    return spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "tag string, position long")


@query("E3_multi_hot", sql("SELECT DISTINCT NroPoliza, 'Accesorios_' || tag AS name FROM tokens", TOKENS))
def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("NroPoliza", "Accesorios")
    return v.hot_names(encode.multi_hot(df, encode.fit_tags(df)), "Accesorios_")


@query("E3_tag_rows", sql("SELECT DISTINCT NroPoliza, tag FROM tokens", TOKENS))
def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.tag_rows(v.portfolio(spark, sf_dir), "NroPoliza")


@query(
    "E4_pair_one_hot",
    sql("SELECT NroPoliza, 'TariffCoverage_' || Pol6TTaCod || '__' || CoberturaLabel AS name FROM labelled"),
)
def pair_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.labelled(spark, sf_dir).select("NroPoliza", "Pol6TTaCod", "CoberturaLabel")
    return v.hot_names(encode.pair_one_hot(df, encode.fit_pairs(df)), "TariffCoverage_")


@query(
    "E5_ordinal_codes",
    sql("""SELECT NroPoliza, CAST(m.code AS INTEGER) AS Marca, CAST(c.code AS INTEGER) AS ModoFacturacion FROM portfolio p
           JOIN (SELECT Marca, dense_rank() OVER (ORDER BY Marca) - 1 AS code FROM (SELECT DISTINCT Marca FROM portfolio)) m USING (Marca)
           JOIN (SELECT ModoFacturacion, dense_rank() OVER (ORDER BY ModoFacturacion) - 1 AS code
                 FROM (SELECT DISTINCT ModoFacturacion FROM portfolio)) c USING (ModoFacturacion)"""),
)
def ordinal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("NroPoliza", "Marca", "ModoFacturacion")
    return encode.ordinal_codes(df, encode.fit_ordinal(df, ["Marca", "ModoFacturacion"]))


@query(
    "E5_large_dictionary",
    sql("""SELECT NroPoliza, CAST(coalesce(d.code, -1) AS BIGINT) AS Accesorios FROM portfolio p LEFT JOIN (
             SELECT Accesorios, row_number() OVER (ORDER BY Accesorios) - 1 AS code
             FROM (SELECT DISTINCT Accesorios FROM portfolio WHERE Accesorios IS NOT NULL)) d USING (Accesorios)"""),
)
def large_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("NroPoliza", "Accesorios")
    return encode.ordinal_codes(df, encode.fit_ordinal(df, ["Accesorios"], inline_limit=4))


@query(
    "E6_unused_pairs",
    sql("""SELECT 'TariffCoverage_' || Pol6TTaCod || '__' || CoberturaLabel AS name FROM (
             SELECT DISTINCT Pol6TTaCod, CoberturaLabel FROM labelled
             EXCEPT SELECT Pol6TTaCod, CoberturaLabel FROM eligible WHERE eligible >= 300)"""),
)
def unused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.labelled(spark, sf_dir)
    encoded = encode.pair_one_hot(df, encode.fit_pairs(df))
    clean = v.triage(encoded, v.COMPONENTS, v.TOTAL, min_pair_count=300).clean
    pairs = [n for n in clean.columns if n.startswith("TariffCoverage_")]
    return spark.createDataFrame([(n,) for n in encode.unused_columns(clean, pairs)], "name string")



def _scaled(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    names = ["SumaAsegurada", "antig"]
    df = materialise(v.numeric_clean(spark, sf_dir).select("NroPoliza", *names).withColumn("constant", F.lit(3.5)))
    return rounded(fit_scaling(df, [*names, "constant"], kind).apply(df), 5)


def _scaled_sql(centre: str, spread: str) -> str:
    columns = ", ".join(r(f"(CAST({c} AS DOUBLE) - {centre.format(c)}) / ({spread.format(c)})", c, 5) for c in ("SumaAsegurada", "antig"))
    return sql(f"SELECT NroPoliza, {columns}, 0::DOUBLE AS constant FROM numeric_clean")


@query("E7_minmax_features", _scaled_sql("min({0}) OVER ()", "max({0}) OVER () - min({0}) OVER ()"))
def minmax_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "minmax")


@query("E7_standard_features", _scaled_sql("avg({0}) OVER ()", "stddev_pop({0}) OVER ()"))
def standard_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "standard")


@query("E7_robust_features", _scaled_sql(
    "(SELECT quantile_cont({0}, 0.5) FROM numeric_clean)",
    "(SELECT quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) FROM numeric_clean)",
))
def robust_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "robust")


@query(
    "J6_encodings_beside_rows",
    sql("""SELECT p.NroPoliza, coalesce(t.n, 0) AS tags, p.Prima FROM portfolio p LEFT JOIN
           (SELECT NroPoliza, CAST(count(DISTINCT tag) AS INTEGER) AS n FROM tokens GROUP BY NroPoliza) t USING (NroPoliza)""", TOKENS),
)
def encodings_beside_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.portfolio(spark, sf_dir).select("NroPoliza", "Accesorios", "Prima")
    wide = encode.multi_hot(df, encode.fit_tags(df))
    flags = [col(n) for n in wide.columns if n.startswith("Accesorios_")]
    return wide.select("NroPoliza", total_of(flags).alias("tags"), "Prima")


ENCODED = """
marks AS (
  SELECT DISTINCT NroPoliza, 'Accesorios_' || tag AS name FROM tokens
  UNION ALL SELECT NroPoliza, 'TariffCoverage_' || Pol6TTaCod || '__' || CoberturaLabel FROM labelled
),
brands AS (SELECT Marca, dense_rank() OVER (ORDER BY Marca) - 1 AS code FROM (SELECT DISTINCT Marca FROM portfolio))"""


@query(
    "P_encoded_dataset",
    sql("""SELECT NroPoliza, Pol6TTaCod, CoberturaLabel, antig, TasaCasco, coalesce(FactorCasco, 0) AS FactorCasco, SumaAsegurada,
                  CAST(ModoFacturacion AS DOUBLE) AS ModoFacturacion, CAST(code AS INTEGER) AS Marca, PrimaRC, PrimaCasco,
                  PrimaClausulaAjuste, PrimaAccesorio, Prima, h.hot
           FROM labelled JOIN brands USING (Marca)
           JOIN (SELECT NroPoliza, string_agg(name, '|' ORDER BY name) AS hot FROM marks GROUP BY NroPoliza) h USING (NroPoliza)""", TOKENS, ENCODED),
)
def encoded_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole encoder chain over all columns, with the 0/1 columns that are set listed by name; rows are unique here."""
    data = encode_portfolio(materialise(v.portfolio(spark, sf_dir))).data
    marks = [name for name in data.columns if name.startswith(("Accesorios_", "TariffCoverage_"))]
    named = F.array(*[F.when(col(name) == 1, F.lit(name)) for name in marks])
    hot = F.array_join(F.array_sort(F.array_compact(named)), "|").alias("hot")
    return data.select(*[col(name) for name in data.columns if name not in set(marks)], hot)


@query(
    "E3_sparse",
    sql("""SELECT NroPoliza, CAST((SELECT count(*) FROM tag_numbers) + (SELECT count(*) FROM pair_numbers) AS INTEGER) AS size,
                  string_agg(CAST(n AS VARCHAR), ' ' ORDER BY n) AS positions FROM (
             SELECT DISTINCT NroPoliza, n FROM tokens JOIN tag_numbers USING (tag)
             UNION ALL SELECT NroPoliza, n + (SELECT count(*) FROM tag_numbers) FROM labelled
             JOIN pair_numbers ON pair = Pol6TTaCod || '__' || CoberturaLabel) GROUP BY NroPoliza""",
        TOKENS,
        """tag_numbers AS (
             SELECT tag, row_number() OVER (ORDER BY TRY_CAST(tag AS BIGINT) IS NULL, TRY_CAST(tag AS BIGINT), tag) - 1 AS n
             FROM (SELECT DISTINCT tag FROM tokens)),
           pair_numbers AS (SELECT pair, row_number() OVER (ORDER BY pair) - 1 AS n
             FROM (SELECT DISTINCT Pol6TTaCod || '__' || CoberturaLabel AS pair FROM labelled))"""),
)
def sparse_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and pairs numbered by a distributed dictionary and held as one sparse vector per row."""
    built = encode_portfolio(materialise(v.portfolio(spark, sf_dir)), sparse=True).with_vectors("features")
    values = vector_to_array("features")
    places = F.transform(values, lambda x, i: F.when(x == 1, i.cast("string")))
    return built.select("NroPoliza", F.size(values).alias("size"), F.array_join(F.array_compact(places), " ").alias("positions"))
