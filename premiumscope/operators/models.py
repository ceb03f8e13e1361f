"""Premium scorers: anything that adds one prediction column per component to a DataFrame.

``score(df, outputs)`` reads the feature columns by name and adds ``outputs[component]`` for every component.
It never reorders or drops rows, so the same rows can be scored twice in one plan.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premiumscope.functions.labels import text_or_missing
from premiumscope.functions.numeric import col, fixed_sum, total_of
from premiumscope.operators.joint import JointScorer, fit_joint
from premiumscope.operators.metrics import absolute_percentage_error, group_means
from premiumscope.operators.scale import LOOKUP_MAX_ROWS, attach, attach_rows, bounded_table, materialise, settle
from premiumscope.operators.scaling import fit_scaling
from premiumscope.operators.smooth import fit_tweedie, mean_of_score
from premiumscope.spec import APE, PREDICTION, SPLIT, encoding_columns, feature_columns, identity_first

Outputs = Mapping[str, str]


class Scorer(Protocol):
    components: list[str]
    features: list[str]
    carried: list[str]

    def score(self, df: DataFrame, outputs: Outputs) -> DataFrame: ...


# ---- saved scorers ----------------------------------------------------------------------------------

def write_record(path: str, record: Mapping[str, Any]) -> None:
    """A small JSON record as a one-row text table."""
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()["value"])


def save_scorer(scorer: Scorer, path: str) -> None:
    """A scorer as a folder of JSON and Parquet that ``load_scorer`` reads without being told its class."""
    kind = next((name for name, cls in SAVED.items() if type(scorer) is cls), None)
    if kind is None:
        raise TypeError(f"a {type(scorer).__name__} has no saved form; those that have are {', '.join(SAVED)}")
    scorer.save(path)
    write_record(f"{path}/kind", {"kind": kind})


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    kind = read_record(spark, f"{path}/kind")["kind"]
    if kind not in SAVED:
        raise ValueError(f"{path} holds a scorer of the kind {kind!r}; known are {', '.join(SAVED)}")
    return SAVED[kind].load(spark, path)


# ---- per-pair baselines -----------------------------------------------------------------------------

class _PairTable:
    """A per-pair table kept on the driver while small, as a written table otherwise."""

    def __init__(self, table: DataFrame, groups: Sequence[str]):
        self.groups = list(groups)
        self.schema = table.schema
        self.rows: pa.Table | None = bounded_table(table)
        self.stored = materialise(table) if self.rows is None else None

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.stored if self.rows is None else spark.createDataFrame(self.rows, schema=self.schema)

    def save(self, path: str) -> None:
        self.frame(SparkSession.active()).write.mode("overwrite").parquet(path)

    def join(self, df: DataFrame, rename: Mapping[str, str]) -> DataFrame:
        keys = [f"_key_{g}" for g in self.groups]
        table, size = self.frame(df.sparkSession), float("inf") if self.rows is None else self.rows.num_rows
        names = dict(zip(self.groups, keys)) | dict(rename)
        lookup = table.select(*[col(old).alias(new) for old, new in names.items()])
        keyed = df.withColumns({k: text_or_missing(col(g)) for g, k in zip(self.groups, keys)})
        return attach_rows(keyed, lookup, size, keys).drop(*keys)


class PairMeanScorer:
    """Mean of every component per tariff-coverage pair."""

    def __init__(
        self, train: DataFrame, groups: Sequence[str], components: Sequence[str], decimals: int | None = None
    ):
        self.components, self.features, self.carried = list(components), [], list(groups)
        self._table = _PairTable(group_means(train, groups, components, decimals), groups)

    def score(self, df: DataFrame, outputs: Outputs) -> DataFrame:
        return self._table.join(df, {c: outputs[c] for c in self.components})

    def save(self, path: str) -> None:
        self._table.save(f"{path}/table")
        write_record(f"{path}/roles", {"groups": self.carried, "components": self.components})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairMeanScorer:
        roles = read_record(spark, f"{path}/roles")
        scorer = cls.__new__(cls)
        scorer.components, scorer.features, scorer.carried = roles["components"], [], roles["groups"]
        scorer._table = _PairTable(spark.read.parquet(f"{path}/table"), roles["groups"])
        return scorer


def pair_lines(df: DataFrame, groups: Sequence[str], components: Sequence[str], feature: str) -> DataFrame:
    """Least-squares line of every component on one feature per pair; a constant feature gives the mean."""
    x = col(feature).cast("double")
    fitted = []
    for c in components:
        slope = F.coalesce(F.regr_slope(col(c), x), F.lit(0.0))
        fitted.append(slope.alias(f"{c} slope"))
        fitted.append(F.coalesce(F.regr_intercept(col(c), x), F.avg(col(c))).alias(f"{c} intercept"))
    return df.groupBy(*[text_or_missing(col(g)).alias(g) for g in groups]).agg(*fitted)


class PairLineScorer:
    """Per-pair line on one feature, floored at zero."""

    def __init__(self, train: DataFrame, groups: Sequence[str], components: Sequence[str], feature: str):
        self.components, self.features, self.carried = list(components), [feature], list(groups)
        self._table = _PairTable(pair_lines(train, groups, components, feature), groups)

    def score(self, df: DataFrame, outputs: Outputs) -> DataFrame:
        parts = {f"{c} {k}": f"_{k}_{i}" for i, c in enumerate(self.components) for k in ("slope", "intercept")}
        joined = self._table.join(df, parts)
        x = col(self.features[0])
        predicted = {
            outputs[c]: F.greatest(F.lit(0.0), F.col(f"_intercept_{i}") + F.col(f"_slope_{i}") * x)
            for i, c in enumerate(self.components)
        }
        return joined.withColumns(predicted).drop(*parts.values())

    def save(self, path: str) -> None:
        self._table.save(f"{path}/table")
        write_record(f"{path}/roles", {"groups": self.carried, "components": self.components, "feature": self.features[0]})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairLineScorer:
        roles = read_record(spark, f"{path}/roles")
        scorer = cls.__new__(cls)
        scorer.components, scorer.features, scorer.carried = roles["components"], [roles["feature"]], roles["groups"]
        scorer._table = _PairTable(spark.read.parquet(f"{path}/table"), roles["groups"])
        return scorer


def leave_fold_out_means(
    df: DataFrame,
    groups: Sequence[str],
    fold: str,
    components: Sequence[str],
    outputs: Outputs,
    decimals: int | None = None,
) -> DataFrame:
    """Out-of-fold pair means for all folds at once: (pair sum - fold sum) / (pair rows - fold rows).

    One aggregate by (pair, fold) replaces one fit per fold.
    """
    keys = {g: f"_key_{i}" for i, g in enumerate(groups)}
    labelled = df.withColumns({k: text_or_missing(col(g)) for g, k in keys.items()})
    sums = labelled.groupBy(*keys.values(), fold).agg(
        F.count(F.lit(1)).alias("_n"), *[fixed_sum(col(c), decimals).alias(f"_s_{c}") for c in components]
    )
    whole = sums.groupBy(*keys.values()).agg(
        F.sum("_n").alias("_n_all"),
        *[F.sum(F.col(f"_s_{c}")).alias(f"_all_{c}") for c in components],
    )
    rest = F.col("_n_all") - F.col("_n")
    means = sums.join(whole, list(keys.values())).select(
        *keys.values(),
        fold,
        *[
            ((F.col(f"_all_{c}") - F.col(f"_s_{c}")).cast("double") / F.when(rest > 0, rest)).alias(outputs[c])
            for c in components
        ],
    )
    return attach(labelled, means, [*keys.values(), fold]).drop(*keys.values())


# ---- formula and foreign models ---------------------------------------------------------------------

class ExpressionScorer:
    """Components as SQL expressions over the feature columns."""

    def __init__(self, formulas: Mapping[str, str], features: Sequence[str], carried: Sequence[str] = ()):
        self.formulas = dict(formulas)
        self.components, self.features, self.carried = list(formulas), list(features), list(carried)

    def score(self, df: DataFrame, outputs: Outputs) -> DataFrame:
        return df.withColumns({outputs[c]: F.expr(f).cast("double") for c, f in self.formulas.items()})

    def save(self, path: str) -> None:
        write_record(f"{path}/roles", {"formulas": self.formulas, "features": self.features, "carried": self.carried})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExpressionScorer:
        roles = read_record(spark, f"{path}/roles")
        return cls(roles["formulas"], roles["features"], roles["carried"])


class ObjectScorer:
    """Any object with ``predict(features) -> n x k``: runs on Arrow batches, only the features travel."""

    def __init__(self, model: Any, components: Sequence[str], features: Sequence[str]):
        self.components, self.carried, self.features = list(components), [], list(features)
        self._model = model

    def score(self, df: DataFrame, outputs: Outputs) -> DataFrame:
        predict = _batch_predictor(self._model, list(self.features), len(self.components))
        schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(len(self.components))])
        udf = F.pandas_udf(predict, schema)
        inputs = F.struct(*[col(name).cast("double").alias(f"x{i}") for i, name in enumerate(self.features)])
        scored = df.withColumn("_predicted", udf(inputs))
        named = {outputs[c]: F.col(f"_predicted.c{i}") for i, c in enumerate(self.components)}
        return scored.withColumns(named).drop("_predicted")


def _batch_predictor(model: Any, features: list[str], width: int) -> Callable:
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.asarray(model.predict(batch.set_axis(features, axis=1)), dtype=float)
            values = values.reshape(-1, 1) if values.ndim == 1 else values
            if values.shape != (len(batch), width):
                raise ValueError(f"predict gave an array of the shape {values.shape} for {len(batch)} rows and {width} components")
            yield pd.DataFrame(values, columns=[f"c{i}" for i in range(width)])

    predict.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return predict


def model_features(scorer: Scorer, columns: Sequence[str], excluded: Sequence[str]) -> list[str]:
    """The scorer's features; a scorer that names none and goes by no pair reads all columns but the excluded ones."""
    return list(scorer.features) if scorer.features or scorer.carried else feature_columns(columns, excluded)


# ---- fitted families --------------------------------------------------------------------------------

FORESTS = ("random_forest", "extra_trees")
JOINT = ("pytorch", "joint")
SMOOTH = ("tweedie", *JOINT)
MODEL_TYPES = (*FORESTS, *SMOOTH)
MAX_TREE_DEPTH = 30
# Randomly binned copies of each feature an un-bagged forest draws from, and the bin bounds of a copy.
COPIES, BOUNDS = 8, 8

# Configuration names that change the fit, and those without a counterpart here: accepted, reported, without effect.
_FOREST = {"n_estimators", "max_depth", "min_samples_leaf", "max_features", "max_samples", "random_state", "bootstrap", "max_bins"}
_NO_FOREST = {"n_jobs", "min_samples_split", "criterion"}
_NETWORK = {
    "hidden_units", "hidden_layers", "learning_rate", "batch_size", "patience", "validation_fraction", "random_state",
    "device", "num_threads", "verbose",
}
USED = {
    "random_forest": _FOREST,
    "extra_trees": _FOREST,
    "tweedie": {"variance_power", "weight_decay", "max_epochs"},
    "pytorch": {"weight_decay", "max_epochs", "final_weight"},
    "joint": {"weight_decay", "max_epochs", "final_weight"},
}
UNUSED = {
    "random_forest": _NO_FOREST, "extra_trees": _NO_FOREST, "tweedie": {*_NETWORK, "final_weight"}, "pytorch": _NETWORK, "joint": _NETWORK,
}


def _subset_strategy(value: Any) -> str:
    if value is None or (isinstance(value, float) and value == 1.0):  # the whole number 1 is one feature
        return "all"
    return str(value)


def _forest_parameters(params: Mapping[str, Any]) -> dict[str, Any]:
    depth = params.get("max_depth")
    return {
        "numTrees": int(params.get("n_estimators", 100)),
        "maxDepth": MAX_TREE_DEPTH if depth is None else min(int(depth), MAX_TREE_DEPTH),
        "minInstancesPerNode": int(params.get("min_samples_leaf", 1)),
        "featureSubsetStrategy": _subset_strategy(params.get("max_features", 1.0)),
        "subsamplingRate": float(params.get("max_samples") or 1.0),
        "seed": int(params.get("random_state", 42)),
        "bootstrap": bool(params.get("bootstrap", True)),
        "maxBins": int(params.get("max_bins", 32)),
    }


def estimator_parameters(model_type: str, params: Mapping[str, Any]) -> dict[str, Any]:
    """Configuration names translated to the parameters the fit really gets."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"no model family is called {model_type!r}; there are {', '.join(sorted(MODEL_TYPES))}")
    strange = sorted(set(params) - USED[model_type] - UNUSED[model_type])
    if strange:
        raise ValueError(f"the family {model_type!r} has no parameters {strange}")
    if model_type in JOINT:
        return {
            "weight_decay": float(params.get("weight_decay", 1e-4)),
            "max_epochs": int(params.get("max_epochs", 50)),
            "final_weight": float(params.get("final_weight", 0.5)),
        }
    if model_type == "tweedie":
        return {
            "variancePower": float(params.get("variance_power", 1.5)),
            "regParam": float(params.get("weight_decay", 1e-4)),
            "maxIter": int(params.get("max_epochs", 25)),
        }
    return _forest_parameters({"bootstrap": model_type == "random_forest", **params})


def adjusted_parameters(model_type: str, params: Mapping[str, Any]) -> dict[str, str]:
    """What a configuration asks for that the fit does differently: {name: what happens to it}."""
    said = {name: "no effect" for name in sorted(set(params) & UNUSED[model_type])}
    if model_type in FORESTS and "max_depth" in params:
        asked = params["max_depth"]
        if asked is None or int(asked) > MAX_TREE_DEPTH:
            said["max_depth"] = f"{asked} becomes {MAX_TREE_DEPTH}"
    return said


def _share_of_copies(strategy: str, features: int) -> str:
    """Features a node draws among ``features * COPIES``, so that it sees about as many as without copies."""
    share = {"all": 1.0, "auto": 1 / 3, "onethird": 1 / 3, "sqrt": features**-0.5, "log2": math.log2(max(features, 2)) / features}
    wanted = share.get(strategy)
    if wanted is None:
        wanted = float(strategy) if "." in strategy else int(strategy) / features
    return str(max(1, round(min(1.0, wanted) * features)))


def _drawn_bins(train: DataFrame, inputs: Sequence[str], seed: int) -> list[tuple[str, list[float]]]:
    """Per copy of each column the bounds of its bins, drawn evenly between the column's ends."""
    ends = train.agg(*[f(col(name)).alias(f"{k}{i}") for i, name in enumerate(inputs) for k, f in (("l", F.min), ("h", F.max))]).first()
    drawn = []
    for i, name in enumerate(inputs):
        rng = random.Random(f"{seed}:{i}")
        low, high = ends[f"l{i}"], ends[f"h{i}"]
        if low is None or not high > low:
            continue
        for _ in range(COPIES):
            bounds = sorted({rng.uniform(low, high) for _ in range(BOUNDS)})
            drawn.append((name, [-math.inf, *bounds, math.inf]))
    return drawn


def _with_cells(shaped: DataFrame, bins: Bucketizer) -> tuple[DataFrame, list[str]]:
    """``shaped`` with a cell number per binned feature: rows of one cell lie in the same bin of every copy of it."""
    ends: dict[str, set[float]] = {}
    for name, bounds in zip(bins.getInputCols(), bins.getSplitsArray()):
        ends.setdefault(name, set()).update(bounds)
    cells = [f"_cell{i}" for i in range(len(ends))]
    number = Bucketizer(splitsArray=[sorted(b) for b in ends.values()], inputCols=list(ends), outputCols=cells, handleInvalid="keep")
    return number.transform(shaped), cells


def _cell_table(shaped: DataFrame, cells: Sequence[str], bins: Bucketizer, extra: Sequence[Column] = ()) -> DataFrame | None:
    """One row per combination of cells, with a value of each feature in it and the ``extra`` aggregates; None if the
    combinations are no small table or not far fewer than the rows."""
    held = F.approx_count_distinct(F.struct(*cells), 0.02)
    rows, distinct = shaped.agg(F.count(F.lit(1)), held).first()
    if distinct > min(rows / 4, LOOKUP_MAX_ROWS / 2):
        return None
    names = dict.fromkeys(bins.getInputCols())
    return settle(shaped.groupBy(*cells).agg(*[F.min(name).alias(name) for name in names], *extra))


class SparkModelScorer:
    """A fitted pipeline: one assembler (and scaler) shared by one regressor per component."""

    strategy = "per-component"

    def __init__(self, pipeline: PipelineModel, features: Sequence[str], components: Sequence[str]):
        self.pipeline = pipeline
        self.features, self.components, self.carried = list(features), list(components), []

    def score(self, df: DataFrame, outputs: Outputs) -> DataFrame:
        predicted = {f"_premium_{i}": outputs[c] for i, c in enumerate(self.components)}
        scored = self._scored_cells(df, list(predicted))
        scored = self.pipeline.transform(df) if scored is None else scored
        return scored.select(
            *[col(name) for name in df.columns if name not in set(predicted.values())],
            *[col(inner).alias(name) for inner, name in predicted.items()],
        )

    def _scored_cells(self, df: DataFrame, predicted: Sequence[str]) -> DataFrame | None:
        """``df`` scored by a lookup, if the model reads binned features and the rows of ``df`` lie in few cells."""
        shape, *rest = self.pipeline.stages
        bins = next((stage for stage in rest if isinstance(stage, Bucketizer)), None)
        if bins is None:
            return None
        shaped, cells = _with_cells(shape.transform(df), bins)
        found = _cell_table(shaped, cells, bins)
        if found is None:
            return None
        table = PipelineModel(rest).transform(found).select(*cells, *predicted)
        return shaped.join(F.broadcast(table), cells, "left")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        write_record(f"{path}/roles", {"features": self.features, "components": self.components})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparkModelScorer:
        roles = read_record(spark, f"{path}/roles")
        return cls(PipelineModel.load(f"{path}/pipeline"), roles["features"], roles["components"])


def _feature_stages(
    train: DataFrame, features: Sequence[str], model_type: str, scaler: str, fixed: dict[str, Any]
) -> tuple[list, list[str]]:
    """Stages that put the scaled features under safe names, and the names of the columns a regressor reads.

    A forest that draws no rows would grow the same tree over and over where it draws no features either. Its features
    are therefore copied, every copy with bin bounds of its own drawn at random, and each node chooses among a random
    part of the copies: trees differ by the cuts they may choose, not by the rows they see.
    """
    scaling = fit_scaling(train, features, scaler)
    safe = [f"_f{i}" for i in range(len(features))]
    quoted = ["`" + name.replace("`", "``") + "`" for name in features]
    scaled = [f"(CAST({q} AS DOUBLE) - {scaling.centre[n]!r}D) / {scaling.spread[n]!r}D" for q, n in zip(quoted, features)]
    statement = "SELECT *, " + ", ".join(f"{x} AS {s}" for x, s in zip(quoted if scaler == "none" else scaled, safe)) + " FROM __THIS__"
    stages: list = [SQLTransformer(statement=statement)]
    if model_type in FORESTS and not fixed["bootstrap"] and fixed["subsamplingRate"] == 1.0 and fixed["numTrees"] > 1:
        drawn = _drawn_bins(stages[0].transform(train), safe, fixed["seed"])
        if drawn:
            inputs = [f"_c{i}" for i in range(len(drawn))]
            names, bounds = [name for name, _ in drawn], [b for _, b in drawn]
            stages.append(Bucketizer(splitsArray=bounds, inputCols=names, outputCols=inputs, handleInvalid="keep"))
            fixed["featureSubsetStrategy"] = _share_of_copies(fixed["featureSubsetStrategy"], len(set(names)))
            return stages, inputs
    return stages, safe


def fit_spark_model(
    train: DataFrame,
    features: Sequence[str],
    components: Sequence[str],
    model_type: str,
    scaler: str = "none",
    params: Mapping[str, Any] | None = None,
) -> SparkModelScorer | JointScorer:
    """Fit one of ``MODEL_TYPES``: forests and the Tweedie family per component, the joint family all at once."""
    rows = train.select(*[col(name) for name in dict.fromkeys([*features, *components])])
    fixed = estimator_parameters(model_type, params or {})
    if model_type in JOINT:
        return fit_joint(rows, features, components, scaler=scaler, **fixed)
    stages, inputs = _feature_stages(rows, features, model_type, scaler, fixed)
    if isinstance(stages[-1], Bucketizer) and fixed["minInstancesPerNode"] == 1:
        cells = _training_cells(stages[0].transform(rows), stages[-1], components, fixed["maxBins"])
        if cells is not None:
            prepared = stages[-1].transform(cells)
            fixed["weightCol"] = "_weight"
            return SparkModelScorer(PipelineModel(stages + _forests(prepared, inputs, components, fixed)), features, components)
    fit = _forests if model_type in FORESTS else _regressions
    return SparkModelScorer(PipelineModel(stages + fit(PipelineModel(stages).transform(rows), inputs, components, fixed)), features, components)


def _training_cells(shaped: DataFrame, bins: Bucketizer, components: Sequence[str], least: int) -> DataFrame | None:
    """What a forest on binned features that draws no rows learns from: two rows per cell, half its weight each, whose components
    lie one deviation below and above the cell's mean. No cut parts the rows of a cell, and their number, sum and sum of
    squares are kept, so every cut is worth what it is worth on the rows."""
    numbered, cells = _with_cells(shaped, bins)
    half, names = (F.count(F.lit(1)) / 2).alias("_weight"), list(enumerate(components))
    # A missing component stays missing, so that the fit refuses it.
    whole = {k: F.count(col(c)) == F.count(F.lit(1)) for k, c in names}
    means = [F.when(whole[k], F.avg(col(c).cast("double"))).alias(f"_mean{k}") for k, c in names]
    spreads = [F.stddev_pop(col(c).cast("double")).alias(f"_spread{k}") for k, c in names]
    table = _cell_table(numbered, cells, bins, [half, *means, *spreads])
    if table is None or table.count() < least:
        return None
    sides = table.withColumn("_side", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    values = [(F.col(f"_mean{k}") + F.col("_side") * F.col(f"_spread{k}")).alias(c) for k, c in names]
    return sides.select(*dict.fromkeys(bins.getInputCols()), "_weight", *values)


def _forests(prepared: DataFrame, inputs: Sequence[str], components: Sequence[str], fixed: Mapping[str, Any]) -> list:
    """An assembler and a fitted forest per component."""
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="_assembled")
    rows = assembler.transform(prepared)
    forests = [
        RandomForestRegressor(labelCol=f"`{c}`" if "." in c else c, featuresCol="_assembled", predictionCol=f"_premium_{k}", **fixed)
        for k, c in enumerate(components)
    ]
    return [assembler, *[forest.fit(rows) for forest in forests]]


def _regressions(prepared: DataFrame, inputs: Sequence[str], components: Sequence[str], fixed: Mapping[str, Any]) -> list:
    """Tweedie regressions of all components as one stage that computes their means."""
    found = fit_tweedie(prepared, [col(name) for name in inputs], [col(c) for c in components], **fixed)
    present = [f"coalesce(nanvl(CAST({x} AS DOUBLE), NULL), raise_error('a feature of a row to be scored is missing'))" for x in inputs]
    scores = [" + ".join([f"{w[0]!r}D", *[f"{b!r}D * {x}" for b, x in zip(w[1:], present)]]) for w in found.tolist()]
    held = ", ".join(f"{s} AS _score_{k}" for k, s in enumerate(scores))
    means = ", ".join(f"{mean_of_score(f'_score_{k}')} AS _premium_{k}" for k in range(len(components)))
    return [SQLTransformer(statement=f"SELECT *, {held} FROM __THIS__"), SQLTransformer(statement=f"SELECT *, {means} FROM __THIS__")]


#: Scorers with a saved form, by the name they are saved under.
SAVED: dict[str, type] = {
    "pair means": PairMeanScorer,
    "pair lines": PairLineScorer,
    "formula": ExpressionScorer,
    "pipeline": SparkModelScorer,
    "joint": JointScorer,
}


# ---- scored table -----------------------------------------------------------------------------------

def component_outputs(components: Sequence[str], suffix: str = " Prediction") -> dict[str, str]:
    return {c: f"{c}{suffix}" for c in components}


def with_total(df: DataFrame, outputs: Outputs, total: str) -> DataFrame:
    return df.withColumn(total, total_of([col(name) for name in outputs.values()]))


def scored_table(df: DataFrame, scorer: Scorer, total: str, identity: str) -> DataFrame:
    """All rows with component predictions, their total, the percentage error and the split label; pair
    encodings are left out and the identity comes first."""
    names = identity_first(df.columns, identity)
    if SPLIT not in names:
        raise ValueError(f"the table has no column {SPLIT!r}: its rows are not assigned to train or test")
    outputs = component_outputs(scorer.components)
    hidden = {*encoding_columns(names), SPLIT}
    scored = with_total(scorer.score(df, outputs), outputs, PREDICTION)
    ape: Column = absolute_percentage_error(col(total), col(PREDICTION))
    return scored.select(
        *[col(name) for name in names if name not in hidden],
        *[col(name) for name in outputs.values()],
        col(PREDICTION),
        ape.alias(APE),
        col(SPLIT),
    )


def holdout_scores(scored: DataFrame, identity: str, total: str) -> DataFrame:
    """Predictions and signed percent errors on test rows only; other rows keep NULL."""
    on_test = col(SPLIT) == "test"
    actual = col(total)
    return scored.select(
        col(identity),
        actual,
        F.when(on_test, col(PREDICTION)).alias("Prima Prevista"),
        F.when(on_test & (F.abs(actual) > 0), (actual - col(PREDICTION)) / actual * 100).alias("Porcentaje Error"),
    )
