"""Query registry and result rounding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.functions.numeric import col, is_floating
from premiumscope.session import tune

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"Query '{name}' is registered twice.")

        @wraps(run)
        def tuned(spark: SparkSession, sf_dir: str, **options: Any) -> DataFrame:
            return run(tune(spark), sf_dir, **options)

        REGISTRY[name] = Query(tuned, sql)
        return tuned

    return register


def rounded(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Floating columns rounded for comparison."""
    return df.select(
        *[
            F.round(col(f.name), by_column.get(f.name, digits)).alias(f.name) if is_floating(f.dataType) else col(f.name)
            for f in df.schema.fields
        ]
    )
