"""Raw portfolio -> encoded dataset -> clean and doubtful tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from premiumscope.functions.numeric import col, dtype_of, is_text, nan_to_null
from premiumscope.operators import encode
from premiumscope.operators.scale import materialise
from premiumscope.operators.validate import MIN_PAIR_COUNT, SUM_TOLERANCE, Triage, triage
from premiumscope.sources.writers import write_clean_and_doubtful
from premiumscope.spec import (
    COVERAGE_COLUMN,
    IDENTITY_COLUMN,
    RAW_COVERAGE_COLUMN,
    TAGS_COLUMN,
    TARIFF_COLUMN,
    droppable_columns,
    infer_components,
    infer_total_target,
)


@dataclass
class EncodedDataset:
    """Encoded rows plus what was learnt and dropped on the way."""

    data: DataFrame
    before_dedupe: DataFrame
    total: str
    components: list[str]
    reporting: list[str]
    dropped: list[str]
    tags: list[str] = field(default_factory=list)
    pairs: list[str] = field(default_factory=list)
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)

    def with_vectors(self, out: str = "features") -> DataFrame:
        """The rows with one sparse vector over all numbered tags and pairs."""
        blocks = [(name, table.count()) for name, table in self.dictionaries.items()]
        return encode.sparse_vectors(self.data, blocks, out)

    @property
    def targets(self) -> list[str]:
        return [*self.components, self.total]

    def metadata(self) -> dict[str, object]:
        """Build record; the row counts are two counting jobs."""
        rows = self.data.count()
        return {
            "target_column": self.total,
            "component_target_columns": self.components,
            "target_columns": self.targets,
            "reporting_columns": self.reporting,
            "dropped_columns": self.dropped,
            "duplicate_rows_removed": self.before_dedupe.count() - rows,
            "row_count": rows,
            "column_count": len(self.data.columns),
        }


def encode_portfolio(
    raw: DataFrame,
    target: str | None = None,
    drop: Iterable[str] = (),
    tags: str = TAGS_COLUMN,
    identity: str = IDENTITY_COLUMN,
    order_by: Iterable[str] | None = None,
    dedupe: bool = True,
    sparse: bool = False,
) -> EncodedDataset:
    """Drop, label, encode, fill and de-duplicate in the contract's order.

    Each fit step is one small aggregate over the columns it needs; the encoded table itself is a single
    lazy projection followed by the de-duplicating aggregate. The identity stays text and is never encoded.

    Tags and pairs become a 0/1 column each. If there are more than ``encode.MAX_ENCODED_COLUMNS`` of either, or with
    ``sparse``, they become one column of positions in a dictionary instead (``EncodedDataset.dictionaries``), from
    which ``with_vectors`` builds a sparse vector.
    """
    total = infer_total_target(raw.columns, target)
    components = infer_components(raw.columns, total)
    targets = [*components, total]
    dropped = droppable_columns(raw.columns, drop, targets)

    df = nan_to_null(raw.drop(*dropped))
    text_targets = [name for name in targets if is_text(dtype_of(df, name))]
    df = encode.cast_numeric_like(df, text_targets)
    df = encode.drop_rows_without_targets(df, targets)
    if identity in df.columns:
        df = df.withColumn(identity, col(identity).cast("string"))

    vocabulary: list[str] = []
    dictionaries: dict[str, DataFrame] = {}
    if tags in df.columns:
        vocabulary = None if sparse else encode.try_vocabulary(encode.fit_tags, df, tags)
        if vocabulary is None:
            dictionaries[encode.TAG_POSITIONS] = materialise(encode.fit_tag_dictionary(df, tags))
            df = encode.tag_positions(df, dictionaries[encode.TAG_POSITIONS], tags)
        else:
            df = encode.multi_hot(df, vocabulary, tags)
    reporting: list[str] = []
    if RAW_COVERAGE_COLUMN in df.columns:
        df = encode.add_coverage_label(df)
        reporting.append(COVERAGE_COLUMN)
    if TARIFF_COLUMN in df.columns:
        df = encode.fill_label(df)
        reporting.append(TARIFF_COLUMN)
    pairs: list[str] = []
    if {TARIFF_COLUMN, COVERAGE_COLUMN} <= set(df.columns):
        pairs = None if sparse else encode.try_vocabulary(encode.fit_pairs, df)
        if pairs is None:
            dictionaries[encode.PAIR_POSITION] = materialise(encode.fit_pair_dictionary(df))
            df = encode.pair_position(df, dictionaries[encode.PAIR_POSITION])
        else:
            df = encode.pair_one_hot(df, pairs)

    untouched = [*targets, *reporting, identity, TARIFF_COLUMN]
    df = encode.cast_numeric_like(df, encode.fit_numeric_like(df, untouched))
    categorical = encode.categorical_columns(df, untouched)
    df = encode.ordinal_codes(df, encode.fit_ordinal(df, categorical))
    before = encode.features_then_targets(encode.fill_features(df, targets), targets)
    data = before
    if dedupe:
        ids = [identity] if identity in before.columns else []
        data = encode.drop_duplicates_keep_first(before, ids, list(order_by) if order_by else None)
    return EncodedDataset(data, before, total, components, reporting, dropped, vocabulary or [], pairs or [], dictionaries)


def build_dataset(
    raw: DataFrame,
    path: str,
    rejected_path: str | None = None,
    target: str | None = None,
    drop: Iterable[str] = (),
    tags: str = TAGS_COLUMN,
    tolerance: float = SUM_TOLERANCE,
    min_pair_count: int = MIN_PAIR_COUNT,
) -> tuple[EncodedDataset, Triage]:
    """Encode, triage and write both tables. The encoded rows are written once in between, because the pair
    counts and both sinks read them."""
    encoded = encode_portfolio(raw, target, drop, tags)
    encoded.data = materialise(encoded.data)
    result = triage(encoded.data, encoded.components, encoded.total, tolerance, min_pair_count)
    write_clean_and_doubtful(result, path, rejected_path)
    return encoded, result

