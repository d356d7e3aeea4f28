"""Column cleansing: trim, remove, replace, value mapping, transforms."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rowpact.contract import CleanseRule, ColumnSpec
from rowpact.functions.scalars import e164_kr, replace_all, trim


def fold_empty(value: Column) -> Column:
    """Missing and empty are the same thing; inside the engine it is always ''."""
    return F.coalesce(value.cast("string"), F.lit(""))


def remove(value: Column, literals: Iterable[str]) -> Column:
    for literal in literals:
        value = replace_all(value, literal, "")
    return value


def replace(value: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Replacements in declared order, each on the result of the one before."""
    for old, new in pairs:
        value = replace_all(value, old, new)
    return value


def preprocess(value: Column, rules: Iterable[CleanseRule]) -> Column:
    """Per rule always trim, remove, replace; rules run one after the other."""
    for rule in rules:
        if rule.trim:
            value = trim(value)
        value = replace(remove(value, rule.remove), rule.replace)
    return value


def normalize(value: Column, mapping: Iterable[tuple[str, str]] | Mapping[str, str]) -> Column:
    """Exact-match lookup; values without an entry stay."""
    pairs = list(mapping.items()) if isinstance(mapping, Mapping) else list(mapping)
    if not pairs:
        return value
    literals = [F.lit(text) for pair in pairs for text in pair]
    return F.coalesce(F.create_map(*literals)[value], value)


def transform(value: Column, names: Iterable[str]) -> Column:
    for _ in names:
        value = e164_kr(value)
    return value


def cleanse(value: Column, spec: ColumnSpec) -> Column:
    """What a column looks like when its checks run."""
    return normalize(preprocess(value, spec.preprocess), spec.normalize)


def normalize_with_table(
    df: DataFrame, column: str, dictionary: DataFrame, key: str, value: str
) -> DataFrame:
    """Value mapping against a dictionary table with one row per key.

    No broadcast hint: Spark broadcasts the table when its known size is under
    `spark.sql.autoBroadcastJoinThreshold` and otherwise runs a shuffle join, where
    adaptive execution splits hot keys on the row side.
    """
    lookup = dictionary.select(F.col(key).alias("_from"), F.col(value).alias("_to"))
    joined = df.join(lookup, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
