"""JSON metadata of stored rows: kept as VARIANT, filtered before anything else reads the row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comparisons a condition may ask for, besides equality with a plain value.
_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def parsed(df: DataFrame, column: str = "metadata") -> DataFrame:
    """``df`` with the JSON text of ``column`` as VARIANT; text that is no JSON becomes NULL."""
    return df.withColumn(column, F.try_parse_json(column))


def value_at(column: str | Column, path: str, kind: str) -> Column:
    """The value at a path like ``$.author.name``, NULL where it is missing or of another type."""
    return F.try_variant_get(column, path, kind)


def matches(column: str | Column, conditions: Mapping[str, object]) -> Column:
    """All conditions hold: ``{path: value}``, ``{path: (operator, value)}`` or ``{path: [values]}``.

    The type of the value decides how the metadata is read, so ``{"$.year": 2024}`` compares whole
    numbers. A row without the path does not match; ``{path: None}`` asks for just that.
    """
    test = F.lit(True)
    for path, wanted in conditions.items():
        if wanted is None:
            test = test & value_at(column, path, "string").isNull()
            continue
        if isinstance(wanted, list):
            kinds = {_kind(v) for v in wanted}
            if len(kinds) != 1:
                raise ValueError(f"values for {path} must be of one type")
            test = test & F.coalesce(value_at(column, path, kinds.pop()).isin(wanted), F.lit(False))
            continue
        operator, value = wanted if isinstance(wanted, tuple) else ("=", wanted)
        if operator not in _COMPARE:
            raise ValueError(f"operator must be one of {sorted(_COMPARE)}, not {operator!r}")
        test = test & F.coalesce(_COMPARE[operator](value_at(column, path, _kind(value)), F.lit(value)), F.lit(False))
    return test


def _kind(value: object) -> str:
    if type(value) not in _TYPES:
        raise TypeError(f"metadata is compared with a text, number or boolean, not {value!r}")
    return _TYPES[type(value)]


def where_metadata(df: DataFrame, conditions: Mapping[str, object], column: str = "metadata") -> DataFrame:
    """Rows of ``df`` whose metadata meets the conditions; ``column`` is VARIANT or JSON text."""
    if df.schema[column].dataType.typeName() != "string":
        return df.where(matches(column, conditions))
    # The text is parsed once a row, whatever the number of conditions.
    return df.where(F.exists(F.array(F.try_parse_json(column)), lambda v: matches(v, conditions)))


def facets(df: DataFrame, paths: Sequence[str], column: str = "metadata") -> DataFrame:
    """(path, value, n_rows) of every value at the paths, one pass; NULL where a row has none."""
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), value_at(column, p, "string").alias("value")) for p in paths))
    return df.select(F.inline(pairs)).groupBy("path", "value").agg(F.count("*").alias("n_rows"))


def shape(df: DataFrame, column: str = "metadata") -> DataFrame:
    """(schema): one type that all metadata fits."""
    return df.agg(F.schema_of_variant_agg(column).alias("schema"))
