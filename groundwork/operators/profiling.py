"""Column profiling: value discovery, ranges and the diagnosis of empty results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.errors import ColumnNotFound, UnsupportedColumnType
from groundwork.functions.similarity import jaro_winkler_pinned
from groundwork.sources.scratch import checkpointed

EXACT = "exact"
REGEX = "regex"
FUZZY = "fuzzy"
MATCH_TYPES = (FUZZY, REGEX, EXACT)

# Lowest fuzzy score on a 0-100 scale and the longest list in characters.
FUZZY_THRESHOLD = 50
MAX_CHARS = 32767

RANGED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: What the Parquet reader takes bounds of from file footers.
FOOTER_RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)


def column_type(df: DataFrame, column: str) -> T.DataType:
    """Type of a column; the name is matched as Spark resolves names."""
    for field in df.schema.fields:
        if field.name.lower() == column.lower():
            return field.dataType
    raise ColumnNotFound(f"Column not found: {column}")


def _distinct(df: DataFrame, column: str) -> DataFrame:
    column_type(df, column)
    return df.select(df[column].alias("value")).where(F.col("value").isNotNull()).distinct()


def _valid_regex(df: DataFrame, pattern: str) -> str:
    """The pattern, if Spark's regular expressions accept it: an error now, not in a task."""
    try:
        df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as error:
        raise ValueError(f"invalid pattern: {error}") from None
    return pattern


def distinct_values(
    df: DataFrame,
    column: str,
    pattern: str | None = None,
    match_type: str | None = None,
    threshold: float = FUZZY_THRESHOLD,
) -> DataFrame:
    """Distinct non-NULL values as (value), narrowed by a pattern.

    A blank pattern is no pattern. A pattern with a missing or unknown match type is fuzzy.
    A pattern that matches nothing returns every value. With a pattern the table is read once: its
    distinct values and whether each matches are written to the checkpoint folder.
    """
    if pattern is None or not pattern.strip():
        return _distinct(df, column)
    judged = checkpointed(judged_values(df, column, pattern, match_type, threshold))
    return judged.where(F.col("hit") | ~judged.where("hit").exists()).select("value")


def judged_values(df: DataFrame, column: str, pattern: str, match_type: str | None, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(value, hit): the distinct non-NULL values and whether the pattern matches each."""
    values = _distinct(df, column)
    kind = (match_type or "").strip().lower()
    text = F.col("value").cast("string")
    if kind == EXACT:
        # A pattern that is no value of the column's type equals nothing.
        hit = F.col("value") == F.lit(pattern).try_cast(column_type(df, column))
    elif kind == REGEX:
        hit = text.rlike(_valid_regex(df, "(?i)" + pattern))
    else:
        # The score is pinned above the distinct: one evaluation per value, not per row.
        hit = jaro_winkler_pinned(text, F.lit(pattern)) * 100 >= threshold
    return values.withColumn("hit", F.coalesce(hit, F.lit(False)))


def truncate_values(values: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(value, truncated): the sorted values whose JSON list stays within ``max_chars``.

    Whole values only, so the list is always valid JSON; ``truncated`` says if any is left out.
    When not even the first value fits, one row without a value says so.
    """
    # An element takes two characters at least, so this many rows always overfill the list.
    bounded = values.orderBy("value").limit(max_chars // 2 + 1)
    width = F.length(F.to_json(F.struct("value"))) - len('{"value":}') + 1
    # Running length of the list over those few rows: brackets, elements, commas.
    in_order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    measured = bounded.withColumn("used", F.sum(width).over(in_order) + 1)
    measured = measured.withColumn("first", F.row_number().over(Window.orderBy("value")) == 1)
    longest = F.max("used").over(Window.partitionBy(F.lit(0)))
    fits = F.col("used") <= max_chars
    return (
        measured.withColumn("truncated", longest > max_chars)
        .where(fits | F.col("first"))
        .select(F.when(fits, F.col("value")).alias("value"), "truncated")
    )


def range_values(df: DataFrame, column: str) -> DataFrame:
    """(column_name, min_value, max_value) of a numeric, date or timestamp column."""
    kind = column_type(df, column)
    if not isinstance(kind, RANGED):
        raise UnsupportedColumnType(f"{column} is {kind.simpleString()}; a range needs numbers, dates or timestamps")
    return df.agg(F.min(df[column]).alias("min_value"), F.max(df[column]).alias("max_value")).select(
        F.lit(column).alias("column_name"), "min_value", "max_value"
    )


def range_from_footers(spark: SparkSession, path: str, column: str) -> DataFrame:
    """:func:`range_values` of a column of Parquet files, answered from their footers: no column is read.

    Numbers and dates only; Parquet keeps no usable bounds of other columns for this. The scan runs in a
    session of its own, whose reader may push aggregates down, and only the two bounds come back.
    """
    kind = spark.read.parquet(path).schema[column].dataType
    if not isinstance(kind, FOOTER_RANGED):
        raise UnsupportedColumnType(f"{column} is {kind.simpleString()}; footers bound numbers and dates")
    row = footer_bounds(spark, path, column).first()
    schema = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("min_value", kind), T.StructField("max_value", kind)])
    return spark.createDataFrame([(column, row["min_value"], row["max_value"])], schema)


def footer_bounds(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(min_value, max_value), planned in a session that pushes aggregates into the Parquet reader."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def diagnose_empty(df: DataFrame, predicates: Sequence[tuple[str, object]], k: int = 5) -> DataFrame:
    """Why a query returned nothing: (column_name, finding, rank, value, score).

    ``predicates`` are the (column, searched value) pairs of the query. A numeric or temporal
    column reports its ``min`` and ``max``, and as ``outside`` a searched value beyond them; any
    other reports the ``k`` nearest values by Jaro-Winkler, best first. The table is read once for
    the bounds and once for all distinct values.
    """
    ranged, named = [], []
    for column, searched in predicates:
        target = ranged if isinstance(column_type(df, column), RANGED) else named
        target.append((column, searched))
    parts = []
    if ranged:

        def bound(agg, column: str) -> Column:
            # Adding 0 turns a negative zero into a plain one.
            fraction = isinstance(column_type(df, column), T.FractionalType)
            return (agg(df[column]) + F.lit(0) if fraction else agg(df[column])).cast("string")

        bounds = df.agg(
            *[
                bound(agg, column).alias(f"{finding}_{i}")
                for i, (column, _) in enumerate(ranged)
                for finding, agg in (("min", F.min), ("max", F.max))
            ],
            *[
                (
                    (F.min(df[column]) > F.lit(searched).try_cast(column_type(df, column)))
                    | (F.max(df[column]) < F.lit(searched).try_cast(column_type(df, column)))
                ).alias(f"outside_{i}")
                for i, (column, searched) in enumerate(ranged)
            ],
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(column).alias("column_name"),
                    F.lit(finding).alias("finding"),
                    F.lit(1).alias("rank"),
                    (F.lit(str(searched)) if finding == "outside" else F.col(f"{finding}_{i}")).alias("value"),
                    F.lit(None).cast("double").alias("score"),
                    (F.col(f"outside_{i}") if finding == "outside" else F.lit(True)).alias("shown"),
                )
                for i, (column, searched) in enumerate(ranged)
                for finding in ("min", "max", "outside")
            ]
        )
        parts.append(bounds.select(F.inline(rows)).where("shown").drop("shown"))
    if named:
        pairs = F.array(
            *[F.struct(F.lit(i).alias("place"), df[column].cast("string").alias("value")) for i, (column, _) in enumerate(named)]
        )
        known = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
        known = checkpointed(known) if len(named) > 1 else known
    for i, (column, searched) in enumerate(named):
        scored = known.where(F.col("place") == i).select(
            "value", F.round(jaro_winkler_pinned(F.col("value"), F.lit(str(searched))), 6).alias("score")
        )
        nearest = scored.orderBy(F.desc("score"), "value").limit(k)
        # k rows.
        listed = nearest.agg(
            F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "value", "score"))).alias("best")
        ).select(F.posexplode("best").alias("position", "row"))
        parts.append(
            listed.select(
                F.lit(column).alias("column_name"),
                F.lit("nearest").alias("finding"),
                (F.col("position") + 1).alias("rank"),
                "row.value",
                "row.score",
            )
        )
    if not parts:
        raise ValueError("give at least one predicate")
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
