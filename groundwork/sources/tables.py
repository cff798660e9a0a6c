"""Table access by name, catalogue listings and guarded ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.errors import TableNotFound
from groundwork.operators.joins import numbered
from groundwork.sources.scratch import list_names

SUFFIX = ".parquet"


class Tables(Mapping):
    """Parquet tables of one directory, opened on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._open: dict[str, DataFrame] = {}
        self._names: list[str] | None = None

    def names(self) -> list[str]:
        if self._names is None:
            found = list_names(self.spark, f"{self.directory}/*{SUFFIX}")
            self._names = [name[: -len(SUFFIX)] for name in found]
        return self._names

    def path(self, name: str) -> str:
        """Where a table lies: one file, or a directory of files."""
        if name.lower() not in self.names():
            raise TableNotFound(name)
        return f"{self.directory}/{name.lower()}{SUFFIX}"

    def __getitem__(self, name: str) -> DataFrame:
        key = name.lower()
        if key not in self._open:
            self._open[key] = self.spark.read.parquet(self.path(key))
        return self._open[key]

    def register_views(self, *names: str) -> None:
        """Make tables visible to SQL text under their names."""
        for name in names or self.names():
            self[name].createOrReplaceTempView(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names())

    def __len__(self) -> int:
        return len(self.names())


def load(spark: SparkSession, directory: str) -> Tables:
    """The tables of a directory by name."""
    return Tables(spark, directory)


def list_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count); the counts come from the files' footers."""
    counts = [
        tables[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in tables
    ]
    if not counts:
        raise TableNotFound("no tables")
    listing = counts[0]
    for one in counts[1:]:
        listing = listing.unionByName(one)
    return listing


def table_schema(tables: Mapping[str, DataFrame], name: str, measure: bool = False) -> DataFrame:
    """(position, column_name, data_type, data_length); the name is case-insensitive.

    Spark strings declare no width, so ``data_length`` is NULL unless ``measure`` asks for a scan
    that finds the widest value of each column.
    """
    df = tables[name]
    if not measure:
        listed = [(i, f.name, f.dataType.simpleString(), None) for i, f in enumerate(df.schema.fields, 1)]
        return df.sparkSession.createDataFrame(listed, "position int, column_name string, data_type string, data_length bigint")
    widths = df.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.col(field.name).cast("bigint").alias("data_length"),
            )
            for i, field in enumerate(df.schema.fields, 1)
        ]
    )
    return widths.select(F.inline(rows))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_documents"))


def run_sql(spark: SparkSession, sql: str, max_rows: int | None = 1000, args: dict | None = None) -> DataFrame:
    """Run a SELECT and return at most ``max_rows`` rows of it.

    The text is wrapped as a subquery, so anything but a query fails to parse.
    """
    cap = "" if max_rows is None else f" LIMIT {int(max_rows)}"
    return spark.sql(f"SELECT * FROM (\n{sql}\n){cap}", args=args)


#: Rows that one envelope may hold.
ENVELOPE_ROWS = 1000


def result_envelope(df: DataFrame, sql_text: str, max_rows: int = ENVELOPE_ROWS) -> DataFrame:
    """One row (sql_query, row_count, sql_result) around an already capped result.

    ``sql_result`` is a JSON array of the rows, or "No data found." when there are none.
    The rows keep their order. Give it the output of :func:`run_sql`: a frame of more than ``max_rows``
    rows fails before it is gathered whole; :func:`result_pages` takes one of any size.
    """
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")
    rows = df.limit(max_rows + 1).select(row).select(F.struct(F.monotonically_increasing_id().alias("place"), "row").alias("placed"))
    gathered = F.transform(F.array_sort(F.collect_list("placed")), lambda placed: placed["row"])
    checked = F.when(F.size("rows") <= max_rows, F.size("rows")).otherwise(
        F.raise_error(F.lit(f"the result has more than {max_rows} rows; cap it or ask for pages"))
    )
    return rows.agg(gathered.alias("rows")).select(
        F.lit(sql_text).alias("sql_query"), checked.cast("bigint").alias("row_count"), _json_rows(F.col("rows")).alias("sql_result")
    )


def result_pages(df: DataFrame, sql_text: str, order: Sequence[str], page_rows: int = ENVELOPE_ROWS) -> DataFrame:
    """(sql_query, page, row_count, sql_result): an envelope for every ``page_rows`` rows in the order of some columns.

    The rows are numbered across range partitions, never gathered, so a page is all that a task holds. No rows give
    one page that says so.
    """
    placed = numbered(df, *[F.col(c) for c in order])
    row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    page = F.floor((F.col("position") - 1) / page_rows).cast("bigint").alias("page")
    pages = placed.select(page, F.struct(F.col("position"), row.alias("row")).alias("placed")).groupBy("page")
    held = pages.agg(F.transform(F.array_sort(F.collect_list("placed")), lambda p: p["row"]).alias("rows"))
    # One empty page where there is no row at all.
    none = placed.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("bigint").alias("page"))
    every = held.unionByName(none.withColumn("rows", F.array().cast("array<string>")))
    return every.select(
        F.lit(sql_text).alias("sql_query"), "page", F.size("rows").cast("bigint").alias("row_count"), _json_rows(F.col("rows")).alias("sql_result")
    )


def _json_rows(rows: Column) -> Column:
    whole = F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))
    return F.when(F.size(rows) == 0, F.lit("No data found.")).otherwise(whole)
