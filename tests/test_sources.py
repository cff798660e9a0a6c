import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from groundwork.errors import TableNotFound
from groundwork.sources import tables as access
from groundwork.sources.scratch import checkpoint_root, checkpointed, scratch_dir
from groundwork.sources.versions import complete_versions, publish, read_latest


def test_table_names_are_case_insensitive(tables):
    assert tables["ORDERS"].columns == tables["orders"].columns
    assert len(tables) == 14
    with pytest.raises(TableNotFound):
        tables["nope"]


def test_listing_counts_every_table(tables):
    counts = {r.table_name: r.row_count for r in access.list_tables(tables).collect()}
    assert counts["region"] == 5 and counts["nation"] == 25 and len(counts) == 14


def test_schema_keeps_column_order(tables):
    assert [r.data_length for r in access.table_schema(tables, "NATION").collect()] == [None] * 3
    listed = access.table_schema(tables, "NATION", measure=True).orderBy("position").collect()
    assert [(r.column_name, r.data_type) for r in listed] == [
        ("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"),
    ]
    assert listed[1].data_length == len("NATION_10")


def test_sql_is_capped_and_read_only(spark):
    assert access.run_sql(spark, "SELECT * FROM range(5000)").count() == 1000
    assert access.run_sql(spark, "SELECT * FROM range(5000)", max_rows=None).count() == 5000
    assert access.run_sql(spark, "SELECT * FROM range(10) WHERE id > :low", args={"low": 7}).count() == 2
    for statement in ("DROP TABLE x", "CREATE TABLE x (a int)", "INSERT INTO x VALUES (1)"):
        with pytest.raises(ParseException):
            access.run_sql(spark, statement)


def test_sql_may_end_in_a_line_comment(spark):
    assert access.run_sql(spark, "SELECT 1 AS a -- the end").collect()[0].a == 1


def test_envelope_with_and_without_rows(spark):
    some = access.result_envelope(access.run_sql(spark, "SELECT 1 AS a, CAST(NULL AS STRING) AS b"), "q").first()
    assert (some.sql_query, some.row_count, some.sql_result) == ("q", 1, '[{"a":1,"b":null}]')
    ordered = access.run_sql(spark, "SELECT id FROM range(30) ORDER BY id DESC", max_rows=20)
    assert access.result_envelope(ordered, "q").first().sql_result.startswith('[{"id":29},{"id":28}')
    none = access.result_envelope(access.run_sql(spark, "SELECT 1 AS a WHERE false"), "q").first()
    assert (none.row_count, none.sql_result) == (0, "No data found.")


def test_large_results_come_in_pages(spark):
    df = spark.range(0, 2500, 1, 5).selectExpr("id", "CAST(NULL AS STRING) AS b")
    with pytest.raises(Exception, match="more than 1000 rows"):
        access.result_envelope(df, "q").collect()
    assert access.result_envelope(df, "q", max_rows=2500).first().row_count == 2500
    pages = sorted(access.result_pages(df, "q", ["id"]).collect(), key=lambda r: r.page)
    assert [(r.page, r.row_count) for r in pages] == [(0, 1000), (1, 1000), (2, 500)]
    assert pages[2].sql_result.startswith('[{"id":2000,"b":null},{"id":2001')
    none = access.result_pages(df.limit(0), "q", ["id"]).collect()
    assert [(r.page, r.row_count, r.sql_result) for r in none] == [(0, 0, "No data found.")]


def test_facts_are_appended(spark, tmp_path):
    from groundwork.sources.versions import append

    append(spark.range(3), str(tmp_path / "facts"))
    append(spark.range(2), str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 5


def test_scratch_folders_lie_under_the_shared_checkpoint_folder(spark):
    root = checkpoint_root(spark)
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first.startswith(root) and second.startswith(root) and first != second


def test_checkpoint_cuts_the_plan(spark, plan):
    df = checkpointed(spark.range(10).groupBy((F.col("id") % 3).alias("g")).count())
    assert "Aggregate" not in plan(df) and df.count() == 3


def test_versions_appear_only_when_complete(spark, tmp_path):
    root = str(tmp_path / "table")
    assert complete_versions(spark, root) == [] and read_latest(spark, root) is None
    publish(spark.range(3), root, 0)
    publish(spark.range(7), root, 2)
    (tmp_path / "table" / "version=0000000003").mkdir()
    assert complete_versions(spark, root) == [0, 2]
    assert read_latest(spark, root).count() == 7
    assert read_latest(spark, root, below=2).count() == 3
    publish(spark.range(4), root, 2)
    assert read_latest(spark, root).count() == 4
