import pytest

from groundwork.operators import metadata, vectors
from groundwork.plans import domain
from tests.conftest import plan_of

ROWS = [
    (1, '{"lang": "en", "year": 2020, "tags": ["a"], "author": {"name": "x"}}'),
    (2, '{"lang": "de", "year": 2021.5, "draft": true}'),
    (3, '{"lang": "en", "year": "2022"}'),
    (4, "{}"),
    (5, "no json"),
    (6, None),
    (7, '{"lang": null, "year": 2030, "draft": false}'),
]


@pytest.fixture(params=["text", "variant"])
def rows_with(request, spark):
    df = spark.createDataFrame(ROWS, "id int, metadata string")
    return df if request.param == "text" else metadata.parsed(df)


@pytest.mark.parametrize(
    "conditions,ids",
    [
        ({"$.lang": "en"}, [1, 3]),
        ({"$.lang": "en", "$.year": (">=", 2021)}, [3]),
        ({"$.year": ("<", 2025)}, [1, 2, 3]),
        ({"$.year": (">", 2021.4)}, [2, 3, 7]),
        ({"$.lang": ["de", "fr"]}, [2]),
        ({"$.author.name": "x"}, [1]),
        ({"$.tags[0]": "a"}, [1]),
        ({"$.draft": True}, [2]),
        ({"$.draft": ("<>", True)}, [7]),
        ({"$.lang": None}, [4, 5, 6, 7]),
        ({}, [1, 2, 3, 4, 5, 6, 7]),
    ],
)
def test_conditions(rows_with, conditions, ids):
    assert sorted(r.id for r in metadata.where_metadata(rows_with, conditions).collect()) == ids


def test_bad_conditions_are_refused(spark):
    df = metadata.parsed(spark.createDataFrame(ROWS, "id int, metadata string"))
    with pytest.raises(ValueError):
        metadata.where_metadata(df, {"$.a": ("~", 1)})
    with pytest.raises(ValueError):
        metadata.where_metadata(df, {"$.a": [1, "b"]})
    with pytest.raises(TypeError):
        metadata.where_metadata(df, {"$.a": object()})


def test_facets_and_shape(spark):
    df = metadata.parsed(spark.createDataFrame(ROWS, "id int, metadata string"))
    found = {(r.path, r.value): r.n_rows for r in metadata.facets(df, ["$.lang", "$.draft"]).collect()}
    assert found[("$.lang", "en")] == 2 and found[("$.lang", None)] == 4 and found[("$.draft", "true")] == 1
    assert "lang: STRING" in metadata.shape(df).first().schema.replace("OBJECT<", "")


def test_the_filter_runs_below_the_vector_scan(tables):
    rows = metadata.where_metadata(domain.rag_rows(tables), {"$.lang": "en"})
    near = vectors.vector_topk(rows, [0.1] * 64, k=10_000)
    plan = plan_of(near).lower().replace("_", "")
    # Plans read from the top down: the scan of vectors is fed by the filter, not the other way round.
    assert plan.index("mapinarrow") < plan.index("parsejson")
    english = tables["documents"].where("lang = 'en'").selectExpr("doc_id AS id")
    assert near.count() == tables["embeddings"].selectExpr("vec_id AS id").join(english, "id").count() > 0


def test_variant_tables_are_kept_as_parquet(spark, tmp_path):
    metadata.parsed(spark.createDataFrame(ROWS, "id int, metadata string")).write.parquet(str(tmp_path / "rag"))
    back = spark.read.parquet(str(tmp_path / "rag"))
    assert back.schema["metadata"].dataType.typeName() == "variant"
    assert metadata.where_metadata(back, {"$.lang": "en"}).count() == 2
