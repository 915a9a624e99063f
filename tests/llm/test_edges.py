import pytest

import __spark_entry__ as entry
from bitloom.llm import queries as llm

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}
NULLS = 3


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind, count in (("empty", 0), ("null", NULLS)):
        made[kind] = str(tmp_path_factory.mktemp(kind))
        for name, schema in TABLES.items():
            rows = [(None,) * (schema.count(",") + 1)] * count
            spark.createDataFrame(rows, schema).write.parquet(f"{made[kind]}/{name}.parquet")
    return made


@pytest.mark.parametrize("name", [*llm.queries(), "pipeline"])
def test_registered_queries_on_empty_and_null_tables(spark, folders, name):
    query = entry.queries()[name]
    made = {"op5_chat_format": 1}.get(name, 0)  # its added conversation
    assert len(query(spark, folders["empty"]).collect()) == made
    expected = {"op5_chat_format": 2, "pipeline": 1}.get(name, NULLS)
    assert len(query(spark, folders["null"]).collect()) == expected
