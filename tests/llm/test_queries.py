import pytest

from librarium.llm.queries import QUERIES, SQL
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name, columns", [
    ("p1_found", "name_a name_b"), ("p2_found", "meta_id"), ("p3_found", "keep_id copy_id"), ("p4_found", "meta_id field"), ("p6_found", "id_a id_b"), ("p7_found", "tag_a tag_b"), ("p8_ids", "doc_id ids"),
])
def test_columns(spark, data, name, columns):
    df = QUERIES[name](spark, data)
    assert df.columns == columns.split()
    rows = df.collect()
    assert name == "p7_found" or rows
    assert len({repr(r) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    QUERIES[name](spark, data).count()
