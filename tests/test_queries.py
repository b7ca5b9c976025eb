import pytest

from librarium.plans import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, data, con, name):
    same(registry.QUERIES[name](spark, data), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stats_need_one_join(spark, data):
    plan = _plan(registry.QUERIES["book_stats"](spark, data))
    assert plan.count("Join") == 1 and "Python" not in plan


def test_pages_take_ordered(spark, data):
    assert "TakeOrderedAndProject" in _plan(registry.QUERIES["reading_recent"](spark, data))


def test_history_limits_before_it_shuffles(spark, data):
    assert "WindowGroupLimit" in _plan(registry.QUERIES["reading_history_topk"](spark, data))


@pytest.mark.parametrize("name", ["word_count", "chapters_segment", "chapter_stats", "toc_tree", "page_parts", "filename_tags"])
def test_no_python_worker(spark, data, name):
    plan = _plan(registry.QUERIES[name](spark, data))
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = _plan(registry.QUERIES["toc_documents"](spark, data))
    assert "EqualTo(toc_level,0)" in plan and "word_count" not in plan.split("ReadSchema")[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
