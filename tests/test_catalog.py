import pytest

from textindex_spark.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(name, agree):
    agree(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "textindex_spark"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
