"""The training-data queries against their SQL, on all and on empty tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import duck_rows, spark_rows  # noqa: E402

from quillon.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    assert spark_rows(QUERIES[name](spark, data)) == duck_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    if name.endswith("_found"):
        assert rows and len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, data, tmp_path, name):
    for p in Path(data).iterdir():
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(str(tmp_path / p.name))
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
