"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from folioscope.plans import register

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(smoke_dir):
    held = duckdb.connect()
    held.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        held.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{smoke_dir}/{name}.parquet')")
    return held


def told(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in (row[k] for k in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(register.ORACLES))
def test_query_equals_its_sql(spark, sql, smoke_dir, name):
    got = register.QUERIES[name](spark, smoke_dir)
    answer = sql.execute(register.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(got.columns) == sorted(names)
    assert told(got.columns, got.collect()) == told(names, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(register.QUERIES) - set(register.ORACLES)))
def test_query_without_sql_gives_rows(spark, smoke_dir, name):
    assert register.QUERIES[name](spark, smoke_dir).count() > 0


def test_the_library_needs_no_training_data_package():
    import pathlib

    root = pathlib.Path(register.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "match_count", "snippet"]
    assert set(register.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
