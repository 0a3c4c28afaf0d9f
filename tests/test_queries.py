"""Every query of the core against its SQL in DuckDB, on the smallest tables."""

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from gleanery.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def same(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(same(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        at = Path(SF, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    found = db.execute(plans.SQL[name])
    assert sorted(df.columns) == sorted(c[0] for c in found.description)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(plans.SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = Path(__spark_entry__.__file__).parent
    for p in root.glob("gleanery/**/*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"gleanery\.llm|from \.+llm|corpus_pipeline", p.read_text()), p


def test_plans_push_down_and_keep_out_of_python(spark):
    plan = lambda n: plans.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("clean_text")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan("argmax_index")
    for n in ("aspect_terms", "overall_score", "topic_match"):
        assert "Exchange" not in plan(n) and "Python" not in plan(n)
