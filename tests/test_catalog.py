"""The catalogue's queries against their SQL, and the driver contract."""

import subprocess
import sys
from pathlib import Path

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesselwork.plans import catalog, derive

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(str(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in found.fetchall())


def test_no_task_groups_many_chunks(spark, sf_dir, monkeypatch):
    """Adaptive execution joins small partitions, by their bytes; those of the chunks stay apart."""
    monkeypatch.setattr(derive, "ROWS_A_TASK", 500, raising=False)
    n = derive.read(spark, sf_dir, "lineitem").count()
    held = [r["count"] for r in derive.chunk_refs(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()]
    assert n > 3000 and len(held) > n // 500 and max(held) <= 750


@pytest.mark.parametrize("name", ["box_overlap", "rewrite_manifests_plan"])
def test_chunks_are_dealt_once(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_NUM") == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_alone(tmp_path):
    """The library without the training-data operators and the pipeline."""
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root / "tesselwork", tmp_path / "tesselwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
