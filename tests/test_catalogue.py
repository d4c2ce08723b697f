from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from lintel.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_tells_what_its_sql_tells(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rows = plain([tuple(r) for r in df.collect()], df.columns)
    if name not in catalogue.oracle_sql():
        return
    told = con.sql(catalogue.oracle_sql()[name])
    assert rows == plain(told.fetchall(), told.columns)
    assert sorted(df.columns) == sorted(told.columns)


def test_entry_works_without_the_optional_parts(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/lintel", tmp_path / "lintel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    shown = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True).stdout.split()
    assert int(shown[0]) == len(catalogue.queries()) and int(shown[1]) == len(catalogue.oracle_sql())


def test_stream_tells_what_the_batch_tells(spark, tmp_path):
    from lintel.plans.rules import default_rules, evaluate_documents
    from lintel.sources.annotations import read_documents
    from lintel.streaming.files import document_stream, review_stream

    rules = [r for r in default_rules() if r.target == "shop"]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"shop": [{{"id": "S{i}", "area_m2": {20 + 10 * i}}}]}}')
    review_stream(document_stream(spark, str(tmp_path / "in"), 2), rules, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out")).select("target_id", "passed").collect()
    batch = evaluate_documents(read_documents(spark, str(tmp_path / "in")), rules).select("target_id", "passed").collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch)) == [("S0", True), ("S1", True), ("S2", False)]
