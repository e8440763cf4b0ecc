"""Each query against its SQL on the smallest tables; the driver contract with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

from velspar.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    said = duck.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x
    rows = lambda found: sorted((tuple(plain(x) for x in r) for r in found), key=repr)
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(said)


def test_entry_without_the_training_data_operators():
    code = "import sys; sys.modules['velspar.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'gwas_marginal' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
