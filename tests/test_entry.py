import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from voltide.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
# a cheap cross-section; tools/check.py compares every query
SAMPLE = ["futures_index", "siv_tr", "product_series", "expiry_table", "b76_greeks", "american_iv", "ingest_dce_futures"]


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    ratios = [r.hv_ratio for r in rows]
    assert rows and ratios == sorted(ratios, reverse=True)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_part():
    """With the training-data operators gone the other queries are still there."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('voltide.llm'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        f"sys.path.insert(0, {os.path.dirname(os.path.abspath(entry.__file__))!r})\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print('left', len(e.queries()), set(e.queries()) == set(e.oracle_sql()))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert f"left {len(QUERIES)} True" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(names)
    assert order == sorted(df.columns)

    def norm(rows, cols):
        at = [cols.index(c) for c in order]
        return sorted(repr([r[i] for i in at]) for r in rows)

    assert norm(df.collect(), df.columns) == norm(cur.fetchall(), names)


def test_executors_need_no_package(tmp_path):
    """The vectorized functions run when the workers cannot import voltide."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        f"print('rows', e.queries()['american_iv'](spark, {FOLDER!r}).count())\n"
        f"print('sum', e.queries()['american_iv'](spark, {FOLDER!r}).agg({{'iv': 'sum'}}).first()[0] > 0)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "sum True" in out.stdout, out.stderr[-2000:]
