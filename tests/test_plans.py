"""Every plan with a DuckDB twin, against it; DuckDB runs in a process of its own."""

import json
import subprocess
import sys

import pytest

from parlance.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
COMPARE = """
import json, sys
import duckdb
tables, sf, path = json.loads(sys.argv[1]), sys.argv[2], sys.argv[3]
con = duckdb.connect()
con.execute("set enable_progress_bar = false")
for t in tables:
    con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
def norm(v):
    if v is None or v != v: return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_tuple"): return str(v)
    return round(float(v), 9)
out = {}
for name, sql in json.load(open(path)).items():
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    out[name] = [sorted(cols), sorted(json.dumps([norm(r[i]) for i in order]) for r in cur.fetchall())]
print(json.dumps(out))
"""


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_tuple"):
        return str(v)
    return round(float(v), 9)


@pytest.fixture(scope="session")
def duck(tmp_path_factory):
    path = tmp_path_factory.mktemp("duck") / "sql.json"
    path.write_text(json.dumps(catalogue.ORACLES))
    got = subprocess.run([sys.executable, "-c", COMPARE, json.dumps(TABLES), SF, str(path)], capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-2000:]
    return json.loads(got.stdout)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(json.dumps([norm(r[c]) for c in cols]) for r in df.collect())
    assert [cols, rows] == duck[name]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 5 and sum(r.pooled for r in rows) == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["grouped_sums"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan
    plan = catalogue.QUERIES["lexicon_phi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "Python" not in plan
