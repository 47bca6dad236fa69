"""The operators' queries against their DuckDB twins."""

import json
import subprocess
import sys

import pytest

from parlance.llm import queries
from tests.test_plans import COMPARE, SF, TABLES, norm


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    path = tmp_path_factory.mktemp("duck") / "sql.json"
    path.write_text(json.dumps(queries.ORACLES))
    got = subprocess.run([sys.executable, "-c", COMPARE, json.dumps(TABLES), SF, str(path)], capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-2000:]
    return json.loads(got.stdout)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert [cols, sorted(json.dumps([norm(r[c]) for c in cols]) for r in df.collect())] == duck[name]


def test_native_plans_have_no_python(spark):
    for name in ("op1_quality_rules", "op6_decontamination", "op8_license_scan"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
