"""The driver's contract, with and without subpackage llm."""

import shutil
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_names_and_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"split", "turn", "cum_status", "n", "mean"}


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "turnloom", tmp_path / "turnloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    check = "import __spark_entry__ as e; names = e.queries(); assert 'd1_mean_report' in names and not any(n.startswith('op') or n == 'pipeline' for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
