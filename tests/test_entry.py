import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_core_does_not_import_llm():
    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n == 'siltspark.llm' else f(n, *a); import sys; import __spark_entry__ as e; assert e.llm is None; assert 'job_summary' in e.queries(); assert set(e.oracle_sql()) <= set(e.queries()); assert not [m for m in sys.modules if m.startswith('siltspark.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
