import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_other_queries_register_without_the_tokenizers_package():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; from larder import queries as q; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.ORACLES)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"}, check=True)
