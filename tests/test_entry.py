import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).parents[1])


def test_core_survives_a_missing_library():
    """Without a library that only the subpackage on texts needs, the core queries are there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p8_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
