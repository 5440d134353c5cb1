"""The driver's entry without the optional text operators."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.modules[{blocked!r}] = None
import __spark_entry__ as e
from tinderframe.catalog import QUERIES
assert set(e.queries()) >= set(QUERIES) and e.oracle_sql()
assert not any(q.startswith("op") and q[2].isdigit() for q in e.queries())
"""


def test_other_queries_stay_without_a_package_of_the_text_operators():
    for blocked in ("xxhash", "tinderframe.llm"):
        subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], check=True, cwd=Path(__file__).parent.parent)
