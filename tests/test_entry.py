"""The driver's contract."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    """Nothing but the entry point knows the llm folder."""
    code = "import sys; sys.modules['cohortshift.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0]).returncode == 0
