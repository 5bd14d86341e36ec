"""The driver contract."""
import subprocess
import sys

from tests.conftest import ROOT


def test_names_can_be_listed_without_a_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"], cwd=ROOT, capture_output=True, text=True, check=True)
    count, unknown = map(int, out.stdout.split()[-2:])
    assert count > 70 and unknown == 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
