"""The driver's three functions."""

import __spark_entry__ as e


def test_entry_and_registers_fit_together(spark):
    found = e.entry(spark)
    assert found.columns and found.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_the_training_data_operators():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import sys, sievemark.plans.registry; print(any(m.startswith('sievemark.llm') for m in sys.modules))"], capture_output=True, text=True, check=True)
    assert said.stdout.strip() == "False"
