"""What the entry module gives where optional parts or libraries are missing."""

import importlib.util
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from snarewatch.plans import registry


def test_all_queries_of_the_engine_are_there():
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["ahocorasick", "regex", "snarewatch.llm"])
def test_a_missing_library_costs_only_what_needs_it(missing):
    code = f"""
import importlib.util, sys
find = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name == {missing!r} else find(name, *a)
sys.modules[{missing!r}] = None
import __spark_entry__ as e
print(*e.queries())
"""
    names = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert set(registry.queries()) <= set(names) and "pipeline" not in names
    if importlib.util.find_spec("snarewatch.llm") and missing == "ahocorasick":
        assert "op2_pii" not in names and "op5_sharding" in names
