"""The driver's entry, with the libraries of the optional corpus operators missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["ahocorasick", "xxhash", "rowsmith.llm", "corpus_pipeline"])
def test_relational_queries_stand_without_the_optional_part(blocked):
    code = (f"import sys; sys.modules[{blocked!r}] = None; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; "
            "q = e.queries(); assert 'report_phone_list' in q and set(e.oracle_sql()) <= set(q); "
            "print(sum(k.startswith('op') or k == 'pipeline' for k in q), len(q))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    optional, everything = map(int, out.stdout.split())
    assert optional == 0 and everything >= 69
