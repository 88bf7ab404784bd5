"""The entry point with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
for name in sys.argv[1:]:
    sys.modules[name] = None  # importing it now raises ImportError
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") and n[2:3].isdigit() for n in e.queries()), "pipeline" in e.queries())
"""


@pytest.mark.parametrize("blocked", [["ahocorasick"], ["xxhash"], ["corpus_pipeline"], ["nomen.llm", "corpus_pipeline"]])
def test_entry_without(blocked):
    from nomen.plans import registry

    done = subprocess.run([sys.executable, "-c", CODE, *blocked], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, sql, ops, pipeline = done.stdout.split()[-4:]
    assert int(n) >= len(registry.queries()) and int(sql) >= len(registry.oracle_sql()) and (pipeline == "False" or blocked == ["ahocorasick"])
    assert ops == "False" or blocked == ["corpus_pipeline"]
