"""The driver contract: names, imports and the flagship query."""

import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["prompt", "doc", "score", "rank"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_the_training_operators():
    code = "import sys, quillspark.plans, quillspark.streaming.sessions, quillspark.sources.sessions; sys.exit(any(m.startswith('quillspark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
