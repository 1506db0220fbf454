import subprocess
import sys

from conftest import ROOT, SMALL


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_engine_stands_without_optional_subpackage():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("mnemospark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "recall" in e.queries() and not [k for k in e.queries() if k.startswith("op") or k == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_data_is_there():
    import os

    assert os.path.exists(f"{SMALL}/documents.parquet")
