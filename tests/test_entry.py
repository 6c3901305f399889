"""The entry file where the text folder and the pipeline, one or both, are absent."""

import subprocess
import sys

import pytest
from conftest import ROOT

HIDE = """
import sys
from importlib.abc import MetaPathFinder

class Hidden(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(len(names), "pipeline" in names, any(n.startswith("op1_") for n in names))
"""


@pytest.mark.parametrize("hidden, pipeline, texts", [(["lumentab.llm"], "False", "False"), (["lumentab.llm", "corpus_pipeline"], "False", "False"), (["corpus_pipeline"], "False", None)])
def test_hidden_folders(hidden, pipeline, texts):
    done = subprocess.run([sys.executable, "-c", HIDE.format(names=hidden)], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    count, *found = done.stdout.split()
    assert int(count) > 190
    assert found[0] == pipeline and texts in (None, found[1])


def test_other_missing_modules_are_errors():
    done = subprocess.run([sys.executable, "-c", HIDE.format(names=["lumentab.operators.boxes"])], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode != 0 and "boxes" in done.stderr
