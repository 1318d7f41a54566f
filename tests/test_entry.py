"""What the entry gives where the training-data operators, or packages that they need, aren't there."""

import importlib.util
import subprocess
import sys
import textwrap

import pytest

there = pytest.mark.skipif(not all(map(importlib.util.find_spec, ("timelens.llm", "corpus_pipeline"))), reason="the operators aren't there")


def entry_with(finder):
    code = f"""
    import importlib.abc, sys, warnings

    class Hidden(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path, target=None):
            if {finder}:
                raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

    sys.meta_path.insert(0, Hidden())
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        import __spark_entry__
    names = __spark_entry__.queries()
    print(len(names) > 100, sum(n.startswith("op") for n in names), "pipeline" in names, any("left out" in str(w.message) for w in said))
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=120, check=False)
    return run.stdout.split() if run.returncode == 0 else run.stderr


@there
def test_all_there():
    assert entry_with("False") == ["True", "13", "True", "False"]


def test_without_the_subpackage():
    assert entry_with('name == "timelens.llm"') == ["True", "0", "False", "False"]


@there
def test_without_the_pipeline():
    assert entry_with('name == "corpus_pipeline"') == ["True", "13", "False", "False"]


@there
def test_without_a_package_that_it_needs():
    assert entry_with('name == "zstandard"') == ["True", "0", "True", "True"]


@there
def test_other_errors_are_errors():
    assert "timelens.llm.common" in entry_with('name == "timelens.llm.common"')
