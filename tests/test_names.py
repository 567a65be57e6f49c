"""No module defines a function or class twice: the later one would hide the earlier from its callers."""

import ast
from collections import Counter
from pathlib import Path

import ratelake


def test_no_definition_hides_another():
    for path in sorted(Path(ratelake.__path__[0]).rglob("*.py")):
        names = Counter(x.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.FunctionDef | ast.ClassDef))
        assert not [n for n, times in names.items() if times > 1], path
