"""The library stands without its optional subpackage."""

import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "quern").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "quern").parts[:1]:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quern.llm") for n in names), path


def test_entry_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= queries.keys() and {"p1_found", "p3_found", "p4_found", "p5_found"} <= queries.keys()
