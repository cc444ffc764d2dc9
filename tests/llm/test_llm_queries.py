import pytest

from oracle import same
from quillstrata.llm.catalogue import ORACLE_SQL, QUERIES


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    same(QUERIES[name](spark, tables), ORACLE_SQL[name], tables)


def test_packages_are_separate():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "quillstrata"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            names = [n.module or "" if isinstance(n, ast.ImportFrom) else n.names[0].name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom))]
            assert not any("llm" in n for n in names), path
