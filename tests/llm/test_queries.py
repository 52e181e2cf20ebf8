import ast
from pathlib import Path

import pytest

from skyloom.llm.oracle import SQL
from skyloom.llm.queries import QUERIES
from tests.oracle import connection, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(connection(FOLDER), SQL[name])


@pytest.mark.parametrize("name, columns", [("p7_containers", ["doc_id", "piece", "start", "tokens", "container"]), ("p7_report", None), ("p7_certificates", None), ("p8_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id"])])
def test_queries_without_sql(spark, name, columns):
    df = QUERIES[name](spark, FOLDER)
    assert columns is None or df.columns == columns
    assert df.count() > 0


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).parents[2]
    for p in (root / "skyloom").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            named = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n for n in named), p
