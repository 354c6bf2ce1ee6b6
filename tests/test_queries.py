import ast
import os
import pathlib

import pytest

from quorumdf.plans import catalogue
from tests.oracle import DATA, compare

ROOT = pathlib.Path(__file__).parent.parent


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_sound_rows(spark, name):
    """Rows come out, probabilities are distributions, shares and scores lie in their range."""
    rows = catalogue.QUERIES[name](spark, DATA).collect()
    assert rows
    for r in rows:
        for column, value in r.asDict().items():
            if column == "p" or column.startswith("p_"):
                assert value is None or min(value) >= 0 and abs(sum(value) - 1) < 1e-6, (name, column, value)
            if column in ("confidence", "low", "high", "point", "accuracy", "coverage"):
                assert value is None or -1e-9 <= value <= 1 + 1e-9, (name, column, value)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_core_does_not_import_the_optional_subpackage():
    package = ROOT / "quorumdf"
    for path in package.rglob("*.py"):
        if "llm" in path.relative_to(package).parts[:1]:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quorumdf.llm") for n in names), path


def test_repository_is_small():
    assert sum(p.stat().st_size for p in (ROOT / "quorumdf").rglob("*") if p.is_file() and "__pycache__" not in p.parts) < 2_000_000
    assert not os.path.exists(ROOT / "spark-warehouse") or not os.listdir(ROOT / "spark-warehouse")
