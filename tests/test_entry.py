"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_and_names(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"key", "value"}
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50


def test_rest_does_not_import_the_llm_folder():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tidemark"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            for node in ast.walk(ast.parse(file.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), file
