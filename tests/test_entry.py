"""The driver contract holds without a session and without the training-data operators."""

import ast
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'frequency_sheet' in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "callscope")):
        for name in names:
            if name.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, name)) as f:
                    for node in ast.walk(ast.parse(f.read())):
                        modules = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                        assert not any(m.startswith("callscope.llm") or m == "corpus_pipeline" for m in modules), name
