"""The text operators can be taken out: nothing else imports them."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "pulsegrid").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_imports_without_them(tmp_path):
    for name in ("__spark_entry__.py", "pulsegrid"):
        source = ROOT / name
        if source.is_dir():
            for p in source.rglob("*.py"):
                if "llm" not in p.parts:
                    to = tmp_path / p.relative_to(ROOT)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    to.write_text(p.read_text())
        else:
            (tmp_path / name).write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
