import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_core_does_not_import_the_optional_part():
    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n == 'legajo.llm' else f(n, *a); import __spark_entry__ as e; assert not any(n[0] == 'p' and n[1].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "legajo").rglob("*.py"):
        if "llm" not in path.parts:
            assert "legajo.llm" not in path.read_text(encoding="utf-8"), path
