import subprocess
import sys
from pathlib import Path

CODE = """
import sys; sys.path.insert(0, {repo!r})
from tarn.session import local
import __spark_entry__ as e
spark = local(2, 2, "1g")
print("ROWS", e.queries()["v3_nesting"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = CODE.format(repo=str(Path(__file__).resolve().parents[1]))
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "ROWS 50" in got.stdout, got.stderr[-2000:]
