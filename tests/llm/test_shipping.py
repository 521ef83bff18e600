"""Python workers find the package wherever the driver was started."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from wayfare.session import local_session
spark = local_session(2, 2)
q, sf = e.queries(), "/root/testdata/sf0.001"
assert q["op9_exact_dedup"](spark, sf).count() == 200
assert q["op8_byte_bpe"](spark, sf).count() == 200
assert q["parameters_invalid"](spark, sf).count() >= 0
print("done")
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
