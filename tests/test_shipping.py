"""Queries with Python workers run from a working directory that does not hold the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from stampline.session import local_session
spark = local_session(2, "2g", "elsewhere")
for name in ("e11_clustered_auroc_ci_poisson", "h1_signal_clean"):
    print(name, len(entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
"""


def test_workers_find_the_package_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO))], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "h1_signal_clean" in out.stdout
